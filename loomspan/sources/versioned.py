"""A keyed parquet table with atomic upserts: new folders for the buckets that change, then one pointer is swapped.

Keys are hashed into a fixed number of buckets. A merge reads and rewrites only buckets that the changes touch; the others
stay where they are. What is current is said by one small file (folder of each bucket and the last batch),
which a rename replaces, so readers see all of a merge or nothing, and a batch that is tried again changes nothing.
Folders of a merge that failed are never pointed at. One writer at a time, as in a streaming job.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._files = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        """Folders by bucket and the last batch; an empty table before the first merge."""
        where = self._jvm.Path(f"{self.path}/_current.json")
        if not self._files.exists(where):
            return {"batch": None, "folders": {}}
        stream = self._files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        fresh, target = (self._jvm.Path(f"{self.path}/{n}") for n in (f"_next-{uuid.uuid4().hex}", "_current.json"))
        out = self._files.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        how[0] = self._jvm.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(fresh), context.makeQualified(target), how)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(sorted(self._current()["folders"].values()))

    def merge(self, changes: DataFrame, batch: int, rules: dict[str, Column] | None = None) -> bool:
        """Upsert changes, at most one row for each key; whether the batch was new.

        rules: for a column, an expression over `old` and `new` (structs, null where there is no such row); others are the new row's.
        """
        state = self._current()
        if state["batch"] is not None and batch <= state["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        folder = f"v={batch}-{uuid.uuid4().hex[:8]}"
        new = changes.select(*self.schema.names).withColumn("_b", bucket).repartition(self.buckets, "_b").select("_b", *self.keys, F.struct(*self.schema.names).alias("new"))
        touched = [r[0] for r in new.select("_b").distinct().collect()]  # bucket numbers
        old = self._read([state["folders"][str(b)] for b in touched if str(b) in state["folders"]])
        old = old.select(bucket.alias("_b"), *self.keys, F.struct(*self.schema.names).alias("old"))
        both = old.join(new, ["_b", *self.keys], "full_outer")
        value = lambda n: (rules or {}).get(n, F.when(F.col("new").isNotNull(), F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")))
        columns = [F.when(F.col("new").isNull(), F.col(f"old.{n}")).otherwise(value(n)).cast(t.dataType).alias(n) for n, t in zip(self.schema.names, self.schema)]
        both.select("_b", *columns).write.partitionBy("_b").mode("overwrite").parquet(f"{self.path}/{folder}")
        state["folders"] |= {str(b): f"{folder}/_b={b}" for b in touched}
        self._point({"batch": batch, "folders": state["folders"]})
        return True

    def clean(self) -> None:
        """Delete versions that nothing points at; readers that began before a merge must be done."""
        used = {f.split("/")[0] for f in self._current()["folders"].values()}
        for status in self._files.listStatus(self._jvm.Path(self.path)):
            name = status.getPath().getName()
            if (name.startswith("v=") and name not in used) or name.startswith("_next-"):
                self._files.delete(status.getPath(), True)
