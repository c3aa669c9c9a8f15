"""Shared pieces of the training-data operators: scratch tables, Arrow chunks, output columns."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module_name: str) -> None:
    """Pickle a module by value when executors would not find it on their own path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if os.getcwd() != root and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        for name in (__name__, module_name):
            cloudpickle.register_pickle_by_value(sys.modules[name])


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; an own folder only for local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        import atexit

        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return f"file://{_OWN_DIRS[app]}"


#: The scratch folders that operators of this driver have made, oldest first.
MADE: list[Scratch] = []


class Scratch:
    """Tables in the shared checkpoint folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.app = spark, spark.sparkContext.applicationId
        self.root = f"{scratch_base(spark)}/loomspan-{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        MADE.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """The rows as a table; the shuffles that made it are deleted, as nothing reads them again."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def release(self) -> None:
        """Delete all of them, once what was read from them is written elsewhere."""
        self._delete(self.root)
        self.paths.clear()

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {id(t) for t in tables}
        self.drop(*[t for i, (t, _) in list(self.paths.items()) if i not in kept])

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            if id(t) in self.paths:
                self._delete(self.paths.pop(id(t))[1])


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application, once the results that read them are written."""
    app = spark.sparkContext.applicationId
    for scratch in [s for s in MADE if s.app == app]:
        scratch.release()
        MADE.remove(scratch)


HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, salts) of the keys (key, n) that hold more than a thousandth of all rows, of which there are fewer than a thousand."""
    some = max(1, total // HOT_SHARE)
    return counts.filter(F.col("n") > some).select(key, F.ceil(F.col("n") / some).cast("int").alias("salts"))


def dealt(df: DataFrame, hot: DataFrame, key: str, by: str | None) -> DataFrame:
    """df with a `salt` that deals the rows of a hot key over its salts, by column `by`; without it, each row goes to every salt."""
    out = df.join(F.broadcast(hot), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(by), F.col("salts").cast("long")).cast("int") if by else F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    return out.withColumn("salt", salt).drop("salts")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blob(batch: pa.RecordBatch) -> bytes:
    """A compressed Arrow stream of one batch."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unblob(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as r:
        return r.read_all().combine_chunks()


SLICES = "bucket long, block long, start int, keys binary, values binary"


def sliced(block: int, keys: np.ndarray, values: np.ndarray, bits: int, first: int = 0) -> pa.RecordBatch:
    """A block's sorted distinct 64-bit keys with a number each, cut into slices by their first `bits`.

    start is the place of a slice's first key, counted from `first`.
    """
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    to = np.append(at[1:], len(keys))
    data = [[x[i:j].tobytes() for i, j in zip(at.tolist(), to.tolist())] for x in (keys.astype("<u8"), values.astype("<u4"))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.full(len(at), block)), pa.array((first + at).astype(np.int32)), *(pa.array(x, pa.binary()) for x in data)], names=["bucket", "block", "start", "keys", "values"])


def joined(slices: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys and numbers of all slices of a bucket, and where each slice starts and ends in them."""
    keys = slices.column("keys").to_pylist()
    edge = np.cumsum([0, *(len(x) // 8 for x in keys)]).tolist()
    return np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(slices.column("values").to_pylist()), "<u4").astype(np.int64), edge


def answered(slices: pa.Table, answers: np.ndarray, edge: list[int], name: str) -> pa.Table:
    """(block, start, name): of each slice the answers to its keys, as bytes."""
    return pa.table([slices.column("block"), slices.column("start"), pa.array([answers[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())], names=["block", "start", name])


def bucket_bits(keys: int, bucket_keys: int, tasks: int) -> int:
    """First bits that name a bucket: enough for `bucket_keys` each, and for the tasks."""
    return max(-(-keys // bucket_keys), tasks, 1).bit_length()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: int, limit: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text and `rows` rows; a longer text stands alone, whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Input without columns whose names the operator's own output uses (case-insensitive)."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])
