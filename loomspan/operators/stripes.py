"""Entities that occur together, counted by stripes.

Entities are numbered in their order, and a row's other entities travel as one array of numbers to the task that has an
entity, not as a row for each pair. Tasks read their entities in order and hold the counts of one at a time besides a
bounded buffer, so only the pairs asked for leave them. As arrays of long rows outgrow the input, entities are dealt to
rounds: the arrays of one round are on disk at once, and only its result stays.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.streaming.runs import stored

VALUES = 1 << 22  # numbers that a task holds before it counts them
TASK = 1 << 23  # numbers that a task reads, on average
ROUND, TIMES = 1 << 26, 8  # numbers that a round shuffles: so many, or so many times those of all rows


def _ship() -> None:
    """Executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbered(members: DataFrame) -> DataFrame:
    """(entity, code): the distinct entities, numbered from 0 in their order."""
    names = stored(members.select("entity").distinct().orderBy("entity").withColumn("m", F.monotonically_increasing_id()), "names")
    sizes = names.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = names.withColumn("part", F.shiftright("m", 33)).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return placed.select("entity", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("code"))


def _dealt(stripes: DataFrame, numbers: int) -> DataFrame:
    """Stripes by their entity, in order; a number of tasks that grows with what they read."""
    tasks = max(stripes.sparkSession.sparkContext.defaultParallelism, -(-numbers // TASK))
    return stripes.repartition(tasks, "e1").sortWithinPartitions("e1")


def _in_rounds(each: DataFrame, codes: int, numbers: int, run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """run(part of each, numbers) over parts of the entities e1, one after another; of the parts together."""
    n = -(-numbers // max(ROUND, TIMES * codes))
    if n <= 1:
        return run(each, numbers)
    out = None
    for i in range(n):
        part = stored(run(each.filter(F.pmod(F.xxhash64("e1"), F.lit(n)) == i), -(-numbers // n)), "round")
        out = part if out is None else out.union(part)
    return out


def _merged(keys: np.ndarray, values: list[np.ndarray], by: list[np.ufunc]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the values of each brought together."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], [f.reduceat(v[order], at) for f, v in zip(by, values)]


def _counted(batches: Iterator[pa.RecordBatch], weights, by: list[np.ufunc]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(e1, e2, values) of whole entities e1, from batches (e1, others, ...) in order of e1; weights(batch) gives the values of each row."""
    keys, values, fresh, open_ = [], [[] for _ in by], 0, -1

    def merge() -> None:
        nonlocal keys, values, fresh
        k, v = _merged(np.concatenate(keys), [np.concatenate(x) for x in values], by)
        keys, values, fresh = [k], [[x] for x in v], 0

    for batch in batches:
        e1, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        own = weights(batch)
        for a, b in _cuts(lengths):
            part = lists.slice(a, b - a).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(a, b), lengths[a:b])
            keep = part != e1[row]
            row = row[keep]
            keys.append((e1[row] << 32) | part[keep])
            for column, x in zip(values, own):
                column.append(x[row])
            fresh, open_ = fresh + len(row), int(e1[b - 1])
            if fresh >= VALUES:
                merge()
                done = int(np.searchsorted(keys[0], open_ << 32))
                if done:
                    yield keys[0][:done] >> 32, keys[0][:done] & 0xFFFFFFFF, [x[0][:done] for x in values]
                    keys, values = [keys[0][done:]], [[x[0][done:]] for x in values]
    if keys:
        merge()
        yield keys[0] >> 32, keys[0] & 0xFFFFFFFF, [x[0] for x in values]


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most VALUES numbers, or of one row."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + VALUES, "right")))
        yield a, b
        a = b


def _named(found: DataFrame, names: DataFrame) -> DataFrame:
    """Codes e1 and e2 as their entities."""
    for e in ("e1", "e2"):
        found = found.withColumnRenamed(e, "code").join(names.withColumnRenamed("entity", e), "code").drop("code")
    return found


def pair_counts(members: DataFrame, least: int, recent_days: float | None = None, keep: Column | None = None) -> DataFrame:
    """(e1, e2, recent, before, age) of entities e1 < e2 of one id, in members (id, entity, age): rows of at most
    `recent_days` (all, without it) and older ones, and the largest age of these; `least` recent ones or more, and only those to `keep`."""
    _ship()
    inf = float("inf") if recent_days is None else recent_days
    own = members.groupBy("id").agg(F.first("age").alias("age"), F.collect_list("entity").alias("entities"))
    most = F.size("entities") - F.size(F.array_distinct("entities")) + 1  # no entity comes more often in the id
    members = stored(own.select("id", "age", most.alias("most"), F.explode("entities").alias("entity")), "members")
    often = members.filter(F.col("age") <= inf).groupBy("entity").agg(F.sum("most").alias("n")).filter(F.col("n") >= least)  # as many rows as a pair of it may have
    names = stored(numbered(often), "codes")
    rows = stored(members.join(names, "entity").groupBy("id").agg(F.first("age").alias("age"), F.array_sort(F.collect_list("code")).alias("codes")).filter(F.size("codes") > 1), "rows")
    numbers, codes = (x or 0 for x in rows.agg(F.sum(F.size("codes").cast("long") * F.size("codes") / 2).cast("long"), F.sum(F.size("codes"))).first())
    each = rows.select("age", "codes", F.posexplode("codes").alias("p", "e1")).filter(F.col("p") + 1 < F.size("codes"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weights(batch: pa.RecordBatch) -> list[np.ndarray]:
            age = batch.column(2).to_numpy()
            return [(age <= inf).astype(np.int64), (age > inf).astype(np.int64), np.where(age > inf, age, -np.inf)]

        for e1, e2, (recent, before, age) in _counted(batches, weights, [np.add, np.add, np.maximum]):
            some = recent >= least
            columns = (e1[some].astype(np.int32), e2[some].astype(np.int32), recent[some], before[some], age[some])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["e1", "e2", "recent", "before", "age"])

    def counted(part: DataFrame, numbers: int) -> DataFrame:
        stripes = _dealt(part.select("e1", F.slice("codes", F.col("p") + 2, F.size("codes")).alias("others"), "age"), numbers)
        found = stripes.mapInArrow(run, "e1 int, e2 int, recent long, before long, age double")
        return found.filter(keep) if keep is not None else found

    return _named(_in_rounds(each, codes, numbers, counted), names)


def thirds(members: DataFrame, least: int) -> DataFrame:
    """(entity, n, old, new, both): of entities of `least` ids or more in members (id, created_at, entity), how many others
    the first and the last third of their rows have, and how many both have."""
    _ship()
    members = stored(members.select("id", "created_at", "entity"), "members")
    names = stored(numbered(members), "codes")
    coded = stored(members.join(names, "entity").select("id", "created_at", "code"), "coded")
    n = coded.groupBy("code").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least)
    third = F.ntile(3).over(Window.partitionBy("code").orderBy("created_at", "id"))
    asked = coded.join(n.select("code"), "code").withColumn("third", third).filter("third != 2").groupBy("id").agg(F.collect_list(F.struct("code", "third")).alias("asked"))
    rows = stored(coded.groupBy("id").agg(F.collect_list("code").alias("codes")).join(asked, "id").select("codes", "asked"), "rows")
    numbers, codes = (x or 0 for x in rows.agg(F.sum(F.size("codes").cast("long") * F.size("asked")), F.sum(F.size("codes"))).first())
    each = rows.select("codes", F.explode("asked").alias("a"))
    each = each.select(F.col("a.code").alias("e1"), F.col("codes").alias("others"), F.when(F.col("a.third") == 1, 1).otherwise(2).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e1, _, (bits,) in _counted(batches, lambda b: [b.column(2).to_numpy()], [np.bitwise_or]):
            if not len(e1):
                continue
            at = np.flatnonzero(np.concatenate([[True], e1[1:] != e1[:-1]]))
            sums = [np.add.reduceat(x.astype(np.int32), at, dtype=np.int32) for x in (bits & 1, bits >> 1, bits == 3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e1[at].astype(np.int32), *sums)], names=["code", "old", "new", "both"])

    found = _in_rounds(each, codes, numbers, lambda part, n: _dealt(part, n).mapInArrow(run, "code int, old int, new int, both int"))
    return found.join(n, "code").join(names, "code").select("entity", "n", "old", "new", "both")
