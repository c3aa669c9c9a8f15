"""Exact top-k search by distributed histogram selection over integer inner products.

Components become floor(64 * x). Vectors are packed into numpy blocks. Candidate blocks are dealt into groups that one task reads, and
the query blocks, far fewer, are sent to every group; each meets each candidate block there, and the scores are matrix
products, made again in each pass rather than stored. Scores are counted as 64-bit keys in their order: a pass counts each
query's in 1,024 bins of the range where its k-th best lies; the summed histograms tell the bin of the k-th score, the next
pass refines it, until bins are one score wide. A last pass keeps scores above the k-th and ranks ties by smaller id. A
cell only reports scores not below its own k-th best: the global k-th cannot be lower.

Products beyond 2**53 are 64-bit integer sums, which are right whenever the score fits a long. Defined cases: null vectors, null
ids, and vectors with a null, NaN or infinite component take no part; every other vector does. A component or a score of
a pair that does not fit a long is an error (as casting it is in SQL). Vectors meet those of equal length only; repeated
rows are rows of their own; fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, ship

K, SCALE, BINS = 20, 64, 10
_PACKED = "dim int, block long, uids binary, ids binary, kind string, vectors binary, bits int"
_CELL = ["uids", "ids", "kind", "vectors"]
GROUP_ROWS = 1 << 15  # candidates that one task holds


def _block(block: int, uid: np.ndarray, ids: np.ndarray, flat: np.ndarray, dim: int) -> pa.RecordBatch | None:
    """One packed row of integer vectors, without those that are not finite; bits: their squared lengths are below 2**bits."""
    flat = flat.reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1)
    if not good.any():
        return None
    whole = np.floor(flat[good] * SCALE)
    most = np.abs(whole).max()
    if not most < 2.0**63:
        raise OverflowError(f"a vector component times {SCALE} does not fit a long")
    kind = "<i2" if most < 1 << 15 else "<i8"
    bits = int(np.ceil(np.log2((whole**2).sum(axis=1).max() + 1))) + 1
    return pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x]) for x in (uid[good].astype("<i8").tobytes(), ids[good].astype("<i8").tobytes(), kind, whole.astype(kind).tobytes())), pa.array([bits], pa.int32())],
        names=["dim", "block", "uids", "ids", "kind", "vectors", "bits"],
    )


def _floats(lists: pa.Array) -> np.ndarray:
    return lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` equally long integer vectors of one partition; (uid, id, v) in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            uid, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = np.array(lists.value_lengths().fill_null(0))
            for dim in np.unique(lengths[lengths > 0]):
                pick = np.flatnonzero(lengths == dim)
                for at in range(0, len(pick), rows):
                    part = pick[at : at + rows]
                    out = _block(block, uid[part], ids[part], _floats(lists.take(pa.array(part))), int(dim))
                    block += 1
                    if out is not None:
                        yield out

    return vectors.mapInArrow(run, _PACKED)


def _pack_queries(queries: DataFrame, blocks: int) -> DataFrame:
    """Blocks of queries, dealt by hash; block = dim << 32 | number, the number below `blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, items = batch.column(0)[i].as_py(), batch.column(1)[i].values
                out = _block(block, items.field(0).to_numpy(), items.field(1).to_numpy(), _floats(items.field(2)), block >> 32)
                if out is not None:
                    yield out

    number = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    dealt = queries.filter(F.size("v") > 0).withColumn("block", F.shiftleft(F.size("v").cast("long"), 32) + number)
    return dealt.groupBy("block").agg(F.collect_list(F.struct("uid", "id", "v")).alias("items")).mapInArrow(run, _PACKED)


def _matrix(row: dict, dim: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}uids"], "<i8"), np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}vectors"], row[f"{side}kind"]).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray, dim: int, ok: np.ndarray) -> np.ndarray:
    """Inner products as int64; an error where one of an `ok` pair does not fit."""
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * dim
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = q.astype(np.int64) @ c.astype(np.int64).T  # modulo 2**64
    if most >= 2**62:
        near = q.astype(np.float64) @ c.astype(np.float64).T
        slack = (np.abs(q.astype(np.float64)) @ np.abs(c.astype(np.float64)).T) * (dim + 4) * 2.0**-52
        for i, j in zip(*np.nonzero(ok & (np.abs(near) + slack >= 2.0**63))):
            if not -(1 << 63) <= sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist())) < 1 << 63:
                raise OverflowError("the score of two vectors does not fit a long")
    return whole


def _tiles(row: dict, k: int) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of some queries with a candidate block, valid pairs, and the least score that can matter here."""
    dim = row["dim"]
    quid, _, q = _matrix(row, dim, "q_")
    cuid, cid, c = _matrix(row, dim, "c_")
    for at in range(0, len(quid), 256):
        part = slice(at, at + 256)
        ok = quid[part][:, None] != cuid[None, :]
        s = _scores(q[part], c, dim, ok)
        low = np.iinfo(np.int64).min
        if len(cuid) > k:
            masked = np.where(ok, s, low)
            least = np.partition(masked, len(cuid) - k, axis=1)[:, len(cuid) - k]
        else:
            least = np.full(len(s), low)
        yield quid[part], part, s, ok, least, cid


def _grid(queries: DataFrame, candidates: DataFrame, limits: DataFrame | None, groups: int, sections: int) -> DataFrame:
    """Cells: each query block with each candidate block of its dimension. A candidate block goes to its group once for each
    section of the queries (one for every million of them); a query block goes to every group."""
    q = queries.select("dim", "block", *[F.col(c).alias(f"q_{c}") for c in _CELL])
    q = q.join(limits, "block") if limits is not None else q.withColumn("limits", F.lit(None).cast("binary"))
    q = q.withColumn("section", F.pmod(F.xxhash64("block"), F.lit(sections))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).drop("block")
    c = candidates.select("dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), *[F.col(c).alias(f"c_{c}") for c in _CELL])
    c = c.withColumn("section", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sections - 1).cast("long"))))
    return q.join(c.hint("merge"), ["dim", "group", "section"])


def _keys(scores: np.ndarray, width: int) -> np.ndarray:
    """Unsigned keys below 2**width in the order of the scores, which are below 2**(width - 1) in size."""
    return scores.view(np.uint64) + np.uint64(1 << (width - 1))


def _count(cells: DataFrame, k: int, width: int, span: int, bits: int) -> DataFrame:
    """(query, bin, n): scores inside each query's range of 2**span keys, in bins of 2**(span - bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lows = np.frombuffer(row["limits"], "<u8") if row["limits"] is not None else None
                for quid, part, s, ok, least, _ in _tiles(row, k):
                    low = lows[part] if lows is not None else np.zeros(len(quid), np.uint64)
                    keys = _keys(s, width)
                    near = ok & (s >= least[:, None])
                    if span < 64:
                        near &= keys >> np.uint64(span) == low[:, None] >> np.uint64(span)
                    r, c = np.nonzero(near)
                    bins = (keys[r, c] >> np.uint64(span - bits)).astype(np.int64) & ((1 << bits) - 1)
                    key, n = np.unique(r.astype(np.int64) << bits | bins, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(quid[key >> bits]), pa.array(key & ((1 << bits) - 1)), pa.array(n.astype(np.int64))], names=["query", "bin", "n"])

    return cells.mapInArrow(run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _keep(cells: DataFrame, k: int, width: int) -> DataFrame:
    """Scores not below each query's k-th; of those equal to it in a cell the k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lows = (np.frombuffer(row["limits"], "<u8") - np.uint64(1 << (width - 1))).view(np.int64)
                for quid, part, s, ok, _, cid in _tiles(row, k):
                    low = lows[part][:, None]
                    above_r, above_c = np.nonzero(ok & (s > low))
                    tie_r, tie_c = np.nonzero(ok & (s == low))
                    order = np.lexsort((cid[tie_c], tie_r))
                    tie_r, tie_c = tie_r[order], tie_c[order]
                    rank = np.arange(len(tie_r)) - np.searchsorted(tie_r, tie_r)
                    tie_r, tie_c = tie_r[rank < k], tie_c[rank < k]
                    r, c = np.concatenate([above_r, tie_r]), np.concatenate([above_c, tie_c])
                    yield pa.RecordBatch.from_arrays([pa.array(quid[r]), pa.array(cid[c]), pa.array(s[r, c])], names=["query", "vec_id", "score"])

    return cells.mapInArrow(run, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 1024, candidate_rows: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows by integer inner product; other columns are not read."""
    ship(__name__)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    source = vectors.filter(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.expr(is_query).alias("q"))
    packed = scratch.write(_pack(source.select("uid", "id", "v"), candidate_rows))
    wanted = scratch.write(source.filter("q").select("uid", "id", "v"))
    asked = wanted.count()
    queries = scratch.write(_pack_queries(wanted, max(1, -(-asked // query_rows))))
    names = wanted.select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    most, packs = packed.agg(F.coalesce(F.max("bits"), F.lit(1)), F.count("*")).first()
    sections = max(1, asked >> 20)
    groups = max(1, -(-packs * candidate_rows // group_rows), min(packs, 2 * spark.sparkContext.defaultParallelism))
    width = min(64, int(most) + 1)  # |score| <= the largest squared length, by Cauchy and Schwarz, and fits a long

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(uids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "at", "query"])

    slots = scratch.write(queries.select("block", "uids").mapInArrow(unpack, "block long, at long, query long"))

    def pack_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = np.array([x["low"] for x in sorted(items, key=lambda x: x["at"])], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([low.tobytes()])], names=["block", "limits"])

    # low: the smallest key of each query's range, its 64 bits as a long; above: scores over the range
    state, limits, span = slots.select("query", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("above")), None, width
    by_bin = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # 1,024 bins at most
    while span:
        bits = min(BINS, span)
        counts = _count(_grid(queries, packed, limits, groups, sections), k, width, span, bits)
        summed = counts.join(state, "query").withColumn("upto", F.col("above") + F.sum("n").over(by_bin))
        hit = summed.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("query", F.col("low").bitwiseOR(F.shiftleft("bin", span - bits)).alias("to"), (F.col("upto") - F.col("n")).alias("over"))
        state = scratch.write(state.join(hit, "query", "left").select("query", F.coalesce("to", "low").alias("low"), F.coalesce("over", "above").alias("above")))
        span -= bits
        packed_limits = slots.join(state, "query").groupBy("block").agg(F.collect_list(F.struct("at", "low")).alias("items"))
        limits = scratch.write(packed_limits.mapInArrow(pack_limits, "block long, limits binary"))
    found = _keep(_grid(queries, packed, limits, groups, sections), k, width)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
