"""Hard negatives of embedding anchors: exact integer scores by residue-number-system products, then windowed selection.

Components become floor(256 * x). Scores are inner products of integers, found as float32 matrix products modulo
small primes: residues are at most 510 in size and 64 of their products are summed at once, so every float32 sum is below
2**24 and exact; more components are reduced in between. Mixed-radix digits (Chinese remaindering) give back the signed
score, as the product of the primes is over four times the largest squared length, which bounds every score.

Anchor blocks meet every group of candidate blocks. The first pass keeps each anchor's best rows of its label, the second
its best rows of other labels within the score window of each positive; a cell of blocks reports no more rows than the result
may hold, and a window function ranks what the cells report.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; vectors meet those of equal
length only; repeated rows are rows of their own, and a repeated anchor is mined once for each row; an anchor
without positives, and a positive without negatives in its window, has no rows; a component or score that does not fit a
long is an error (as casting it is in SQL). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, ship

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
WINDOW = (30, 90)  # a negative has so many hundredths of the positive's score, bounds included
DEPTH = 64  # products summed in float32 at once: DEPTH * 510**2 < 2**24
GROUP_ROWS = 1 << 15  # candidates that one task holds
_PACKED = "dim int, block long, uids binary, ids binary, labels binary, kind string, vectors binary, bits int"
_CELL = ["uids", "ids", "labels", "kind", "vectors"]
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@cache
def moduli(bits: int) -> tuple[int, ...]:
    """The largest primes below 1,024 whose product is over 2**(bits + 2)."""
    out, product = [], 1
    for n in range(1021, 1, -2):
        if all(n % d for d in range(3, 32, 2)):
            out.append(n)
            product *= n
            if product > 1 << (bits + 2):
                return tuple(out)
    raise ValueError("no primes are left")


def _near(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, as the residue nearest to zero (or one beyond half of p), exact below 2**24."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(whole: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(whole, p).astype(np.float32)
    return np.where(r > p // 2, r - np.float32(p), r)


def scores(q: np.ndarray, c: np.ndarray, bits: int, ok: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64; they are below 2**bits in size. An error where one of an `ok` pair does not fit."""
    primes = moduli(bits)
    digits: list[np.ndarray] = []
    for p in primes:
        a, b = residues(q, p), residues(c, p).T
        total = _near(a[:, :DEPTH] @ b[:DEPTH], p)
        for at in range(DEPTH, q.shape[1], DEPTH):
            total = _near(total + _near(a[:, at : at + DEPTH] @ b[at : at + DEPTH], p), p)
        for d, earlier in zip(digits, primes):  # the digit of p in mixed radix
            total = _near((total - d) * np.float32(residues(np.array(pow(earlier, -1, p)), p)), p)
        digits.append(total)
    out = digits[-1].astype(np.int64)
    for d, p in zip(digits[-2::-1], primes[-2::-1]):
        out = out * p + d.astype(np.int64)  # modulo 2**64
    if bits > 62:
        rough = digits[-1].astype(np.float64)
        for d, p in zip(digits[-2::-1], primes[-2::-1]):
            rough = rough * p + d
        for i, j in zip(*np.nonzero(ok & (np.abs(rough) >= 2.0**62))):
            if not _LOW <= sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist())) <= _HIGH:
                raise OverflowError("the score of two vectors does not fit a long")
    return out


def best(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest `ok` scores of each row (all, if fewer); of equal scores the first columns."""
    if s.shape[1] > k:
        masked = np.where(ok, s, _LOW)
        least = np.partition(masked, s.shape[1] - k, axis=1)[:, -k][:, None]
        above, tie = ok & (s > least), ok & (s == least)
        room = k - above.sum(axis=1, keepdims=True)
        ok = above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= room))
    return np.nonzero(ok)


def _block(dim: int, block: int, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, flat: np.ndarray) -> pa.RecordBatch | None:
    """One packed row of integer vectors in order of id, without those that are not finite; bits: squared lengths are below 2**bits."""
    flat = flat.reshape(-1, dim)
    good = np.flatnonzero(np.isfinite(flat).all(axis=1))
    if not len(good):
        return None
    good = good[np.lexsort((uid[good], ids[good]))]
    whole = np.floor(flat[good] * SCALE)
    most = np.abs(whole).max()
    if not most < 2.0**63:
        raise OverflowError(f"a vector component times {SCALE} does not fit a long")
    kind = "<i2" if most < 1 << 15 else "<i8"
    bits = int(np.ceil(np.log2((whole**2).sum(axis=1).max() + 1))) + 1
    longs = [pa.array([x[good].astype("<i8").tobytes()]) for x in (uid, ids, labels)]
    return pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *longs, pa.array([kind]), pa.array([whole.astype(kind).tobytes()]), pa.array([bits], pa.int32())],
        names=["dim", "block", "uids", "ids", "labels", "kind", "vectors", "bits"],
    )


def _floats(lists: pa.Array) -> np.ndarray:
    return lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` equally long vectors of one partition; (uid, id, label, v) in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            longs, lists = [batch.column(i).to_numpy() for i in range(3)], batch.column(3)
            lengths = np.array(lists.value_lengths().fill_null(0))
            for dim in np.unique(lengths[lengths > 0]).tolist():
                pick = np.flatnonzero(lengths == dim)
                for at in range(0, len(pick), rows):
                    part = pick[at : at + rows]
                    block += 1
                    if (out := _block(dim, block, *(x[part] for x in longs), _floats(lists.take(pa.array(part))))) is not None:
                        yield out

    return vectors.mapInArrow(run, _PACKED)


def _pack_anchors(anchors: DataFrame, blocks: int) -> DataFrame:
    """Blocks of anchors, dealt by hash; block = dim << 32 | number, the number below `blocks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, items = batch.column(0)[i].as_py(), batch.column(1)[i].values
                if (out := _block(block >> 32, block, *(items.field(j).to_numpy() for j in range(3)), _floats(items.field(3)))) is not None:
                    yield out

    dealt = anchors.filter(F.size("v") > 0).withColumn("block", F.shiftleft(F.size("v").cast("long"), 32) + F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    return dealt.groupBy("block").agg(F.collect_list(F.struct("uid", "id", "label", "v")).alias("items")).mapInArrow(run, _PACKED)


def _grid(anchors: DataFrame, candidates: DataFrame, groups: int, sections: int) -> DataFrame:
    """Cells: each anchor block with each candidate block of its dimension. A candidate block goes to its group once for each
    section of the anchors (one for every million of them); an anchor block goes to every group."""
    a = anchors.select("dim", "windows", *[F.col(c).alias(f"a_{c}") for c in _CELL], F.pmod(F.xxhash64("block"), F.lit(sections)).alias("section"))
    a = a.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    c = candidates.select("dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), *[F.col(c).alias(f"c_{c}") for c in _CELL])
    c = c.withColumn("section", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sections - 1).cast("long"))))
    return a.join(c.hint("merge"), ["dim", "group", "section"])


def _side(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    longs = [np.frombuffer(row[f"{side}_{c}"], "<i8") for c in ("uids", "ids", "labels")]
    return *longs, np.frombuffer(row[f"{side}_vectors"], row[f"{side}_kind"]).reshape(-1, row["dim"]).astype(np.int64)


def _mine(cells: DataFrame, bits: int, positives: int, negatives: int) -> DataFrame:
    """(anchor, slot, id, score): of each cell the best rows of an anchor's label (slot -1), or, with windows, of other labels in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                auid, _, alabel, a = _side(row, "a")
                cuid, cid, clabel, c = _side(row, "c")
                windows = np.frombuffer(row["windows"], "<i8").reshape(len(auid), positives, 2) if row["windows"] is not None else None
                for at in range(0, len(auid), 256):
                    part = slice(at, at + 256)
                    same, other = alabel[part][:, None] == clabel[None, :], auid[part][:, None] != cuid[None, :]
                    s = scores(a[part], c, bits, other)
                    if windows is None:
                        picks = [(-1, *best(s, same & other, positives))]
                    else:
                        lows, highs = windows[part, :, 0], windows[part, :, 1]
                        within = [~same & (s >= lows[:, j, None]) & (s <= highs[:, j, None]) for j in range(positives)]
                        picks = [(j, *best(s, w, negatives)) for j, w in enumerate(within) if w.any()]
                    for slot, r, k in picks:
                        yield pa.RecordBatch.from_arrays([pa.array(auid[part][r]), pa.array(np.full(len(r), slot, np.int32)), pa.array(cid[k]), pa.array(s[r, k])], names=["anchor", "slot", "id", "score"])

    return cells.mapInArrow(run, "anchor long, slot int, id long, score long")


def score_window(positive: np.ndarray, window: tuple[int, int] = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest whole score s with low * positive <= 100 * s <= high * positive, without overflow."""
    hundreds = positive // 100
    rest = positive - 100 * hundreds
    return window[0] * hundreds - (-window[0] * rest) // 100, window[1] * hundreds + window[1] * rest // 100


def _windowed(anchors: DataFrame, positives: DataFrame, k: int, window: tuple[int, int]) -> DataFrame:
    """Anchor blocks with the score windows of each anchor's positives, in the order of its rows; none is an empty window."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(uids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "at", "anchor"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = np.empty((max(x["at"] for x in items) + 1, k, 2), "<i8")
                out[:, :, 0], out[:, :, 1] = _HIGH, _LOW
                for x in items:
                    if x["score"] is not None:
                        out[x["at"], x["slot"]] = score_window(np.array(x["score"], np.int64), window)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()])], names=["block", "windows"])

    slots = anchors.select("block", "uids").mapInArrow(unpack, "block long, at long, anchor long")
    items = slots.join(positives.select("anchor", "slot", F.col("score")), "anchor", "left")
    packed = items.groupBy("block").agg(F.collect_list(F.struct("at", "slot", "score")).alias("items")).mapInArrow(pack, "block long, windows binary")
    return anchors.drop("windows").join(packed, "block")


def hard_negatives(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor_rows: int = 1024, candidate_rows: int = 4096, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor row and each of its positives."""
    ship(__name__)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    cols = {"id": F.col(f"`{id_col}`").cast("long"), "label": F.col(f"`{label_col}`").cast("long"), "v": F.col(f"`{vector_col}`").cast("array<double>")}
    source = vectors.select(F.monotonically_increasing_id().alias("uid"), *[x.alias(n) for n, x in cols.items()], F.expr(is_anchor).alias("asked"))
    source = source.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    packed = scratch.write(_pack(source.select("uid", "id", "label", "v"), candidate_rows))
    wanted = scratch.write(source.filter("asked").select("uid", "id", "label", "v"))
    asked = wanted.count()
    anchors = scratch.write(_pack_anchors(wanted, max(1, -(-asked // anchor_rows)))).withColumn("windows", F.lit(None).cast("binary"))
    bits, packs = packed.agg(F.coalesce(F.max("bits"), F.lit(1)), F.count("*")).first()
    sections = max(1, asked >> 20)
    groups = max(1, -(-packs * candidate_rows // group_rows), min(packs, 2 * spark.sparkContext.defaultParallelism))
    by_score = [F.desc("score"), "id"]
    near = _mine(_grid(anchors, packed, groups, sections), bits, positives, negatives)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score))).filter(F.col("place") <= positives)
    near = scratch.write(near.select("anchor", (F.col("place") - 1).cast("int").alias("slot"), "id", "score"))
    far = _mine(_grid(_windowed(anchors, near, positives, window), packed, groups, sections), bits, positives, negatives)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*by_score))).filter(F.col("rank") <= negatives)
    far = far.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = wanted.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = far.join(pairs, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
