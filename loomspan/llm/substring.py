"""Removal of passages that an earlier document already has, by prefix-partitioned suffix trees.

Words are runs of non-white bytes. A suffix is worth a place in a tree only if its first `window` words can repeat, so each
window is known by its minimizer: the smallest hash among its runs of CORE words. Windows of equal words have their
minimizer at the same place, and a fifth of all positions are minimizers, so the suffixes of the windows around them
find every repeat of `window` words or more.

1. Documents are packed, whole rows, into compressed blocks: a scratch table that every later pass reads. Of equal texts
   only the one with the smallest id enters the trees; the others lose all their windows.
2. Minimizer hashes go to buckets in packed slices, once for each block; a bucket tells which ones two documents have and how many
   bytes their suffixes take. The rest are leaves of the tree: dropped.
3. Suffixes are grouped by prefixes of variable length. The first prefix runs from the window's start through its minimizer.
   A group longer than `group_bytes` collapses equal suffixes and takes LONGER words as its prefix; one that is still longer
   takes the whole window. A group that fits is a subtree that one task holds: suffixes sorted by their words, longest common
   prefixes of neighbours, and the intervals where these are `window` words or deeper, its deep internal nodes: the maximal
   repeats, each with the smallest doc_id below. A group by whole windows is one node, and a pre-aggregated minimum gives its
   smallest doc_id with no task holding it.
4. Covered words go back to their block and are cut out.

Equal suffixes of a block travel as one row with the places that have it, so that one passage in every text is a row for each
block. Windows are compared word by word in every group; whole texts and suffixes are found equal by 128-bit digests
(two different ones of a digest: 2**-128 a pair).

Defined cases: null text has no words; rows with a null doc_id are kept whole and remove nothing; rows of the same
doc_id never remove each other's words; texts of any length are processed whole, words of any length too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import SLICES, Scratch, answered, blob, bucket_bits, chunks, joined, replace_columns, ship, sliced, text_bytes, unblob

WINDOW, CORE, LONGER = 13, 5, 9
GROUP_BYTES, BLOCK_BYTES, BUCKET_KEYS = 1 << 18, 1 << 20, 1 << 21
_ROW_BITS, _POS_BITS, _MASK_BITS = 16, 34, 13
_MASK = (1 << _MASK_BITS) - 1
_MIX, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _blocks(docs: DataFrame, id_at: int, text_at: int, block_bytes: int) -> DataFrame:
    """Compressed blocks of rows; marks: each distinct text's digest with the ids and numbers of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, text_at, block_bytes, (1 << _ROW_BITS) - 1):
                marks: dict[bytes, tuple[list, list]] = {}
                ids, size = part.column(id_at).to_pylist(), 0
                for row, text in enumerate(text_bytes(part.column(text_at))):
                    size += len(text)
                    if ids[row] is not None:
                        of = marks.setdefault(xxhash.xxh3_128_digest(text), ([], []))
                        of[0].append(ids[row])
                        of[1].append(row)
                listed = [{"digest": d, "ids": i, "at": r} for d, (i, r) in marks.items()]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([blob(part)]), pa.array([size]), pa.array([listed], kind)], names=["block", "rows", "size", "marks"])
                number += 1

    kind = pa.list_(pa.struct([("digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]))
    return docs.mapInArrow(run, "block long, rows binary, size long, marks array<struct<digest:binary,ids:array<long>,at:array<int>>>")


def _copies(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, copies): per block the rows whose whole text a document with a smaller id has; all their windows go."""
    rows = blocks.select("block", F.explode("marks").alias("m")).select("block", "m.*")
    again = rows.groupBy("digest").agg(F.min(F.array_min("ids")).alias("lo"), F.max(F.array_max("ids")).alias("hi")).filter("lo < hi").select("digest", "lo")
    late = F.filter(F.arrays_zip("ids", "at"), lambda x: x["ids"] > F.col("lo"))
    found = rows.join(again.hint("merge"), "digest").select("block", F.transform(late, lambda x: x["at"]).alias("at")).filter(F.size("at") > 0)
    return scratch.write(found.groupBy("block").agg(F.flatten(F.collect_list("at")).alias("copies")))


def _cores(words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core hash, row, position and windows of every minimizer; bit o of the last: the window that starts o words before."""
    lens = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    total, none = int(starts[-1]), np.zeros(0, np.int64)
    spread = window - CORE + 1
    if total < window:
        return none.view(np.uint64), none, none, none
    h = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, total)
    row = np.repeat(np.arange(len(words)), lens)
    n = total - CORE + 1
    key = np.zeros(n, np.uint64)
    for j in range(CORE):
        key = key * _MIX + h[j : n + j]
    key ^= key >> np.uint64(31)
    key *= _MUL
    key ^= key >> np.uint64(29)
    m = total - window + 1
    best, at = key[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, spread):
        other = key[j : m + j]
        less = other < best
        np.copyto(best, other, where=less)
        at[less] = j
    first = np.flatnonzero(row[:m] == row[window - 1 :])  # windows inside one row
    spot, offset = first + at[first], at[first]
    mask = np.bincount(spot, weights=(1 << offset).astype(np.float64), minlength=1).astype(np.int64)
    spot = np.flatnonzero(mask)
    return key[spot], row[spot], spot - starts[row[spot]], mask[spot]


def _text_bytes_around(words: list[list[bytes]], row: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """Bytes of the words that a suffix row of each core carries."""
    lens = np.array([len(w) for w in words], np.int64)
    ends = np.concatenate([[0], np.cumsum(np.fromiter((len(x) + 1 for w in words for x in w), np.int64, int(lens.sum())))])
    base = (np.cumsum(lens) - lens)[row]
    return ends[base + np.minimum(pos + window, lens[row])] - ends[base + np.maximum(pos - window + CORE, 0)]


def _split(texts: list[bytes], ids: list) -> list[list[bytes]]:
    """Words of each row; none where the id is null, as such rows take no part."""
    return [t.split() if i is not None else [] for t, i in zip(texts, ids)]



def lcp_nodes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their words, given as rows of word numbers (-1 where they end), and of each place in that order its
    node: neighbours are below one node where their longest common prefix is `depth` words or more."""
    ids = np.ascontiguousarray((ids + 1).astype(">u4"))
    order = np.argsort(ids.view(np.dtype((np.void, ids.shape[1] * 4))).ravel(), kind="stable")
    ranked = ids[order]
    other = (ranked[1:] != ranked[:-1]) | (ranked[1:] == 0)
    lcp = np.where(other.any(axis=1), other.argmax(axis=1), ids.shape[1])
    return order, np.cumsum(np.concatenate([[0], lcp < depth]))[: len(ids)]


def deep_nodes(suffixes: list[tuple[bytes, int, int]], depth: int) -> Iterator[tuple[int, int, list[int]]]:
    """Internal nodes at `depth` words or deeper over (words, doc_id, place): smallest id, largest id, places below."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in text.split(b" ")] for text, _, _ in suffixes]
    if not words:
        return
    ids = np.full((len(words), max(depth, max(map(len, words)))), -1)
    for i, w in enumerate(words):
        ids[i, : len(w)] = w
    order, node = lcp_nodes(ids, depth)
    edge = np.flatnonzero(np.diff(node, prepend=-1, append=-1)).tolist()
    for a, b in zip(edge, edge[1:]):
        if b - a > 1:
            below = [suffixes[i] for i in order[a:b].tolist()]
            yield min(x[1] for x in below), max(x[1] for x in below), [x[2] for x in below]


def _least_below(texts: list[bytes], starts: np.ndarray, row: np.ndarray, lo: np.ndarray, depth: int, reach: int) -> np.ndarray:
    """For suffixes that start `starts` words into their row's text (rows as in `row`): the smallest lo below the same deep node."""
    number: dict[bytes, int] = {}
    words = [t.split(b" ") for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(lens.sum()))
    end = np.cumsum(lens)
    at = ((end - lens)[row] + starts)[:, None] + np.arange(reach)
    ids = np.where(at < end[row][:, None], flat[np.minimum(at, len(flat) - 1)], -1)
    order, node = lcp_nodes(ids, depth)
    least = np.minimum.reduceat(lo[row][order], np.flatnonzero(np.diff(node, prepend=-1)))
    out = np.zeros(len(row), np.int64)
    out[order] = least[node]
    return out


_SUFFIX = "h long, long_group boolean, shape long, words binary, lo long, docs array<long>, refs array<long>, block long"


def _suffix_rows(block: int, rows: pa.Table, back: pa.Table, id_at: int, text_at: int, window: int) -> pa.Table:
    """A block's suffixes whose minimizers are shared, equal ones as one row; shape: words before the core, and the windows."""
    ids = rows.column(id_at).to_pylist()
    words = _split(text_bytes(rows.column(text_at)), ids)
    key, row, pos, mask = _cores(words, window)
    distinct, at = np.unique(key, return_inverse=True)
    flags, copies = np.zeros(len(distinct), np.uint8), set()
    for start, data, late in zip(*(back.column(c).to_pylist() for c in ("start", "flags", "copies"))):
        if late is not None:
            copies.update(late)
        else:
            flags[start : start + len(data)] = np.frombuffer(data, np.uint8)
    out: dict[tuple, tuple[list, list]] = {}
    left, kind = np.minimum(pos, window - CORE), flags[at]
    ref = (row << (_POS_BITS + _MASK_BITS)) | (pos << _MASK_BITS) | mask
    pick = np.flatnonzero(kind)
    for h, long_group, r, p, before, m, place in zip(*(x[pick].tolist() for x in (key.view(np.int64), kind > 1, row, pos, left, mask, ref))):
        if r not in copies:
            held = out.setdefault((h, long_group, before << _MASK_BITS | m, b" ".join(words[r][p - before : p + window])), ([], []))
            held[0].append(ids[r])
            held[1].append(place)
    columns = [*zip(*out)] or [()] * 4
    docs, refs = [d for d, _ in out.values()], [r for _, r in out.values()]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    data = (*columns, [min(d) for d in docs], docs, refs, [block] * len(docs))
    return pa.table([pa.array(c, t) for c, t in zip(data, kinds)], names=["h", "long_group", "shape", "words", "lo", "docs", "refs", "block"])


def _offsets(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every shape: its row, how many words before the core it starts, and its start in the row's words."""
    bit = (shape[:, None] >> np.arange(_MASK_BITS)) & 1
    row, before = np.nonzero(bit)
    return row, before, (shape >> _MASK_BITS)[row] - before


def _subtrees(group: str, columns: list[str], solve: Callable, held_bytes: int) -> Callable:
    """mapInArrow function: rows sorted by `group` are solved, whole groups at a time, about `held_bytes` of words together."""
    at, words = columns.index(group), columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= held_bytes and r[at] != held[-1][at]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[words]) + 64
        if held:
            yield from solve(held)

    return run


def _hits(block: np.ndarray, refs: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each block, with the windows found in it."""
    pick = np.flatnonzero(bits)
    pick = pick[np.argsort(block[pick], kind="stable")]
    if len(pick):
        at = np.flatnonzero(np.diff(block[pick], prepend=block[pick][0] - 1))
        found = pa.array(refs[pick] >> _MASK_BITS << _MASK_BITS | bits[pick])
        yield pa.RecordBatch.from_arrays([pa.array(block[pick][at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(pick)), pa.int32()), found)], names=["block", "refs"])


def removed_windows(blocks: DataFrame, copies: DataFrame, scratch: Scratch, id_at: int, text_at: int, window: int, group_bytes: int) -> DataFrame:
    """(block, refs) of windows that start in a document with a smaller id; a ref packs row, core position and windows."""
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = bucket_bits(total // 20, BUCKET_KEYS, blocks.sparkSession.sparkContext.defaultParallelism)  # about a key for 30 bytes

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = unblob(data)
                ids = rows.column(id_at).to_pylist()
                words = _split(text_bytes(rows.column(text_at)), ids)
                key, row, pos, _ = _cores(words, window)
                distinct, at = np.unique(key, return_inverse=True)
                size = np.bincount(at, weights=_text_bytes_around(words, row, pos, window) + 64, minlength=len(distinct)).astype(np.int64)
                doc = np.unique(np.array([-1 if i is None else i for i in ids], np.int64), return_inverse=True)[1][row]
                low, high = np.full(len(distinct), 1 << 40), np.full(len(distinct), -1)
                np.minimum.at(low, at, doc)
                np.maximum.at(high, at, doc)
                yield sliced(block, distinct, np.minimum(size, (1 << 31) - 1) << 1 | (low < high), bits)

    def tell(slices: pa.Table) -> pa.Table:
        key, value, edge = joined(slices)
        distinct, at, n = np.unique(key, return_inverse=True, return_counts=True)
        several = (n > 1) | (np.bincount(at, weights=value & 1, minlength=len(distinct)) > 0)
        size = np.bincount(at, weights=value >> 1, minlength=len(distinct))
        return answered(slices, (several.astype(np.uint8) + (several & (size > group_bytes)))[at], edge, "flags")

    texts = blocks.select("block", "rows")
    flags = scratch.write(texts.mapInArrow(keys, SLICES).groupBy("bucket").applyInArrow(tell, "block long, start int, flags binary"))
    back = flags.withColumn("copies", F.lit(None).cast("array<int>")).unionByName(copies.select("block", F.lit(None).cast("int").alias("start"), F.lit(None).cast("binary").alias("flags"), "copies"))

    def suffix_rows(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        return _suffix_rows(key[0].as_py(), unblob(own.column("rows")[0].as_py()), told, id_at, text_at, window)

    suffixes = scratch.write(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(suffix_rows, _SUFFIX))

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, shape, text, lo, docs, refs, block = zip(*held)
        row, before, start = _offsets(np.array(shape))
        least = np.full((len(held), _MASK_BITS), np.iinfo(np.int64).max)
        least[row, before] = _least_below(text, start, row, np.array(lo), window, 2 * window - CORE)
        n = [len(d) for d in docs]
        gone = np.repeat(least, n, axis=0) < np.fromiter((x for d in docs for x in d), np.int64, sum(n))[:, None]
        yield from _hits(np.repeat(np.array(block), n), np.fromiter((x for r in refs for x in r), np.int64, sum(n)), gone @ (1 << np.arange(_MASK_BITS)))

    columns = ["h", "shape", "words", "lo", "docs", "refs", "block"]
    short = suffixes.filter("not long_group").select(*columns)
    cut = short.repartition("h").sortWithinPartitions("h").mapInArrow(_subtrees("h", columns, solve, 4 << 20), "block long, refs array<long>")
    return cut.union(_long_groups(suffixes.filter("long_group"), scratch, window, group_bytes))


def _long_groups(suffixes: DataFrame, scratch: Scratch, window: int, group_bytes: int) -> DataFrame:
    """(block, refs) of the windows to remove in long groups: equal suffixes collapse, then prefixes lengthen."""
    suffixes = suffixes.withColumn("key", F.md5(F.concat("words", F.encode(F.col("shape").cast("string"), "utf-8"))))
    distinct = scratch.write(suffixes.groupBy("key").agg(F.min("lo").alias("lo"), F.any_value("shape").alias("shape"), F.any_value("words").alias("words")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape, texts = batch.column(2).to_numpy(), [t.split(b" ") for t in batch.column(3).to_pylist()]
            row, before, start = _offsets(shape)
            cut = [texts[r][s : s + window] for r, s in zip(row.tolist(), start.tolist())]
            prefix = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w[:LONGER])) for w in cut), np.uint64, len(cut))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(1 << before), pa.array(prefix.view(np.int64)), pa.array([b" ".join(w) for w in cut], pa.binary()), batch.column(1).take(at)], names=["key", "bit", "prefix", "words", "lo"])

    nodes = scratch.write(distinct.mapInArrow(windows, "key string, bit long, prefix long, words binary, lo long"))
    longer = scratch.write(nodes.groupBy("prefix").agg(F.sum(F.octet_length("words") + 64).alias("size")).filter(F.col("size") > group_bytes).select("prefix"))
    columns = ["key", "bit", "prefix", "words", "lo"]

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, bit, _, text, lo = zip(*held)
        first = _least_below(text, np.zeros(len(held), np.int64), np.arange(len(held)), np.array(lo), window, window)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bit), pa.array(first)], names=["key", "bit", "first"])

    fits = nodes.join(longer, "prefix", "left_anti").select(*columns).repartition("prefix").sortWithinPartitions("prefix")
    fits = fits.mapInArrow(_subtrees("prefix", columns, solve, 4 << 20), "key string, bit long, first long")
    rest = scratch.write(nodes.join(longer, "prefix", "left_semi").select("key", "bit", "words", "lo"))
    whole = rest.join(rest.groupBy("words").agg(F.min("lo").alias("first")).hint("merge"), "words").select("key", "bit", "first")
    first = scratch.write(fits.union(whole).groupBy("key").agg(F.collect_list(F.struct("bit", "first")).alias("nodes")))  # one per window start
    none = F.lit(0).cast("long")
    each = F.transform(F.arrays_zip("docs", "refs"), lambda x: F.struct(x["refs"].alias("ref"), F.aggregate("nodes", none, lambda acc, w: acc + F.when(w["first"] < x["docs"], w["bit"]).otherwise(none)).alias("bits")))
    hit = suffixes.join(first, "key").select("block", F.explode(F.filter(each, lambda x: x["bits"] != 0)).alias("x"))
    ref = F.shiftleft(F.shiftright("x.ref", _MASK_BITS), _MASK_BITS) + F.col("x.bits")
    return hit.groupBy("block").agg(F.collect_list(ref).alias("refs"))


def _covered(own: int, refs: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of `own` words the windows of one row cover."""
    edge = np.zeros(own + 1, np.int64)
    for pos, mask in refs:
        for o in range(mask.bit_length()):
            if mask >> o & 1:
                edge[pos - o] += 1
                edge[pos - o + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All input rows with n_words, n_removed and, by `digest`, kept_sha256 or (else) the cleaned text and removed_spans.

    The cleaned text is the input unchanged where nothing is removed, else the kept words joined by one space.
    removed_spans holds the [start, end) word ranges, the maximal repeats of `window` words or more and their unions.
    Input columns named like an output column are replaced.
    """
    if not CORE < window <= _MASK_BITS + CORE - 1:
        raise ValueError(f"window must be between {CORE + 1} and {_MASK_BITS + CORE - 1} words")
    ship(__name__)
    scratch = Scratch(docs.sparkSession, "substring")
    docs = replace_columns(docs, ["n_words", "n_removed", "kept_sha256", "removed_spans"])
    docs = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")})
    if digest:
        docs = docs.select(id_col, text_col)
    id_at, text_at, schema = docs.columns.index(id_col), docs.columns.index(text_col), docs.schema
    blocks = scratch.write(_blocks(docs, id_at, text_at, block_bytes))
    copies = _copies(blocks, scratch)
    gone = scratch.write(removed_windows(blocks, copies, scratch, id_at, text_at, window, group_bytes))
    scratch.keep_only(blocks, copies, gone)
    lost = gone.withColumn("copies", F.lit(None).cast("array<int>")).unionByName(copies.select("block", F.lit(None).cast("array<long>").alias("refs"), "copies"))
    keep = [i for i in range(len(schema)) if not (digest and i == text_at)]
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), *([("kept_sha256", T.StringType())] if digest else [("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))])]
    result = T.StructType([schema[i] for i in keep] + [T.StructField(n, t) for n, t in added])

    def finish(own: pa.Table, back: pa.Table) -> pa.Table:
        rows = unblob(own.column("rows")[0].as_py())
        by_row: dict[int, list[tuple[int, int]]] = {}
        late: set[int] = set()
        for refs, copied in zip(back.column("refs").to_pylist(), back.column("copies").to_pylist()):
            late.update(copied or ())
            for ref in refs or ():
                by_row.setdefault(ref >> (_POS_BITS + _MASK_BITS), []).append(((ref >> _MASK_BITS) & ((1 << _POS_BITS) - 1), ref & _MASK))
        n, lost, last, texts = [], [], [], rows.column(text_at).to_pylist()
        for i, text in enumerate(text_bytes(rows.column(text_at))):
            words = text.split()
            if i in late:
                cover = np.full(len(words), len(words) >= window)
            else:
                cover = _covered(len(words), by_row[i], window) if i in by_row else np.zeros(len(words), bool)
            cut = bool(cover.any())
            kept = [w for w, c in zip(words, cover) if not c] if cut else words
            n.append(len(words))
            lost.append(len(words) - len(kept))
            if digest:
                last.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            else:
                step = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]])))
                last.append(step.reshape(-1, 2).tolist())
                if cut:
                    texts[i] = b" ".join(kept).decode()
        columns = [pa.array(texts, pa.string()) if i == text_at else rows.column(i) for i in keep]
        kind = pa.string() if digest else pa.list_(pa.list_(pa.int64()))
        return pa.table([*columns, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(last, kind)], names=result.names)

    return blocks.select("block", "rows").groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(finish, result)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with repeated passages cut out, their columns unchanged; a document of which nothing is left goes.

    n_chars, where present, is that of the cleaned text.
    """
    out = remove_repeats(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), id_col, text_col)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType) for c in docs.columns])
