"""Language-model scoring: stupid backoff of orders 1 to 3 from relational counts, leaving each document out.

Words are runs of non-white bytes, all of them: there is no vocabulary and no unknown word. Texts are packed into blocks
of rows, and each block explodes into its distinct n-grams and their counts there, a gram as a 64-bit hash of its words
and order. Grams go to buckets by their first bits, in slices (bucket, block) of sorted grams; a bucket holds about `bucket_grams`
whatever the corpus, and a gram of every text is one entry for each block, not for each occurrence. A bucket sums its grams'
counts and sends each slice the sums that other blocks add to; each document's scores are summed in its block.
Trigrams follow the words and bigrams, and only where another document has both bigrams: elsewhere no trigram can be shared.

With c'(x) the occurrences of x outside the document (by its row) and N' the words outside it, a word w after u, t scores

    c'(t u w) / c'(t u)                if another document has t u w, else
    backoff * c'(u w) / c'(u)          if another has u w, else
    backoff**2 * c'(w) / N'            if another has w, else
    backoff**3 / N'                    (N' one at least)

The first word starts at c'(w) / N', the second at c'(u w) / c'(u), with one factor backoff for each step down from there.
Two different n-grams of one hash would share their count: 2**-64 a pair.

Defined cases: null and blank texts have no words (scores null); repeated rows are rows of their own and count for each
other; ids may be null; a text of any length is scored whole, alone in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import SLICES, Scratch, answered, blob, bucket_bits, chunks, joined, ship, sliced, text_bytes, unblob

BACKOFF, BLOCK_BYTES, BUCKET_GRAMS = 0.4, 4 << 20, 1 << 22
_MIX, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SCORED = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, n_unseen long, log_score double"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Compressed blocks of (doc_id, text) rows, with the number of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words = sum(len(t.split()) for t in text_bytes(whole.column(1)))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([blob(whole)]), pa.array([words])], names=["block", "rows", "words"])

        for batch in batches:
            for part in chunks(batch, 1, block_bytes, 1 << 16):
                if held and size + part.nbytes > block_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield out()

    return docs.mapInArrow(run, "block long, rows binary, words long")


class Grams:
    """The n-grams of a block's rows: per position the row, and per order the hash of the gram that ends there."""

    def __init__(self, rows: pa.Table):
        words = [t.split() for t in text_bytes(rows.column(1))]
        self.ids, self.lens = rows.column(0).to_pylist(), np.array([len(w) for w in words], np.int64)
        self.n = int(self.lens.sum())
        self.row = np.repeat(np.arange(len(words)), self.lens)
        h = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, self.n)
        self.place = np.arange(self.n) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)  # of the word in its row
        two, three = h.copy(), h.copy()
        two[1:] = (h[:-1] * _MIX ^ h[1:]) * _MUL + np.uint64(2)
        three[2:] = (two[1:-1] * _MIX ^ h[2:]) * _MUL + np.uint64(3)
        self.has2, self.has3 = np.flatnonzero(self.place >= 1), np.flatnonzero(self.place >= 2)
        self.one, (self.two, self.three) = h, (two[self.has2], three[self.has3])

    def low(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, their place for each word, their n; the same of the bigrams."""
        return (*np.unique(self.one, return_inverse=True, return_counts=True), *np.unique(self.two, return_inverse=True, return_counts=True))

    def own(self, rows: np.ndarray, place: np.ndarray, kinds: int) -> np.ndarray:
        """How often each one's gram occurs in its own row."""
        _, at, n = np.unique(rows * max(1, kinds) + place, return_inverse=True, return_counts=True)
        return n[at]

    def shared(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences outside the row, of each bigram."""
        return c[at] - self.own(self.row[self.has2], at, len(c))

    def open_trigrams(self, left2: np.ndarray) -> np.ndarray:
        """Positions in has3 whose two bigrams other rows have too."""
        at2 = np.zeros(self.n, np.int64)
        at2[self.has2] = left2
        return np.flatnonzero((at2[self.has3] > 0) & (at2[self.has3 - 1] > 0))


def _filled(n: np.ndarray, back: pa.Table) -> np.ndarray:
    """Counts of a block's grams: those that came back, else the block's own."""
    out = n.astype(np.int64)
    for start, data in zip(back.column("start").to_pylist(), back.column("c").to_pylist()):
        c = np.frombuffer(data, "<i8")
        part = out[start : start + len(c)]
        np.copyto(part, c, where=c > 0)
    return out


def _words_and_bigrams(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u1, _, n1, u2, _, n2 = Grams(unblob(rows)).low()
                yield sliced(block, u1, n1, bits)
                yield sliced(block, u2, n2, bits, len(u1))

    return blocks.select("block", "rows").mapInArrow(run, SLICES)


def _counted(slices: DataFrame) -> DataFrame:
    """(block, start, c) for every slice: its grams' counts over all blocks, 0 where no other block has the gram."""

    def run(table: pa.Table) -> pa.Table:
        grams, n, edge = joined(table)
        _, at = np.unique(grams, return_inverse=True)
        c = np.bincount(at, weights=n).astype(np.int64)[at]
        c[c == n] = 0
        return answered(table, c, edge, "c")

    return slices.groupBy("bucket").applyInArrow(run, "block long, start int, c binary")


def _low_counts(grams: Grams, back: pa.Table) -> tuple:
    """Per order: counts of the distinct grams, and each position's place among them."""
    u1, at1, n1, _, at2, n2 = grams.low()
    c = _filled(np.concatenate([n1, n2]), back)
    return c[: len(u1)], at1, c[len(u1) :], at2


def _trigrams(blocks: DataFrame, low: DataFrame, bits: int) -> DataFrame:
    def run(key: tuple, own: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(unblob(own.column("rows")[0].as_py()))
        _, _, c2, at2 = _low_counts(grams, back)
        u3, n3 = np.unique(grams.three[grams.open_trigrams(grams.shared(c2, at2))], return_counts=True)
        return pa.Table.from_batches([sliced(key[0].as_py(), u3, n3, bits)])

    return blocks.select("block", "rows").groupBy("block").cogroup(low.groupBy("block")).applyInArrow(run, SLICES)


def _scores(blocks: DataFrame, counts: DataFrame, total: int, backoff: float) -> DataFrame:
    """Per row of each block its sums; counts holds (block, start, c, high), high for trigrams."""

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(unblob(own.column("rows")[0].as_py()))
        high = back.column("high").to_numpy(zero_copy_only=False).astype(bool)
        c1, at1, c2, at2 = _low_counts(grams, back.filter(pa.array(~high)))
        left1 = c1[at1] - grams.own(grams.row, at1, len(c1))
        some2 = grams.shared(c2, at2)
        left2, left3 = np.zeros(grams.n, np.int64), np.zeros(grams.n, np.int64)
        left2[grams.has2] = some2
        spots = grams.open_trigrams(some2)
        u3, at3, n3 = np.unique(grams.three[spots], return_inverse=True, return_counts=True)
        c3 = _filled(n3, back.filter(pa.array(high)))
        left3[grams.has3[spots]] = c3[at3] - grams.own(grams.row[grams.has3[spots]], at3, len(u3))
        before1, before2 = np.zeros(grams.n, np.int64), np.zeros(grams.n, np.int64)
        before1[1:], before2[1:] = left1[:-1], left2[:-1]  # of the context; read only where a row has one
        rest = np.maximum(1, total - grams.lens)[grams.row]
        level = np.where(left3 > 0, 3, np.where(left2 > 0, 2, np.where(left1 > 0, 1, 0)))
        over = np.choose(level, [np.ones(grams.n, np.int64), left1, left2, left3])
        under = np.choose(level, [rest, rest, np.maximum(1, before1), np.maximum(1, before2)])
        logs = np.log(over / under) + np.log(backoff) * (np.minimum(grams.place + 1, 3) - level)
        rows = len(grams.ids)
        sums = [np.bincount(grams.row, weights=level == k, minlength=rows).astype(np.int64) for k in (3, 2, 1, 0)]
        scored = pa.array(np.bincount(grams.row, weights=logs, minlength=rows), mask=grams.lens == 0)
        return pa.table([pa.array(grams.ids, pa.int64()), pa.array(grams.lens), *map(pa.array, sums), scored], names=["doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "n_unseen", "log_score"])

    return blocks.select("block", "rows").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, _SCORED)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """Per document row: doc_id, n_words, words scored by order (n_trigram, n_bigram, n_unigram, n_unseen), log_score and
    mean_log_score (log_score / n_words). Other input columns are not read."""
    ship(__name__)
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.write(_blocks(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), block_bytes))
    total = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    low = scratch.write(_counted(_words_and_bigrams(blocks, bucket_bits(2 * total, bucket_grams, tasks))))
    high = scratch.write(_counted(_trigrams(blocks, low, bucket_bits(total, bucket_grams, tasks))))
    both = low.withColumn("high", F.lit(False)).union(high.withColumn("high", F.lit(True)))
    return _scores(blocks, both, total, backoff).withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
