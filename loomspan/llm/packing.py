"""Best-fit packing of documents into sequences of bounded length, by hierarchical residual packing.

Every partition cuts its documents into pieces and packs them best-fit, longest first, `fan` pieces at a time. Full bins are
done; the others become items of the next round, are dealt to fewer tasks, and are packed again, and so on up the
tree. A round takes only bins with room for the smallest open one, the others are final; its tasks hold `fan` items or so,
and no task grows with the input. The rounds end when one task has held all that was left or no two bins fit together.

A document is its token ids and then the end id; only documents longer than `capacity` are cut. Defined cases: null
text is the end id alone; repeated rows are packed as rows of their own; null ids are carried through.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, chunks, ship

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"

# White space to str.split() but not to the vocabulary's pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_APOSTROPHE = re.compile(r"'(?:s|t|re|ve|m|ll|d)", re.I)


class Encoder(dict):
    """Token ids of whole texts as little-endian uint32 bytes; the dict remembers a bounded number of words.

    The vocabulary drops white space and no merge crosses it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str | None = None, remember: int = 1_000_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.remember = remember
        self.marks: dict[str, bytes] = {"": b""}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        self.as_bytes = {**{b: b for b in printable}, **{b: 256 + i for i, b in enumerate(other)}}  # byte-level alphabet

    def _merged(self, run: str) -> bytes:
        """Merges alone, for a run that needs no splitting."""
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.as_bytes)
        return np.array([t.id for t in self.full.model.tokenize(run)], "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        m = _WORD.fullmatch(word)
        if not m or _APOSTROPHE.match(m[2]):
            got = np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            if m[2] not in self.marks:
                self.marks[m[2]] = self._merged(m[2])
            got = self._merged(m[1].lower()) + self.marks[m[2]]
        self[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > self.remember:
            self.clear()
            self.marks = {"": b""}
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins (tokens used, item numbers) of a best-fit packing of (length, number) in the order given."""
    bins: list[tuple[int, list[int]]] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), ordered
    for length, number in items:
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
            used, held = bins[b]
            held.append(number)
            bins[b] = (used + length, held)
        else:
            free, b = capacity, len(bins)
            bins.append((length, [number]))
        if free - length:
            insort(room, (free - length, b))
    return bins


def _pack(keys: list, lengths: np.ndarray, capacity: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each item its bin's id and its offset there; of each bin its id and tokens. Longest first, ties by key."""
    order = sorted(range(len(keys)), key=lambda i: (-int(lengths[i]), keys[i]))
    bins = best_fit([(int(lengths[i]), i) for i in order], capacity)
    bin_of, offset = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for b, (_, held) in enumerate(bins):
        at = 0
        for i in held:
            bin_of[i], offset[i] = base + b, at
            at += int(lengths[i])
    return bin_of, offset, np.arange(base, base + len(bins), dtype=np.int64), np.array([u for u, _ in bins], np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, used long"


def _first_round(docs: DataFrame, capacity: int, fan: int, path: str | None) -> DataFrame:
    """Pieces of each document with their bin in a packing of the partition; used is set on one piece of each bin."""
    ship(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers  # noqa: F401  fails early where the vocabularies are missing

        encode, rows, base = encoder(path), [], TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                        if len(rows) == fan:
                            out, bins = packed(rows, base)
                            yield out
                            rows, base = [], base + bins
        if rows:
            yield packed(rows, base)[0]

    def packed(rows: list[tuple], base: int) -> tuple[pa.RecordBatch, int]:
        keys = [(r[0] is None, r[0] or 0, *r[1:]) for r in rows]
        doc_ids, pieces, starts, lengths, crcs = zip(*rows)
        lengths = np.array(lengths, np.int64)
        bin_of, offset, ids, used = _pack(keys, lengths, capacity, base)
        tokens = used[bin_of - base]
        columns = [pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(bin_of), pa.array(offset), pa.array(np.where(offset == 0, tokens, -1))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "used"]), len(ids)

    return docs.mapInArrow(run, PIECES)


def _next_round(bins: DataFrame, capacity: int, level: int, tasks: int) -> DataFrame:
    """Underfull bins as items: each one's new bin and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        keys, lengths = [k for b in got for k in b.column(0).to_pylist()], np.concatenate([b.column(1).to_numpy() for b in got])
        base = (level << 57) + (TaskContext.get().partitionId() << 33)
        bin_of, offset, ids, used = _pack(keys, lengths, capacity, base)
        tokens = used[bin_of - ids[0]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bin_of), pa.array(offset), pa.array(np.where(offset == 0, tokens, -1))], names=["bin", "into", "shift", "used"])

    return bins.repartition(tasks, F.xxhash64(F.lit(level), "bin")).mapInArrow(run, "bin long, into long, shift long, used long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, fan: int = 50_000, rounds: int = 30, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset); other input columns are not read.

    Every round but the last merges bins wherever two of its items fit; `rounds` bounds their number.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = scratch.write(_first_round(source, capacity, fan, vocabulary))
    open_bins = scratch.write(pieces.filter((F.col("used") >= 0) & (F.col("used") < capacity)).select("bin", "used"))
    maps: list[DataFrame] = []
    while len(maps) < rounds:
        least = open_bins.agg(F.min("used")).first()[0]
        fitting = open_bins.filter(F.col("used") <= capacity - (least or 0))
        left = fitting.count()
        if left < 2:
            break
        tasks = -(-left // fan)
        moved = scratch.write(_next_round(fitting, capacity, len(maps) + 1, tasks))
        maps.append(moved)
        if tasks == 1:
            break
        open_bins = moved.filter((F.col("used") >= 0) & (F.col("used") < capacity)).select(F.col("into").alias("bin"), "used")
    if maps:
        whole = maps[-1].select("bin", "into", "shift")
        for earlier in reversed(maps[:-1]):
            later = whole.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            direct = earlier.join(later, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            whole = scratch.write(direct)
        pieces = pieces.join(whole, "bin", "left")
        place = [F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")]
    else:
        place = [F.col("bin").alias("sequence_id"), F.col("at").alias("offset")]
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *place)
