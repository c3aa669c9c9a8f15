"""Quality rules from tokeniser fertility: how public vocabularies split a text tells prose from junk.

Two vocabularies split every word of the whole text: pieces with byte fallback, and byte-level pairs. Measured per document:
characters per token (fertility) and the share of byte-fallback tokens (byte tokens; single bytes of longer characters) by
either, and by the first the share of tokens without a letter or digit, the Shannon entropy of the tokens in bits and their
min-entropy (of the most frequent token). A document is rejected outside the bands of its script (BANDS); the fertility bands are
relative to the median of its language over all documents, exact to a thousandth.

Base counts (words are runs of non-white bytes): word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed with
fewer than `min_words` words or more than half of them in repeated 3-word windows. kept is false if base_failed.
Defined cases: null text counts as empty and fails; a byte sequence that is not UTF-8 is read as replacement characters; null
language is a language of its own; repeated rows are rows of their own; texts of any length are measured whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, chunks, free_name, ship, text_bytes

PIECES, PAIRS, MIN_WORDS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", 50

# Fixed values, per script: least and most fertility as a multiple of the language's median; most byte-fallback share; most
# share of tokens without letter or digit; least Shannon entropy and least min-entropy, in bits.
BANDS = {
    "latin": (0.6, 1.6, 0.20, 0.165, 4.5, 3.2),
    "cyrillic": (0.5, 1.8, 0.50, 0.20, 4.0, 2.8),
    "greek": (0.5, 1.8, 0.60, 0.20, 4.0, 2.8),
    "other": (0.4, 2.0, 1.00, 0.30, 3.5, 1.8),
    "none": (0.4, 2.0, 0.20, 0.50, 3.5, 2.8),
}
_SYMBOLS, _WHITE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["script", "n_tokens", "fertility", "byte_share", "mark_share", "entropy", "min_entropy", "n_pairs", "pair_fertility", "pair_byte_share"]


class Tokens:
    """The token ids of numbered words, one word after the other."""

    def __init__(self) -> None:
        self.ids, self.ends = array("i"), array("q", [0])

    def add(self, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has."""
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.int32)
        start, n = ends[words], ends[words + 1] - ends[words]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return ids[at], n


class Splitter:
    """Numbers of words, and their tokens by both vocabularies; remembers a bounded number of words between chunks."""

    def __init__(self, pieces: str | None = None, pairs: str | None = None, remember: int = 400_000):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        n = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.mark = np.array([not any(c.isalnum() for c in self.model.id_to_piece(i)) for i in range(n)]) & ~self.byte
        with open(pairs or public_tokenizers.path(PAIRS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pair_byte = np.zeros(max(ranks.values()) + 1, bool)
        self.pair_byte[[r for token, r in ranks.items() if len(token) == 1 and token[0] >= 128]] = True
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.piece_tokens, self.pair_tokens = Tokens(), Tokens()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.remember:
            self.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            texts = [w.decode("utf-8", "replace") for w in part]
            for w, t, ids in zip(part, texts, self.model.encode(texts, num_threads=1)):
                self.known[w] = len(self.known)
                self.piece_tokens.add(ids)
                self.pair_tokens.add(self.pairs.encode_ordinary(" " + t))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


_SPLITTERS: dict[tuple, Splitter] = {}


def splitter(pieces: str | None = None, pairs: str | None = None) -> Splitter:
    """The worker's splitter, kept from task to task."""
    if (pieces, pairs) not in _SPLITTERS:
        _SPLITTERS[pieces, pairs] = Splitter(pieces, pairs)
    return _SPLITTERS[pieces, pairs]


def script_of(text: str) -> str:
    """The script of most letters, of those that BANDS tells apart."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:4096])) or any(map(str.isalpha, text)) else "none"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ascii_letters = int((((codes | 32) >= 97) & ((codes | 32) <= 122)).sum())
    latin = ascii_letters + int(((codes >= 0xC0) & (codes < 0x250)).sum())
    counts = {
        "latin": latin,
        "greek": int(((codes >= 0x370) & (codes < 0x400)).sum()),
        "cyrillic": int(((codes >= 0x400) & (codes < 0x530)).sum()),
        "other": int(((codes >= 0x530) & (codes < 0x2000) | (codes >= 0x2C00) & (codes < 0xE000) | (codes >= 0xF900) & (codes < 0xFE00) | (codes >= 0x20000)).sum()),
    }
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def repeated_words(words: np.ndarray, doc: np.ndarray, size: int = 3) -> np.ndarray:
    """Whether each word (a number, of a document) is inside a `size`-word window that its document has twice or more."""
    n = len(words) - size + 1
    out = np.zeros(len(words), bool)
    if n < 2:
        return out
    kinds, window = int(words.max()) + 1, words[:n]
    for j in range(1, size):
        if j > 1 and kinds > 1 << 21:
            window = np.unique(window, return_inverse=True)[1]  # keeps the product below 2**63
        window = window * kinds + words[j : n + j]
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    order = inside[np.lexsort((window[inside], doc[inside]))]
    same = (window[order[1:]] == window[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    for j in range(size):
        out[again + j] = True
    return out


def _line_copies(text: bytes) -> int:
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    return dup


def measure(texts: list[bytes], split: Splitter) -> list:
    """The base counts and the measures of some texts, a column each."""
    words = [t.split() for t in texts]
    lens, docs = np.array([len(w) for w in words], np.int64), len(texts)
    doc = np.repeat(np.arange(docs), lens)
    number = split.numbers([x for w in words for x in w])
    strings = [None if t.isascii() else t.decode("utf-8", "replace") for t in texts]
    chars = np.array([(len(t) if s is None else len(s)) - len(t) + len(t.translate(None, _WHITE)) for t, s in zip(texts, strings)], np.int64)
    symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]

    def per_doc(of: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=flags, minlength=docs)

    repeats = per_doc(doc, repeated_words(number, doc)).astype(np.int64)
    ids, n = split.piece_tokens.of(number)
    of = np.repeat(doc, n)
    tokens = np.bincount(of, minlength=docs)
    some = np.maximum(tokens, 1)
    kinds, times = np.unique(of * len(split.byte) + ids, return_counts=True)
    owner = kinds // len(split.byte)
    share = times / some[owner]
    top = np.zeros(docs)
    np.maximum.at(top, owner, share)
    entropy = per_doc(owner, -share * np.log2(share))
    pairs, pn = split.pair_tokens.of(number)
    pair_of = np.repeat(doc, pn)
    pair_n = np.bincount(pair_of, minlength=docs)
    pair_some = np.maximum(pair_n, 1)
    scripts = [script_of(t.decode("ascii") if s is None else s) if k else "none" for t, s, k in zip(texts, strings, lens.tolist())]
    return [
        lens, chars, symbols, [_line_copies(t) for t in texts], repeats, scripts, tokens, np.where(tokens > 0, chars / some, 0.0),
        per_doc(of, split.byte[ids]) / some, per_doc(of, split.mark[ids]) / some, entropy, np.where(tokens > 0, -np.log2(np.maximum(top, 1e-300)), 0.0),
        pair_n, np.where(pair_n > 0, chars / pair_some, 0.0), per_doc(pair_of, split.pair_byte[pairs]) / pair_some,
    ]


def measures(docs: DataFrame, text_col: str = "text", pieces: str | None = None, pairs: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default all) with the base counts and the measures; input columns of these names are replaced."""
    ship(__name__)
    new = [*BASE, *MEASURES]
    taken = {c.lower() for c in new}
    keep = [c for c in (keep if keep is not None else docs.columns) if c in docs.columns and c.lower() not in taken]
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "_text")))
    types = [T.LongType()] * 5 + [T.StringType(), T.LongType(), *[T.DoubleType()] * 5, T.LongType(), *[T.DoubleType()] * 2]
    schema = T.StructType([*inner.schema.fields[:-1], *[T.StructField(c, t) for c, t in zip(new, types)]])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 5 + [pa.int64()] + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pieces, pairs)
        for batch in batches:
            for part in chunks(batch, len(keep)):
                got = measure(text_bytes(part.column(len(keep))), split)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, k) for c, k in zip(got, kinds))], names=schema.names)

    return inner.mapInArrow(run, schema)


def _medians(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, m_column): the lower median to a thousandth, from counts of thousandths: one group is never in one task."""
    counts = rows.groupBy(by, F.round(F.col(column) * 1000).cast("long").alias("x")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(by)
    upto = F.sum("n").over(over.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "whole": F.sum("n").over(over)})
    return ranked.filter(2 * F.col("upto") >= F.col("whole")).groupBy(by).agg((F.min("x") / 1000.0).alias(f"m_{column}"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, bands: dict[str, tuple] = BANDS, pieces: str | None = None, pairs: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default all) with base counts, measures, base_failed, rejected_by (band names) and kept.

    Input columns named like an output column are replaced.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = [*BASE, *MEASURES, "base_failed", "rejected_by", "kept"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c in docs.columns and c.lower() not in own]
    lang, of = free_name(docs, "_lang"), free_name(docs, "_of")
    tagged = docs.withColumn(lang, F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")) if lang_col in docs.columns else F.lit(""))
    rows = scratch.write(measures(tagged, text_col, pieces, pairs, [*keep, lang]))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fair = rows.filter(~failed)
    usual = _medians(fair, lang, "fertility").join(_medians(fair, lang, "pair_fertility"), lang).select(F.col(lang).alias(of), F.struct("m_fertility", "m_pair_fertility").alias(free_name(docs, "_usual")))
    usual = scratch.write(usual)
    rows = rows.withColumn("base_failed", failed).join(usual, F.col(lang) == F.col(of), "left")
    medians = F.col(usual.columns[1])

    def limit(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("script") == s, F.lit(float(b[i]))) for s, b in bands.items()])

    relative, pair_relative = F.col("fertility") / medians["m_fertility"], F.col("pair_fertility") / medians["m_pair_fertility"]
    out = [
        ("fertility", (relative < limit(0)) | (relative > limit(1))),
        ("pair_fertility", (pair_relative < limit(0)) | (pair_relative > limit(1))),
        ("byte_share", F.col("byte_share") > limit(2)),
        ("mark_share", F.col("mark_share") > limit(3)),
        ("entropy", F.col("entropy") < limit(4)),
        ("min_entropy", F.col("min_entropy") < limit(5)),
    ]
    rejected = F.concat_ws(",", *[F.when(hit, F.lit(name)) for name, hit in out])
    judged = rows.select(*[F.col(f"`{c}`") for c in keep], *BASE, *MEASURES, "base_failed", rejected.alias("rejected_by"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents that pass, with their own columns."""
    columns = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    inner = docs.select(*columns, F.col(text_col).alias("_t"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")).alias("_l"))
    kept = judge(inner, "_t", "_l", keep=[f"_in{i}" for i in range(len(columns))]).filter("kept")
    return kept.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
