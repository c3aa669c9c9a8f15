"""Filter interaction audit: what each of five filters removes, in every order, from one bit combination per document.

Failure conditions over whole texts: A under 200 words; B under half of the words distinct; C over 3 % capital letters A-Z;
D holds any of # $ % & * |; E equal to the text of a smaller doc_id, anywhere in the table. E is an existential self-join: a
left-semi join on hash, exact text and a smaller doc_id. Its ids are united with those of the other failures, each document's
bits are summed, combinations are counted per part, and the 120 orders are worked out from at most 32 counts a part.

Texts are shuffled only where their 64-bit hash occurs with two ids. The other side of the join is each such text with
its smallest id, so no pairs of copies arise. A hash of more than a thousandth of all rows (fewer than a thousand can be)
is dealt over several keys.

Defined cases: null text is empty (A fails; equal to other empty texts); a null part is the empty string; null ids fail E
never and make no other row fail; repeated rows count each, and rows of one id do not make each other fail; a document
is good (toxic) if any label row of its id says so; an empty table has no parts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, chunks, dealt, hot_keys, ship, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
BROADCAST_BYTES = 32 << 20
_CAPITALS, _MARKS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for the failure of A, B, C, D; _INNER are bytes that start no code point."""
    words = text.split()
    bits = 1 if len(words) < MIN_WORDS else 0
    bits |= 2 if 100 * len(set(words)) < MIN_DISTINCT * len(words) else 0
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _INNER))
    bits |= 4 if 100 * capitals > MAX_CAPITALS * points else 0
    return bits | (8 if len(text.translate(None, _MARKS)) < len(text) else 0)


def _flagged(rows: DataFrame) -> DataFrame:
    """(uid, id, part, h, bits, text) of rows (uid, id, part, h, again, text); only texts to be compared are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 5):
                texts = text_bytes(part.column(5))
                bits = pa.array([failures(t) for t in texts], pa.int32())
                kept = pa.array([t if again else None for t, again in zip(texts, part.column(4).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], bits, kept], names=["uid", "id", "part", "h", "bits", "text"])

    return rows.select("uid", "id", "part", "h", "again", "text").mapInArrow(run, "uid long, id long, part string, h long, bits int, text binary")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", text_hash: str = "xxhash64(text)", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail. text_hash: SQL over column `text`."""
    ship(__name__)
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.expr(text_hash).cast("long"))
    again = scratch.write(rows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("h", "n"))
    total, repeated = docs.count(), again.count()
    hot = scratch.write(hot_keys(again, "h", total))

    marks = again.select("h", F.lit(True).alias("again"))
    if 16 * repeated <= broadcast_bytes:
        tagged = rows.join(F.broadcast(marks), "h", "left")
    else:
        tagged = dealt(rows, hot, "h", "uid").join(dealt(marks, hot, "h", None).hint("merge"), ["h", "salt"], "left")
    flagged = scratch.write(_flagged(tagged.withColumn("again", F.coalesce("again", F.lit(False)))))

    copies = flagged.filter("text IS NOT NULL").select("uid", "id", "h", "text")
    first = copies.filter("id IS NOT NULL").groupBy("h", "text").agg(F.min("id").alias("lo"))
    left, right = dealt(copies, hot, "h", "uid").alias("l"), dealt(first, hot, "h", None).alias("r")
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.text") == F.col("r.text"))
    failed_e = left.join(right, same & (F.col("r.lo") < F.col("l.id")), "left_semi").select("uid")

    nothing = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("part")]
    united = flagged.select("uid", "id", "part", "bits").union(failed_e.select("uid", *nothing, F.lit(16).alias("bits")))
    masks = united.groupBy("uid").agg(F.max("id").alias("id"), F.max("part").alias("part"), F.sum("bits").alias("mask"))
    by_id = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.filter(f"{id_col} IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = by_id.join(said, "id", "left")
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return known.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(F.sum("n").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part."""
    cells = combinations(docs, labels, **options).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    # a letter's bit by its place in FILTERS
    steps = steps.withColumn("own", F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)"))
    before = f"aggregate(filter(split(substring(filter_order, 1, step - 1), ''), x -> x != ''), 0, (m, x) -> m + shiftleft(1, locate(x, '{FILTERS}') - 1))"
    steps = steps.withColumn("before", F.expr(before))

    def counted(condition: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(filter(cells, x -> {condition}), 0L, (s, x) -> s + x.{what})")

    gone = "(x.mask & own) != 0 AND (x.mask & before) = 0"
    out = steps.select(
        "part", "filter_order", "step", "own",
        counted("(x.mask & (before | own)) = 0").alias("kept"), counted(gone).alias("removed"),
        counted("(x.mask & own) != 0 AND (x.mask & before) != 0").alias("redundant"), counted("x.mask = own").alias("unique_fails"),
        counted(gone, "good").alias("good_lost"), counted(gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
