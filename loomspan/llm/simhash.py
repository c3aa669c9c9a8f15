"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Words are runs of non-white bytes of the lower-cased (A-Z only) text. A fingerprint bit is set when more
than half of the XXH64 hashes (seed 42) of the 3-word shingles have it. Fingerprints at `max_bits` or fewer
differing bits are linked.

Candidates: 64 bits are cut into `max_bits` + 2 blocks, so two linked fingerprints agree on at least two of
them; each pair of blocks is one join key. Exact copies collapse to one fingerprint before the join. A key
shared by more than `bucket` fingerprints is never paired: its members meet at the 65 fingerprints within one
bit of them instead (two fingerprints within two bits share such a midpoint, others do not), which is exact
and linear. Defined cases: null or blank text has fingerprint zero; null doc_id rows count as rows of their
group but never name it (the component of a group without any id is null); repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, chunks, free_name, ship, text_bytes
from loomspan.llm.components import connected_components

SEED, SHINGLE = 42, 3


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "_fp") -> DataFrame:
    """`keep` columns (default all) and `name`, the fingerprint as a signed long."""
    ship(__name__)
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != name.lower()]
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "_text")))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(keep)):
                fps = np.array([fingerprint(t) for t in text_bytes(part.column(len(keep)))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], names=schema.names)

    return inner.mapInArrow(run, schema)


def _links(fps: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the fingerprints within max_bits (two at most) of each other."""
    blocks = max_bits + 2
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    keys = []
    for n, pair in enumerate(combinations(range(blocks), 2)):
        mask = sum(masks[i] for i in pair)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed))))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key")
    a = shared.filter(F.col("n") <= bucket).select("key", F.col("fp").alias("u"))
    b = shared.filter(F.col("n") <= bucket).select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    paired = a.join(b, "key").filter((F.col("u") > F.col("v")) & near).select("u", "v")
    flips = [F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)]]
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    met = hot.select("fp", F.explode(F.transform(F.array(*flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    stars = met.groupBy("mid").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)  # at most 65 members
    starred = stars.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).filter("u > v")
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, bucket: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, default all) with `fingerprint` and `component_id`.

    component_id is the smallest id reachable over links, the row's own included. Extra columns pass through;
    input columns named like an output column are replaced.
    """
    if max_bits != 2:
        raise ValueError("blocks and midpoints are laid out for two differing bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    keep = [c for c in (keep if keep is not None else docs.columns) if c in docs.columns and c.lower() not in ("fingerprint", "component_id")]
    own, fp = free_name(docs, "_id"), free_name(docs, "_fp")
    rows = scratch.write(with_fingerprint(docs.withColumn(own, F.col(f"`{id_col}`").cast("long")), text_col, [*keep, own], fp))
    groups = scratch.write(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(own).alias("first_id")))
    member = connected_components(_links(groups.select("fp"), max_bits, bucket), scratch)
    rooted = groups.join(member, groups.fp == member.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.write(rooted)
    named = scratch.write(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_fp = scratch.write(rooted.join(named, "root").select(F.col("fp").alias(fp), "component_id"))
    out = rows.join(by_fp.hint("merge"), fp)  # as many rows as texts: never broadcast
    return out.select(*[F.col(f"`{c}`") for c in keep], F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: the smallest id; among equal ids the first in order.

    Texts are shuffled once, to meet the numbers of the rows that stay.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("_row"))
    rows = scratch.write(rows)  # the numbers must not change between two readings
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    tagged = near_duplicates(rows, at[id_col], at[text_col], keep=["_row", at[id_col]])
    order = F.struct(F.col(at[id_col]).isNull().alias("a"), F.col(at[id_col]).alias("b"), F.col("_row").alias("c"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp:"), "fingerprint"))
    kept = scratch.write(tagged.groupBy(group.alias("g")).agg(F.min(order).alias("first")).select(F.col("first.c").alias("_row")))
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*[F.col(i).alias(c) for c, i in at.items()])
