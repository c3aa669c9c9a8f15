"""Near-duplicates by the Jaccard similarity of word shingles: an exact prefix-filter join, verified links, components.

Words are runs of non-white bytes of the lower-cased (A-Z only) text, a shingle is `SHINGLE` of them (a shorter text is
one shingle), told apart by XXH64. Texts whose sets share at least NUM/DEN of their union are linked.

First come SimHash fingerprints (operator 10): sets whose fingerprints are linked meet, each text once, in cells of at most `block`
sets, where the shingles themselves decide and a cell reports a spanning forest of its links. At that similarity fingerprints may
differ in ten bits or so, more than blocks of 64 bits find, so that an exact path completes the links between the sets that
fingerprints have not connected.
Its candidates: in any one order of all shingles, two sets that are linked share one of the first n - ceil(NUM n / DEN) + 1
of each. The order puts shingles that are frequent in a sample last, so the sample decides the speed only. Equal sets
collapse before the join. Sets that share a shingle of at most `bucket` prefixes are paired; at a hotter shingle every set is paired
with the first one only. Pairs that sizes, places of the shingle and parity bitmaps allow are candidates, and the sets that they
connect meet in such cells too. Candidates between cells whose sets are not connected by then are verified one for each pair of
components, round by round, then all. Last, sets at a hot shingle that are not connected to most of its sets meet blocks of all
of them: first their bitmaps, which leave the sets that may have a link, then the texts of these; only a forest leaves a cell.
Defined cases: null or blank text is the empty set, equal to other empty sets only; null ids come after all others;
repeated rows are rows of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, chunks, dealt, hot_keys, ship, text_bytes
from loomspan.llm.components import connected_components
from loomspan.llm.simhash import _links as fingerprint_links
from loomspan.llm.simhash import fingerprint

SEED, SHINGLE, NUM, DEN, WORDS = 42, 5, 4, 5, 16
SAMPLE, FREQUENT = 16, 1 << 16  # one text in SAMPLE is counted, at most FREQUENT shingles go last


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the shingles that fall on it: two sets of sizes m and n whose bitmaps differ in d bits have at
    most (m + n - d) / 2 shingles in common. At least two bits a shingle, a power of two; a longer map folds into a shorter one."""
    size = max(64 * WORDS, 1 << max(0, 2 * len(h) - 1).bit_length())
    bits = np.bincount((h % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _frequent(rows: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the rows (_row, _text) has most often, ascending, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                found = [shingles(t) for t in text_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    part = rows.filter(F.pmod(F.xxhash64("_row"), F.lit(SAMPLE)) == 0).select("_text")
    counts = part.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    most = scratch.write(counts.orderBy(F.desc("n"), "token").limit(FREQUENT))
    top = sorted((int(np.int64(r.token).view(np.uint64)), r.n) for r in most.collect())
    scratch.drop(most)
    return np.array([t for t, _ in top], np.uint64), np.array([n for _, n in top], np.int64)


def _prefixes(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row (_row, _id, _text): _row, _id, a digest of the shingle set, its size, the prefix in order, its bitmap, and the SimHash of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            for part in chunks(batch, 2):
                digests, sizes, prefixes, maps, prints = [], [], [], [], []
                for text in text_bytes(part.column(2)):
                    h = shingles(text)
                    level = np.zeros(len(h), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        level = np.where(known[at] == h, counts[at], 0)
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(h))
                    maps.append(bitmap(h))
                    prints.append(fingerprint(text))
                    prefixes.append(h[np.lexsort((h, level))][: prefix_length(len(h))].view(np.int64))
                new = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], names=["_row", "_id", "digest", "n", "prefix", "bits", "fp"])

    return rows.select("_row", "_id", "_text").mapInArrow(run, "_row long, _id long, digest binary, n int, prefix array<long>, bits array<long>, fp long")


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and bitmaps (s, n, bits) allow them to be similar."""
    a, b = (maps.select(F.col("s").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}")) for s in "uv")
    both, small = F.col("nu") + F.col("nv"), F.least("nu", "nv")
    sized = pairs.join(a, "u").join(b, "v").filter(small * (NUM + DEN) >= both * NUM)

    def folded(x: str, other: str) -> Column:
        n = F.size(other)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("bu", "bv"), folded("bv", "bu"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return sized.filter((both - apart) * (NUM + DEN) >= 2 * NUM * both).select("u", "v")


def _met(rows: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of rows (token, s, n, pos, root) of different roots whose sizes and places of a common shingle allow similarity."""
    a = rows.select("token", F.col("s").alias("u"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"))
    b = rows.select("token", F.col("s").alias("v"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # of the first shingle in common
    met = a.join(b, "token").filter((F.col("u") > F.col("v")) & (F.col("ra") != F.col("rb")) & (most * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM))
    return met.select("u", "v").distinct()


def possible_pairs(rest: dict[str, np.ndarray], every: dict[str, np.ndarray], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in rest, in every) of pairs of different roots that sizes n, places pos and bitmaps bits (equally long here) allow."""
    for at in range(0, len(rest["n"]), rows):
        part = {k: x[at : at + rows, None] for k, x in rest.items()}
        both = part["n"] + every["n"][None, :]
        left = np.minimum(part["n"] - part["pos"], every["n"] - every["pos"])  # at most in common, by the first shingle in common
        r, e = np.nonzero((part["root"] != every["root"]) & (left * (NUM + DEN) >= both * NUM))
        apart = np.bitwise_count(rest["bits"][at + r] ^ every["bits"][e]).sum(axis=1, dtype=np.int64)
        ok = (both[r, e] - apart) * (NUM + DEN) >= 2 * NUM * both[r, e]
        yield at + r[ok], e[ok]


def _partners_in_cells(sides: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows (token, i, j, s, root, rest) of sides (with n, pos) for which their cell (token, i, j) has a set of the other side and
    of another root that sizes, places and bitmaps allow. No pairs leave a cell."""

    def run(table: pa.Table) -> pa.Table:
        numbers = {c: table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "root")}
        is_rest, flat = table.column("rest").to_numpy(), [np.array(x, np.int64).view(np.uint64) for x in table.column("bits").to_pylist()]
        words, found = np.array([len(x) for x in flat]), np.zeros(len(flat), bool)
        for size in np.unique(words).tolist():
            for left, right in ((size, size), (size, 2 * size), (2 * size, size)):  # sizes that differ more rule a pair out
                sides = [np.flatnonzero(is_rest & (words == left)), np.flatnonzero(~is_rest & (words == right))]
                if len(sides[0]) and len(sides[1]):
                    a, b = ({**{c: x[side] for c, x in numbers.items()}, "bits": _folded([flat[i] for i in side], size)} for side in sides)
                    for r, e in possible_pairs(a, b):
                        found[sides[0][r]] = found[sides[1][e]] = True
        return table.select(["token", "i", "j", "s", "root", "rest"]).filter(pa.array(found))

    rows = sides.join(maps.select("s", "bits"), "s")
    return rows.groupBy("token", "i", "j").applyInArrow(run, "token long, i int, j int, s long, root long, rest boolean")


def links_between(rest: np.ndarray, ids: list[int], roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (u, v), u > v, of similar sets, one of `rest` with one of the others, that connect exactly their parts; roots are parts already."""
    places, every = np.flatnonzero(rest), np.flatnonzero(~rest)
    if not len(places) or not len(every):
        return []
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets], np.int64)
    own = np.split(flat, np.cumsum(size)[:-1])
    others, starts = np.concatenate([own[e] for e in every]), np.cumsum(size[every]) - size[every]
    part, links = roots.copy(), []
    for r in places.tolist():
        marked = np.zeros(len(known), bool)
        marked[own[r]] = True
        both = np.add.reduceat(marked[others], starts, dtype=np.int64)
        for e in every[(DEN * both >= NUM * (size[r] + size[every] - both)) & (part[every] != part[r])].tolist():
            if part[e] != part[r]:
                links.append((max(ids[r], ids[e]), min(ids[r], ids[e])))
                part[part == part[e]] = part[r]
    return links


def _links_between(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of rows (token, i, j, s, root, rest), whose texts meet in their cells."""

    def run(table: pa.Table) -> pa.Table:
        links = links_between(table.column("rest").to_numpy(), table.column("s").to_pylist(), table.column("root").to_numpy(), _shingles_of(table))
        return _links([u for u, _ in links], [v for _, v in links])

    return found.join(texts, "s").groupBy("token", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _folded(maps: list[np.ndarray], words: int) -> np.ndarray:
    return np.stack([m if len(m) == words else m[:words] ^ m[words:] for m in maps]) if maps else np.zeros((0, words), np.uint64)


def forest(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (u, v), u > v, that connect exactly the similar sets; each one joins two parts."""
    known, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    size = np.array([len(s) for s in sets], np.int64)
    part = np.arange(len(sets))
    places: dict[int, list[int]] = defaultdict(list)
    links = []
    for x in np.argsort(size, kind="stable").tolist():
        df = times[np.searchsorted(known, sets[x])]
        prefix = np.lexsort((sets[x], df))[: prefix_length(len(df))]
        near = np.zeros(len(sets), bool)
        for h in sets[x][prefix[df[prefix] > 1]].tolist():  # others occur nowhere else
            near[places[h]] = True
            places[h].append(x)
        near &= (part != part[x]) & (size * DEN >= size[x] * NUM)
        for y in np.flatnonzero(near).tolist():
            if part[y] != part[x] and similar(sets[x], sets[y]):
                links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
                part[part == part[y]] = part[x]
    return links


def _shingles_of(table: pa.Table) -> list[np.ndarray]:
    return [shingles(t) for t in text_bytes(table.column("_text").combine_chunks())]


def _links(u: list[int], v: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _cells(member: DataFrame, texts: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) inside cells of sets of one component (node, component): a large component is dealt into blocks."""
    sized = scratch.write(member.join(member.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("m")).hint("merge"), "component"))
    buckets = max(1, -(-4 * sized.count() // block))
    small = F.col("m") == 1
    cell = sized.select(
        F.col("node").alias("s"), F.when(small, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component")).alias("cell"),
        F.when(small, -1).otherwise(F.pmod(F.xxhash64("node"), F.col("m"))).cast("int").alias("i"),
    )

    def run(table: pa.Table) -> pa.Table:
        links = forest(table.column("s").to_pylist(), _shingles_of(table))
        return _links([u for u, _ in links], [v for _, v in links])

    return cell.join(texts, "s").groupBy("cell", "i").applyInArrow(run, "u long, v long")


def _verified(edges: DataFrame, texts: DataFrame, share: int = 256) -> DataFrame:
    """The edges (u, v) of similar sets. Those of one v are compared in cells of some `share`."""
    sizes = edges.groupBy("v").agg(F.ceil(F.count("*") / share).cast("int").alias("m"))
    cells = edges.join(sizes, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("m")).cast("int").alias("i"))
    wanted = cells.select(F.col("v").alias("cell"), "i", F.col("u").alias("s")).union(cells.select("v", "i", "v").distinct())
    held = wanted.join(texts, "s")

    def run(table: pa.Table) -> pa.Table:
        ids, sets, v = table.column("s").to_pylist(), _shingles_of(table), table.column("cell")[0].as_py()
        own = sets[ids.index(v)]
        found = [u for u, s in zip(ids, sets) if u != v and similar(s, own)]
        return _links(found, [v] * len(found))

    return held.groupBy("cell", "i").applyInArrow(run, "u long, v long")


def _rooted(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """(s, root) of sets (s): their component, themselves where no link is."""
    return nodes.join(member.withColumnRenamed("node", "s"), "s", "left").select("s", F.coalesce("component", "s").alias("root"))


def _across(edges: DataFrame, links: DataFrame, texts: DataFrame, scratch: Scratch, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """links with those of edges (u, v) that connect more, and (node, component) of them: one edge for each pair of components at a time, then all."""
    nodes = scratch.write(edges.select(F.col("u").alias("s")).union(edges.select("v")).distinct())
    for left in range(rounds, -2, -1):
        member = connected_components(links, scratch)
        if left < 0:
            break
        roots = scratch.write(_rooted(nodes, member))
        a, b = (roots.select(F.col("s").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
        edges = scratch.write(edges.select("u", "v").join(a, "u").join(b, "v").filter("ru != rv"))
        if edges.isEmpty():
            break
        tried = edges.select("u", "v")
        if left:
            pair = [F.least("ru", "rv").alias("p"), F.greatest("ru", "rv").alias("q")]
            tried = scratch.write(edges.groupBy(*pair).agg(F.min(F.struct("u", "v")).alias("e")).select("e.u", "e.v"))
        links = scratch.write(links.union(_verified(tried, texts)))
        edges = edges.join(tried, ["u", "v"], "left_anti")
    return links, member


def _by_fingerprint(one: DataFrame, read: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that shingles confirm among the sets (_row, fp) whose SimHash fingerprints are linked."""
    fps = scratch.write(one.select(F.col("_row").alias("s"), "fp"))
    linked = connected_components(fingerprint_links(fps.select("fp").distinct(), 2, 64), scratch)
    grouped = scratch.write(fps.join(linked, fps.fp == linked.node, "left").select(F.col("s").alias("node"), F.coalesce("component", "fp").alias("component")))
    met = grouped.groupBy("component").agg(F.count("*").alias("k")).filter("k > 1").select("component")
    member = scratch.write(grouped.join(met, "component").select("node", "component"))
    texts = scratch.write(read.join(member.select(F.col("node").alias("_row")), "_row", "left_semi").select(F.col("_row").alias("s"), "_text"))
    links = scratch.write(_cells(member, texts, block, scratch).distinct())
    scratch.drop(fps, grouped, member, texts)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 16, block: int = 1024) -> DataFrame:
    """One row of each near-duplicate group: the smallest id; among equal ids the first in order."""
    ship(__name__)
    ship(fingerprint.__module__)
    scratch = Scratch(docs.sparkSession, "jaccard")
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in at.items()], F.monotonically_increasing_id().alias("_row"))
    rows = scratch.write(rows)  # the numbers must not change between two readings
    read = rows.select("_row", F.col(at[id_col]).cast("long").alias("_id"), F.col(at[text_col]).cast("string").alias("_text"))
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_row").alias("c"))
    tagged = _prefixes(read, _frequent(read, scratch)).withColumn("first", order)
    equal = tagged.groupBy("digest").agg(F.min_by(F.struct("first", "n", "prefix", "bits", "fp"), "first").alias("set"))
    one = scratch.write(equal.select("set.*", F.col("set.first.c").alias("_row")))
    sets = scratch.write(one.select("first", F.col("_row").alias("s")))
    keyed = one.select(F.col("_row").alias("s"), "n", F.posexplode("prefix").alias("pos", "token"))
    counts = scratch.write(keyed.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    top = scratch.write(hot_keys(counts, "token", one.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]))
    df = dealt(counts.select("token", F.col("n").alias("df")), top, "token", None)
    spread = scratch.write(dealt(keyed, top, "token", "s").join(df.hint("merge"), ["token", "salt"]).drop("salt"))
    maps = scratch.write(one.select(F.col("_row").alias("s"), "n", "bits"))
    close = _by_fingerprint(one, read, block, scratch)
    scratch.drop(one, counts, top)
    known = scratch.write(_rooted(sets.select("s"), connected_components(close, scratch)))
    shared = scratch.write(spread.join(known, "s"))
    scratch.drop(spread, known)
    rare, hot = shared.filter(F.col("df") <= bucket), shared.filter(F.col("df") > bucket)
    centers = scratch.write(hot.groupBy("token").agg(F.min(F.struct("s", "root")).alias("c")).select("token", F.col("c.s").alias("v"), F.col("c.root").alias("rv")))
    stars = hot.join(centers, "token").filter("root != rv").select(F.greatest("s", "v").alias("u"), F.least("s", "v").alias("v")).distinct()
    edges = scratch.write(_possible(_met(rare).union(stars).distinct(), maps))
    # tables of their own: their sizes, known to the planner, decide whether texts have to be shuffled for them
    used = scratch.write(edges.select(F.col("u").alias("_row")).union(edges.select("v")).union(hot.select("s")).distinct())
    texts = scratch.write(read.join(used, "_row", "left_semi").select(F.col("_row").alias("s"), "_text"))
    links = scratch.write(_cells(connected_components(edges, scratch), texts, block, scratch).union(close).distinct())
    links, member = _across(edges, links, texts, scratch)
    roots = scratch.write(_rooted(hot.select("s").distinct(), member))
    placed = scratch.write(hot.drop("root").join(roots, "s").select("token", "s", "n", "pos", "root"))
    main = placed.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("k"))
    blocks = [F.ceil(x / block).cast("int").alias(m) for x, m in ((F.col("k"), "m"), (F.col("k") - F.col("main.k"), "apart"))]
    main = scratch.write(main.filter("main.k < k").select("token", F.col("main.root").alias("most"), *blocks))
    if not main.isEmpty():
        of = lambda c: F.pmod(F.xxhash64("s"), F.col(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt_out, columns = placed.join(main, "token"), ["token", "i", "j", "s", "n", "pos", "root", "rest"]
        rest = dealt_out.filter("root != most").withColumns({"rest": F.lit(True), "j": of("apart")}).withColumn("i", each("m"))
        every = dealt_out.withColumns({"rest": F.lit(False), "i": of("m")}).withColumn("j", each("apart"))
        found = scratch.write(_partners_in_cells(rest.select(*columns).union(every.select(*columns)), maps))
        member = connected_components(scratch.write(links.union(_links_between(found, texts))), scratch)
    rooted = sets.join(member, sets.s == member.node, "left").select("first", F.coalesce("component", "s").alias("root"))
    kept = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.c").alias("_row")))
    scratch.keep_only(rows, kept)
    return rows.join(kept, "_row", "left_semi").select(*[F.col(i).alias(c) for c, i in at.items()])
