"""Substring dedup and SimHash against brute force, with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib

import pytest
import xxhash

from loomspan.llm import simhash, substring
from tests.conftest import DATA

PASSAGE = " ".join(f"w{i}" for i in range(40))


def brute_removed(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                g = b" ".join(w[k : k + 13])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[b" ".join(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


EDGE = [
    (5, f"head {PASSAGE} tail"), (1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (4, " \t\n "), (7, PASSAGE), (7, PASSAGE),
    (8, "a " * 13), (9, "a " * 30), (10, " ".join(["x"] * 12)), (11, " ".join(["x"] * 12)), (12, f"a\u00a0b \u2003{PASSAGE}\x0bz"),
    (13, "long " * 30_000 + PASSAGE),
]


@pytest.mark.parametrize("group_bytes", [1 << 18, 3000, 1])
def test_removal_matches_brute_force(spark, group_bytes):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    got = substring.remove_repeats(df, digest=True, group_bytes=group_bytes, block_bytes=2000).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_removed(EDGE)


def test_removal_on_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = substring.remove_repeats(df, digest=True, group_bytes=2000, block_bytes=50_000).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_removed([tuple(r) for r in df.collect()])


def test_deep_nodes():
    assert [*substring.deep_nodes([(b"a b c", 1, 0), (b"a b d", 2, 1)], 2)] == [(1, 2, [0, 1])]
    assert [*substring.deep_nodes([(b"a b c", 1, 0), (b"a b d", 2, 1)], 3)] == [] == [*substring.deep_nodes([], 3)]
    rows = [(b"x y z", 9, 0), (b"x y", 4, 1), (b"q", 1, 2), (b"x y z w", 7, 3), (b"x yz", 2, 4), (b"x y\x01", 3, 5)]
    assert [(lo, hi, sorted(at)) for lo, hi, at in substring.deep_nodes(rows, 2)] == [(4, 9, [0, 1, 3])]
    assert [(lo, hi, sorted(at)) for lo, hi, at in substring.deep_nodes(rows, 3)] == [(7, 9, [0, 3])]


def test_removal_keeps_columns_and_spans(spark):
    df = spark.createDataFrame([(1, PASSAGE, "a"), (2, f"new start {PASSAGE} new end", "b")], "doc_id int, text string, n_words string").withColumnRenamed("n_words", "N_Words")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert got[2].text == "new start new end" and got[2].removed_spans == [[2, 42]] and got[2].n_words == 44
    assert got[1].text == PASSAGE and got[1].removed_spans == []
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_clean_documents(spark):
    df = spark.createDataFrame([(1, PASSAGE, 9), (2, f"new  start {PASSAGE} new", 9), (3, PASSAGE, 9), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.clean_documents(df).collect()}
    assert got == {1: (PASSAGE, 9), 2: ("new start new", 13), 4: (None, 0)}


def brute_components(rows):
    fps = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps)], key=str)


@pytest.mark.parametrize("bucket", [64, 1])
def test_components_match_brute_force(spark, bucket):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (903, "ONE"), (None, "nobody else has this")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    got = simhash.near_duplicates(df, keep=["doc_id"], bucket=bucket).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows)


def test_simhash_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b c", "i", "f", "t", 5), (1, "a b c", "i", "f", "t", 5), (2, "x " * 300_000, "i", "f", "t", 5)], "doc_id long, text string, _id string, _fp string, _text string, Fingerprint int")
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "_id", "_fp", "_text", "fingerprint", "component_id"]
    assert sorted((r.doc_id, r._id, r._fp, r._text, r.component_id) for r in got.collect()) == [(1, "i", "f", "t", 1), (1, "i", "f", "t", 1), (2, "i", "f", "t", 2)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_are_exact_for_close_fingerprints(spark):
    fps = [0, 1, 3, 7, 15, 1 << 63 if False else -(1 << 63), 5 << 40, (5 << 40) ^ 3, (5 << 40) ^ 12, *(1 << i for i in range(3, 63))]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    for bucket in (64, 2):
        links = {tuple(r) for r in simhash._links(df, 2, bucket).collect()}
        assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in links)
        near = {(u, v) for u in fps for v in fps if u > v and ((u ^ v) & (2**64 - 1)).bit_count() <= 2}
        reach = {}

        def root(x, reach=reach):
            while reach.get(x, x) != x:
                x = reach[x]
            return x

        for u, v in links:
            a, b = root(u), root(v)
            reach[max(a, b)] = min(a, b)
        assert all(root(u) == root(v) for u, v in near)


def test_keep_one(spark):
    a, b = PASSAGE, " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(3, a, "p"), (1, a, "q"), (1, a, "r"), (2, b, "s"), (None, b, "t")], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == [(1, a), (2, b)] and simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.keep_one(df).columns == df.columns
