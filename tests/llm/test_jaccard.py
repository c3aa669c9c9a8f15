"""Jaccard near-dedup against brute force over all pairs, with edited copies, ties, nulls, blanks and large groups."""

import random

import pytest

from loomspan.llm import jaccard
from tests.conftest import DATA


def brute_kept(rows):
    """(id, text) of the rows that stay: the first by id of each group linked by a similarity of at least 0.8."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted((rows[i][0] for i in range(len(rows)) if group[i] == i), key=str)


def edited():
    """Copies at 0 to 4 changed words of 100, half of them well past two bits, and chains of edits."""
    r = random.Random(7)
    rows, n = [(None, "no id here at all"), (None, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a  B"), (5, "a b c")], 10
    passage = [f"p{i}" for i in range(60)]
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        for k in (0, 1, 2, 3, 4, 0):
            copy = list(base)
            for at in r.sample(range(100), k):
                copy[at] = f"e{r.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
        rows.append((n, " ".join([*passage, *base[:20]])))
        n += 1
    step = [f"c{i}" for i in range(100)]
    for k in range(40):  # neighbours are linked, the ends are not
        step[k * 2] = f"d{k}"
        rows.append((n, " ".join(step)))
        n += 1
    return rows


@pytest.mark.parametrize(("bucket", "block"), [(32, 1024), (2, 8), (1, 1024)])
def test_edited_copies_match_brute_force(spark, bucket, block):
    rows = edited()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, s string").repartition(5)
    got = jaccard.keep_one(df, bucket=bucket, block=block)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(rows)
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_stage_removes_edited_copies(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(edited(), "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str) == brute_kept(edited())


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=str)
    assert got == brute_kept([tuple(r) for r in docs.collect()])


def test_bitmaps_bound_the_overlap():
    import numpy as np

    r = np.random.default_rng(3)
    for m, n, k in ((40, 50, 10), (900, 800, 700), (3000, 3000, 5), (1, 1, 1), (0, 3, 0)):
        pool = np.unique(r.integers(0, 2**63, m + n + 9)).astype(np.uint64)
        a, b = pool[:m], pool[m - k : m - k + n]
        apart = sum(int(x).bit_count() for x in (jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64))
        assert k <= (len(a) + len(b) - apart) / 2
    pool = np.unique(r.integers(0, 2**63, 600)).astype(np.uint64)
    long = jaccard.bitmap(pool)
    assert len(long) == 32 and jaccard.bitmap(np.zeros(0, np.uint64)).tolist() == [0] * 16
    bits = np.bincount((pool % np.uint64(1024)).astype(np.int64), minlength=1024) & 1
    assert (long[:16] ^ long[16:]).tolist() == np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def family():
    """400 copies with one to nine changed words of 100, in chains and bursts, and rows of the same words that are far from each other."""
    r = random.Random(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for n in range(400):
        copy = list(base)
        for at in r.sample(range(120), 1 + n % 9 if n % 7 else 1):
            copy[at] = f"e{n}_{at}"
        rows.append((n, " ".join(copy)))
    for n in range(400, 480):  # parts of one passage, half of their words their own
        at = r.randrange(60)
        rows.append((n, " ".join([*base[at : at + 40], *(f"o{n}_{i}" for i in range(r.choice((4, 8, 40))))])))
    return rows


@pytest.mark.parametrize(("bucket", "block"), [(16, 100)])
def test_one_large_group(spark, bucket, block):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((r.doc_id for r in jaccard.keep_one(df, bucket=bucket, block=block).collect()), key=str) == brute_kept(rows)


def test_links_between_match_brute_force():
    import numpy as np

    r = random.Random(3)
    sets = [np.array(sorted({r.randrange(6) for _ in range(4)} | set(range(10, 20 + i % 3))), np.uint64) for i in range(40)]
    rest, ids, roots = np.arange(40) % 3 == 0, list(range(100, 140)), np.arange(40)
    linked = {(a, b) for a in range(40) for b in range(40) if rest[a] and not rest[b] and jaccard.similar(sets[a], sets[b])}
    got = jaccard.links_between(rest, ids, roots, sets)

    def parts(links):
        group = list(range(40))
        for a, b in links:
            group = [group[a] if g == group[b] else g for g in group]
        return {frozenset(i for i in range(40) if group[i] == g) for g in group}

    assert linked and len(got) < 40 and all(u > v for u, v in got)
    assert parts([(u - 100, v - 100) for u, v in got]) == parts(linked)


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline

    class Called(Exception):
        pass

    def called(fps, max_bits, bucket):
        assert fps.columns == ["fp"] and max_bits == 2
        raise Called

    monkeypatch.setattr(jaccard, "fingerprint_links", called)
    with pytest.raises(Called):
        corpus_pipeline.near_dedup(spark, spark.createDataFrame(edited()[:30], "doc_id long, text string"), DATA)
