"""Mixing, top-k search, packing, LM scores and the pipeline against brute force and on edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspan.llm import lm, mixing, packing, topk
from tests.conftest import DATA


def brute_top(rows, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [20, 3])
def test_top_k_matches_brute_force(spark, k):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(150).collect()]
    same = [0.5] * 64
    rows += [(2000 + i, same) for i in range(60)] + [(3000, None), (3020, [1.0, None] + [0.0] * 62), (3040, [float("nan")] * 64), (3060, [float("inf")] * 64), (None, same), (4000, [1.0, 2.0]), (4001, [3.0, 1.0]), (5000, []), (5020, [1e4] * 64)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, k=k, query_rows=4, candidate_rows=16, group_rows=64).collect())
    assert got == brute_top(rows, k)


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.limit(1)).count() == 0


def test_top_k_large_components(spark):
    big = [(0, [4e7, 1.0]), (20, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [-4e7, 3.0]), (40, [3e7, 3e7]), (3, [4.6e7, 0.5]), (4, [1e-320, -1e-320])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, k=3).collect()) == brute_top(big, 3)
    wide = [(0, [1e15, 1.0]), (1, [1.0, 1e15]), (20, [1.0, 1.0]), (2, [-1.0, 1.0])]  # 65 bits by lengths; no pair overflows
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, k=2).collect()) == brute_top(wide, 2)


@pytest.mark.parametrize("rows", [[(0, [3e7] * 64), (1, [3e7] * 64)], [(0, [1e300]), (1, [1.0])]])
def test_top_k_overflow_is_an_error(spark, rows):
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, "it's we'll 'S don't! x'y <|endoftext|> É́   İ ß STRASSE _a_ 3½ 中文​"), (903, "word " * 9000), (None, "no id"), (904, "same"), (904, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int").repartition(5)
    got = packing.pack_documents(df, fan=20).collect()
    encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, t in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want[(i, n, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 4096 + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_unmergeable_bins(spark):
    df = spark.createDataFrame([(i, "a " * 2600) for i in range(30)], "doc_id long, text string").repartition(6)
    got = packing.pack_documents(df, fan=4).collect()
    assert len({r.sequence_id for r in got}) == 30


def test_packing_fills_every_gap(spark):
    rows = [(i, "a " * 4092) for i in range(40)] + [(100 + i, None) for i in range(120)]  # 4,093 tokens, and 1
    for parts, fan, most in ((1, 1000, 40), (8, 7, 42)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = packing.pack_documents(df, fan=fan).collect()
        assert len(got) == 160 and 40 <= len({r.sequence_id for r in got}) <= most


def test_best_fit_prefers_the_tightest_bin():
    assert packing.best_fit([(6, 0), (5, 1), (4, 2), (3, 3), (2, 4)], 10) == [(10, [0, 2]), (10, [1, 3, 4])]


def brute_scores(rows, backoff=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in words]
    whole = sum(grams, Counter())
    out = []
    for (doc_id, _), w, own in zip(rows, words, grams):
        left = lambda *g, own=own: whole[g] - own[g]
        rest, levels, score = max(1, sum(map(len, words)) - len(w)), Counter(), 0.0
        for i, x in enumerate(w):
            if i > 1 and left(w[i - 2], w[i - 1], x):
                k, s = 3, left(w[i - 2], w[i - 1], x) / left(w[i - 2], w[i - 1])
            elif i > 0 and left(w[i - 1], x):
                k, s = 2, left(w[i - 1], x) / left(w[i - 1])
            else:
                k = int(left(x) > 0)
                s = max(1, left(x)) / rest
            levels[k] += 1
            score += math.log(s * backoff ** (min(i + 1, 3) - k))
        out.append((doc_id, len(w), *(levels[k] for k in (3, 2, 1, 0)), round(score, 6) if w else None))
    return sorted(out, key=str)


LM_ROWS = [(1, "a b a b"), (2, "a b c"), (3, None), (4, "a"), (None, "b c"), (5, "x y"), (6, " \n"), (7, "a b c"), (7, "a b c"), (8, "z " * 20_000 + "a b c"), (9, "é\u00a0b c")]


@pytest.mark.parametrize("block_bytes", [1 << 22, 40])
def test_lm_matches_brute_force(spark, block_bytes):
    df = spark.createDataFrame([(*r, 1, "x") for r in LM_ROWS], "doc_id long, text string, log_score int, block string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_trigram, r.n_bigram, r.n_unigram, r.n_unseen, None if r.log_score is None else round(r.log_score, 6)) for r in lm.score_documents(df, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == brute_scores(LM_ROWS)
    assert lm.score_documents(df.limit(0)).count() == 0


def test_lm_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.log_score for r in lm.score_documents(docs, block_bytes=100_000).collect()}
    want = {r[0]: r[-1] for r in brute_scores([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-5) for i in want)


def test_mixing_meets_given_targets(spark):
    df = spark.createDataFrame([(i, "x" * (400 + i % 7 * 100), "ab"[i % 3 == 0], ["en", "de", None][i % 4 % 3], "t%d" % (i % 2), "z") for i in range(4000)], "doc_id long, text string, source string, lang string, topic string, tokens string")
    targets = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("lang", "en", 0.4), ("lang", "de", 0.3), ("lang", "", 0.3)], "dimension string, value string, share double")
    rows = mixing.mix(df, targets).collect()
    assert len(rows) == 4000
    for column, value, share in (("source", "a", 0.5), ("lang", "en", 0.4), ("lang", None, 0.3), ("topic", "t0", 0.5)):
        weight = sum(r.tokens * r.probability for r in rows)
        assert abs(sum(r.tokens * r.probability for r in rows if r[column] == value) / weight - share) < 0.01
        drawn = sum(r.tokens for r in rows if r.sampled)
        assert abs(sum(r.tokens for r in rows if r.sampled and r[column] == value) / drawn - share) < 0.04


def test_mixing_edge_cases(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "s", "en"), (1, "", "s", "en"), (2, "x" * 3_000_000, "s", "de")], "doc_id long, text string, source string, lang string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 4 and all(0 < r.probability <= 1 for r in rows) and max(r.tokens for r in rows) == 750_000
    assert len({(r.probability, r.sampled) for r in rows if r.doc_id == 1}) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_any_column_names(spark):
    df = spark.createDataFrame([(i, "song " * 9, "s", "en", "a", "b", "c", "d", 1) for i in range(5)], "doc_id long, text string, source string, lang string, _source string, _lang string, _topic string, Topic string, probability int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "lang", "_source", "_lang", "_topic", "topic", "tokens", "probability", "sampled"]
    assert {(r._source, r._lang, r._topic, r.topic, r.probability) for r in got.collect()} == {("a", "b", "c", "d", 1.0)}


def test_mixing_moves_the_margins(spark):
    """The targets are not the table's own shares: weighted tokens meet them, and some documents become rare."""
    rows = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    weight, own = (sum(f(r) * r.tokens for r in rows) for f in (lambda r: r.probability, lambda r: 1))
    for value, share in (("en", 0.40), ("fr", 0.22), ("es", 0.16)):
        there = [r for r in rows if r.lang == value]
        assert abs(sum(r.probability * r.tokens for r in there) / weight - share) < 1e-6 and abs(sum(r.tokens for r in there) / own - share) > 0.02
    assert min(r.probability for r in rows) < 0.2 and sum(r.sampled for r in rows) < 0.7 * len(rows)


def test_mixing_topics(spark):
    texts = ["The court, a contract and the music", "Musik! film", None, "nothing known", "PRIX et vente; song", "énergie", "discount music"]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert [r.topic for r in mixing.mix(df).orderBy("doc_id").collect()] == ["law", "arts", "other", "other", "commerce", "science", "commerce"]


def test_mixing_matches_brute_raking(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(docs).collect()
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.tokens
    fitted = {c: float(n) for c, n in cells.items()}
    for _ in range(500):
        for at, d in enumerate(mixing.DIMENSIONS):
            own, now = Counter(), Counter()
            for c, n in cells.items():
                own[c[at]] += n
                now[c[at]] += fitted[c]
            asked = {v: s for k, v, s in mixing.TARGETS if k == d and v in own}
            rest = sum(n for v, n in own.items() if v not in asked)
            scale = 1 / sum(asked.values()) if not rest else 1
            want = {v: asked[v] * scale if v in asked else (1 - sum(asked.values())) * own[v] / rest for v in own}
            fitted = {c: f * want[c[at]] / now[c[at]] for c, f in fitted.items()}
    ratio = {c: fitted[c] / cells[c] for c in cells}
    assert all(math.isclose(r.probability, ratio[r.source, r.lang, r.topic] / max(ratio.values()), rel_tol=1e-6) for r in rows)


def test_mixing_warns_of_targets_out_of_reach(spark):
    df = spark.createDataFrame([(1, "x", "a", "en"), (2, "x", "b", "de")], "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([("source", "a", 0.9), ("lang", "en", 0.1)], "dimension string, value string, share double")
    with pytest.warns(UserWarning, match="off their targets"):
        assert mixing.mix(df, targets, rounds=8).count() == 2


def test_pipeline_edge_cases(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, text + " more words here", "en", "s", 9), (5, " ".join(f"x{i % 997}y{i}" for i in range(60_000)), "en", "s", 9)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string")
    for out in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, DATA)
            assert out.columns == df.columns
            out = spark.createDataFrame(out.collect(), df.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, out, DATA).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in out.collect()} <= {1, 5, None}


def test_pipeline(spark):
    import corpus_pipeline
    from loomspan.llm import quality
    from tests.llm.test_jaccard import brute_kept

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in out.select("doc_id", "text").collect()]
        out = stage(spark, out, DATA).cache()
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        sizes.append(len(after))
        if stage is corpus_pipeline.quality_rules:
            assert set(after) == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
        if stage is corpus_pipeline.near_dedup:
            assert sorted(after, key=str) == brute_kept(before)
        if stage is corpus_pipeline.substring_dedup:
            first = {}
            for i, t in sorted(before):
                w = t.split()
                for k in range(len(w) - 12):
                    first.setdefault(tuple(w[k : k + 13]), i)
            for i, t in before:
                w = t.split()
                gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
                want = t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)
                assert after.get(i, "") == want
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == set(after)
