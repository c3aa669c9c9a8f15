"""Cases that queries once got wrong, and steps that once grew faster than their input."""

import math
import random
import shutil
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import cells, knowledge, rank, stripes
from loomspan.plans import registry
from loomspan.streaming import keyed, runs
from tests.conftest import DATA
from tests.oracle import TABLES, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()
T0 = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="session")
def parts(spark, tmp_path_factory):
    """The tables, documents as a folder of parts that are named like files."""
    folder = tmp_path_factory.mktemp("parts")
    for t in TABLES:
        shutil.copyfile(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    (folder / "documents.parquet").unlink()
    whole.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_summary_lines_keep_digits_and_drop_spaces(spark):
    rows = ["1 a 0\n1 b 1\n2 c 2\n 3 d 3 ", "a\nb\nc\nd\n "]
    got = [r.s for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.summary_lines(text.F.col("t")).alias("s")).collect()]
    assert got == ["1 a 0 | 2 c 2 | 3 d 3", "a | c |  "]


def test_a_folder_of_parts_is_one_file(spark, parts):
    got = rows_of(QUERIES["s5_file_discovery"](spark, parts))
    assert got == rows_of_sql(SQL["s5_file_discovery"], DATA) and got[1]


def test_contained_pairs_match_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST", 8)
    r = random.Random(5)
    rows = [(i, "ab"[i % 2], f"text {i % 50}", sorted({f"w{min(int(r.paretovariate(0.6)), 60)}" for _ in range(r.randrange(1, 12))})) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, topic string, text string, w array<string>")
    want = {}
    for x in rows:
        for y in rows:
            ratio = len({*x[3]} & {*y[3]}) / min(len(x[3]), len(y[3]))
            if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and min(len(x[3]), len(y[3])) >= 3 and ratio > 0.6:
                want[x[0], y[0]] = (x[1], ratio)
    got = [tuple(x) for x in knowledge.invalidations(df).collect()]
    assert len(got) == len(want) and {(a, b): (t, ratio) for a, b, t, ratio in got} == want
    late = knowledge.guarded(df.filter("topic = 'a'"), 0.6)
    assert sorted(x.doc_id for x in late.collect()) == sorted({b for (_, b), (t, _) in want.items() if t == "a"})


def test_best_shared_over_blocks_with_empty_sides_and_ties(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST", 4)
    r = random.Random(6)
    rows = [(i, (i % 3) / 10, sorted({f"w{r.randrange(12)}" for _ in range(r.randrange(0, 6))})) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, prior double, words array<string>")
    found = cells.best_shared(items.select(items.id.alias("query_id"), "words"), items, 0.6, 3, parts=5).collect()
    for k, _, ws in rows:
        score = {i: 0.6 * len({*ws} & {*d}) / len(ws) + p for i, p, d in rows if {*ws} & {*d}}
        got = sorted(((-(0.6 * x.shared / x.n_words + x.prior), x.id) for x in found if x.query_id == k))[:3]
        assert got == sorted((-s, i) for i, s in score.items())[:3]


def test_diverse_weighs_each_candidate_once(spark, capsys):
    rows = [("q", 1, 7, 1.0, ["a", "b"]), ("q", 2, 7, 0.9, ["a", "b"]), ("q", 3, 9, 0.6, ["c"]), ("q", 4, 5, 0.6, None), ("r", 1, 3, 0.5, [])]
    got = rank.diverse(spark.createDataFrame(rows, "k string, pos long, id long, score double, words array<string>"), ["k"])
    assert sorted(tuple(x) for x in got.collect()) == [("q", 1, 7, 0.7), ("q", 2, 9, 0.42), ("q", 3, 5, 0.42), ("r", 1, 3, 0.35)]
    got.explain()
    assert "MapInArrow" in capsys.readouterr().out  # nested lambdas weighed a candidate once for each place that named it


def _members(rows: int = 60, words: int = 40) -> list[tuple]:
    r = random.Random(7)
    return [(i, float(i % 20), f"w{int(r.paretovariate(0.5)) % words}x") for i in range(rows) for _ in range(r.randrange(1, 9))] + [(3, 3.0, "w1x"), (3, 3.0, "w1x")]


def _pairs(rows: list[tuple]) -> dict[tuple, list[float]]:
    out = {}
    for i, age, a in rows:
        for j, _, b in rows:
            if i == j and a < b:
                out.setdefault((a, b), []).append(age)
    return out


def test_pairs_of_entities_by_stripes(spark, monkeypatch, capsys):
    monkeypatch.setattr(stripes, "VALUES", 16)
    rows = _members()
    found = stripes.pair_counts(spark.createDataFrame(rows, "id long, age double, entity string"), 2)
    want = {k: len(v) for k, v in _pairs(rows).items() if len(v) >= 2}
    got = found.collect()
    assert len(got) == len(want) and {(x.e1, x.e2): x.recent for x in got} == want
    QUERIES["j5_cooccurrence"](spark, DATA).explain()
    assert "MapInArrow" in capsys.readouterr().out  # a self-join wrote a row for each pair of a text


def test_pairs_recent_and_before(spark, monkeypatch, capsys):
    monkeypatch.setattr(stripes, "VALUES", 16)
    rows = _members()
    found = stripes.pair_counts(spark.createDataFrame(rows, "id long, age double, entity string"), 2, 7.0).collect()
    want = {k: (sum(x <= 7 for x in v), sum(x > 7 for x in v), max([x for x in v if x > 7], default=-float("inf"))) for k, v in _pairs(rows).items() if sum(x <= 7 for x in v) >= 2}
    assert len(found) == len(want) and {(x.e1, x.e2): (x.recent, x.before, x.age) for x in found} == want
    QUERIES["n1_cooccurrence_spikes"](spark, DATA).explain()
    assert "MapInArrow" in capsys.readouterr().out


def test_thirds_by_stripes(spark, monkeypatch, capsys):
    monkeypatch.setattr(stripes, "VALUES", 16)
    rows = sorted(set(_members()))
    found = stripes.thirds(spark.createDataFrame(rows, "id long, created_at double, entity string"), 4).collect()
    want = {}
    for e in {x[2] for x in rows}:
        own = sorted((at, i) for i, at, x in rows if x == e)
        size, extra = divmod(len(own), 3)
        cut = [own[: size + (extra > 0)], own[len(own) - size :]]
        old, new = ({x for i, _, x in rows if x != e and any(i == j for _, j in part)} for part in cut)
        if len(own) >= 4 and old | new:
            want[e] = (len(own), len(old), len(new), len(old & new))
    assert len(found) == len(want) and {x.entity: (x.n, x.old, x.new, x.both) for x in found} == want
    QUERIES["u3_neighbour_difference"](spark, DATA).explain()
    assert "MapInArrow" in capsys.readouterr().out


@pytest.mark.parametrize("every", [True, False])
def test_best_scored_over_blocks_with_ties(spark, monkeypatch, every, capsys):
    monkeypatch.setattr(cells, "LEAST", 8)
    r = random.Random(8)
    docs = {i: [f"w{min(int(r.paretovariate(0.6)), 30)}" for _ in range(r.randrange(0, 12))] for i in range(60)}
    asks = {f"q{k}": sorted({f"w{min(int(r.paretovariate(0.6)), 33)}" for _ in range(r.randrange(1, 4))}) for k in range(40)}
    q = spark.createDataFrame([(k, w) for k, ws in asks.items() for w in ws], "query_id string, term string")
    index = rank.inverted_index(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "id long, text string"), "id", "text", q)
    df = {w: sum(w in t for t in docs.values()) for ws in asks.values() for w in ws}
    want = []
    for k, ws in asks.items():
        score = {i: sum(t.count(w) * math.log(1 + len(docs) / df[w]) for w in ws if w in t) for i, t in docs.items() if (all if every else any)(w in t for w in ws)}
        want += [(k, n + 1, i) for n, (i, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3])]
    found = rank.search(index, q, len(docs), every, 3)
    assert sorted((x.query_id, x["rank"], x.id) for x in found.collect()) == sorted(want)
    found.explain()
    assert "CoGroup" in capsys.readouterr().out  # joins wrote a row for each question and document that share a term


def test_pairs_sharing_over_blocks(spark, monkeypatch, capsys):
    monkeypatch.setattr(cells, "LEAST", 8)
    r = random.Random(9)
    rows = [(i, sorted({f"w{min(int(r.paretovariate(0.6)), 40)}" for _ in range(r.randrange(0, 12))})) for i in range(90)]
    got = [tuple(x) for x in cells.pairs_sharing(spark.createDataFrame(rows, "id long, words array<string>"), 2).collect()]
    want = [(i, j, len({*a} & {*b})) for i, a in rows for j, b in rows if i < j and len({*a} & {*b}) >= 2]
    assert sorted(got) == want
    QUERIES["g15_overlap_groups"](spark, DATA).explain()
    assert "InArrow" in capsys.readouterr().out  # a join wrote a row for each shared entity of each pair


class _Map:
    """Map state of one key in memory, with its calls counted."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _called(self, value):
        self.calls += 1
        return value

    def exists(self):
        return self._called(bool(self.rows))

    def containsKey(self, k):
        return self._called(k in self.rows)

    def getValue(self, k):
        return self._called(self.rows.get(k))

    def updateValue(self, k, v):
        self._called(self.rows.update({k: v}))

    def removeKey(self, k):
        self._called(self.rows.pop(k))

    def keys(self):
        return self._called(iter(list(self.rows)))

    def iterator(self):
        return self._called(iter(list(self.rows.items())))

    def clear(self):
        self._called(self.rows.clear())


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class _Handle:
    def __init__(self):
        self.maps, self.timers, self.watermark = {}, [], 0

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def _through(processor, batches):
    """Rows that a processor gives for one key, over (rows, watermark in ms) batches."""
    handle, got = _Handle(), []
    processor.init(handle)
    for rows, handle.watermark in batches:
        frames = [pd.DataFrame(rows[i : i + 25], columns=["user_id", "ts", "id", "value", "at"]) for i in range(0, len(rows), 25)]
        got += [x for f in processor.handleInputRows((1,), iter(frames), handle) for x in f.itertuples(index=False)]
        if any(t <= handle.watermark for t in handle.timers):
            handle.timers = [t for t in handle.timers if t > handle.watermark]
            got += [x for f in processor.handleExpiredTimer((1,), handle, None) for x in f.itertuples(index=False)]
    return [tuple(x) for x in got], handle


@pytest.mark.parametrize("chunk", [2048, 4])
def test_waiting_rows_are_few_chunks_in_any_order(monkeypatch, chunk):
    monkeypatch.setattr(keyed, "CHUNK", chunk, raising=False)
    r = random.Random(11)
    rows = [(1, None, n, None if n % 17 == 3 else float(r.randrange(200)), n // 2 * 900_000_000) for n in range(300)]  # two at a time, four times an hour
    early, late = rows[:200], rows[200:]
    late += [early.pop(150) for _ in range(20)]
    r.shuffle(early)
    r.shuffle(late)
    got, handle = _through(keyed.CounterReadings(), [(early, 0), ([], 50_000_000), (late, 100_000_000), ([], 10**9)])
    want = [(1, b[2], b[3] - a[3]) for a, b in zip(rows, rows[1:]) if None not in (a[3], b[3]) and not -1 <= b[3] - a[3] <= 50]
    assert got == want and len(got) > 50 and not handle.maps["pending"].rows
    if chunk > len(rows):
        assert handle.maps["pending"].calls < 50  # a few for each bucket of an hour, once


def test_counter_of_missing_readings(spark, tmp_path):
    rows = [(1, 0, 5.0), (1, 1, None), (1, 2, 900.0), (1, 3, 1.0), (2, 99, 0.0)]
    times = [0, 60, 120, 180, 90000]
    df = spark.createDataFrame([(u, T0 + timedelta(seconds=t), i, v) for (u, i, v), t in zip(rows, times)], "user_id long, ts timestamp, id long, value double")
    df.union(df.limit(1).select("user_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(7).cast("long"), "value")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    with keyed.rocks(spark):
        got = runs.run(keyed.in_order(stream, "user_id", keyed.CounterReadings()), "missing").collect()
    assert [tuple(x) for x in got] == [(1, 3, -899.0)]


@pytest.mark.parametrize(("bits", "n_links"), [(40, 300), (64, 500)])
def test_chains_as_sets_of_starts(spark, monkeypatch, capsys, bits, n_links):
    from loomspan.operators import reach

    monkeypatch.setattr(reach, "BITS", bits)
    monkeypatch.setattr(reach, "WORDS", 1)  # blocks that a hash fills beyond 64 starts go on in others
    monkeypatch.setattr(reach, "BATCH", 8)
    r = random.Random(12)
    links = [(a, b) for a, b in ((r.randrange(260), r.randrange(260)) for _ in range(n_links)) if a < b or r.random() < 0.3]
    out = knowledge.chain(spark.createDataFrame(links, "old long, new long"))
    step = {}
    for a, b in links:
        step.setdefault(a, set()).add(b) if a != b else None
    want = set()
    for s in {x for a, b in links if a != b for x in (a, b)}:
        seen, front, d = {s}, {s}, 0
        want.add((s, s, 0))
        while front := {y for x in front for y in step.get(x, ())} - seen:
            d += 1
            seen |= front
            want |= {(s, y, d) for y in front} | {(y, s, -d) for y in front}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    out.explain()
    assert "MapInArrow" in capsys.readouterr().out  # rounds of joins wrote, and read again in each round, a row for each pair


def test_position_meets_names_not_their_parts(spark, capsys):
    found = QUERIES["a21_narrative_position"](spark, DATA)
    assert rows_of(found) == rows_of_sql(SQL["a21_narrative_position"], DATA)
    found.explain()
    assert "p_partkey" not in capsys.readouterr().out  # a row for each question and part of a name that holds one of its words


def test_a_merge_runs_the_stream_behind_it_once(spark, tmp_path):
    from loomspan.sources.versioned import VersionedTable

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    spark.range(40).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").select(F.udf(counted, "long").asNondeterministic()("id").alias("k"), F.lit(1).cast("long").alias("n"))
    table = VersionedTable(spark, f"{tmp_path}/table", "k long, n long", ["k"], 4)
    runs.upsert(stream, str(tmp_path), table, F.col("n"))
    assert table.read().count() == 40 and seen.value == 40


@pytest.mark.parametrize("name", ["r21_packaged_buckets", "r7_open_question_boost"])
def test_memories_join_last_and_are_judged_once(spark, capsys, name):
    df = QUERIES[name](spark, DATA)
    df.explain()
    plan = capsys.readouterr().out
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "[memory_id" in top  # texts go through no other join
    assert name != "r21_packaged_buckets" or plan.index("RLIKE") > plan.index(top)
    assert rows_of(df) == rows_of_sql(SQL[name], DATA)


def test_bucket_boost_of_odd_texts(spark, tmp_path):
    for t in TABLES:
        shutil.copyfile(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = ["", "  ", "\n", "×must×", "яmust", "no\rfound x found", "no\u2028 found", "must\u0301", "漢must字", "µmust", "muſt", "dépends on", "doc\u212aer-compose", "`\n`", None, "plain"]
    docs = pd.DataFrame({"doc_id": range(len(odd)), "text": odd, "lang": "en", "source": "web", "n_chars": [len(x or "") for x in odd]})
    docs.to_parquet(tmp_path / "documents.parquet")
    for name in ("p34_bucket_boost", "p9_classify_memory"):
        got = rows_of(QUERIES[name](spark, str(tmp_path)))
        assert got == rows_of_sql(SQL[name], str(tmp_path)) and got[1]


def test_packs_keep_rows_and_copy_none(spark, monkeypatch, capsys):
    monkeypatch.setattr(cells, "LEAST", 4)
    monkeypatch.setattr(cells, "PACK", 16)
    r = random.Random(13)
    rows = [(i, "ab"[i % 5 == 0], sorted({f"w{min(int(r.paretovariate(0.6)), 40)}" for _ in range(r.randrange(0, 12))})) for i in range(150)]
    packs = cells.packed(spark.createDataFrame(rows, "id long, topic string, words array<string>").repartition(7), "topic").collect()
    got = [(x["id"], p.topic, sorted(x["words"])) for p in packs for x in cells.Pack(p.meta, p.names, p.postings).whole().to_pylist()]
    assert sorted(got) == rows and max(p.n for p in packs) <= 20 and len(packs) < 24
    for name in ("j18_near_duplicate_guard", "g12_fact_invalidation", "j16_keyword_candidates", "g15_overlap_groups", "slice_top_memories", "a1_shared_entities"):
        QUERIES[name](spark, DATA).explain()
        assert "CartesianProduct" in capsys.readouterr().out  # rows were copied to as many cells as there were blocks, all on disk at once


def test_stripes_in_rounds(spark, monkeypatch, capsys):
    rows = _members()
    df = spark.createDataFrame(rows, "id long, age double, entity string")
    third = spark.createDataFrame(sorted(set(rows)), "id long, created_at double, entity string")
    asks = (lambda: stripes.pair_counts(df, 2, 7.0), lambda: stripes.pair_counts(df, 2, 7.0, F.col("before") > 1), lambda: stripes.thirds(third, 4))
    want = [rows_of(ask()) for ask in asks]
    monkeypatch.setattr(stripes, "ROUND", 16)
    monkeypatch.setattr(stripes, "TIMES", 0)
    for ask, all_ in zip(asks, want):
        found = ask()
        found.explain()
        assert "MapInArrow" not in capsys.readouterr().out  # rounds are written; all arrays were shuffled at once
        assert rows_of(found) == all_ and all_[1]


@pytest.mark.parametrize(("shared", "least"), [(1, 2), (2, 3)])
def test_greedy_groups_as_numbers(spark, shared, least, capsys):
    r = random.Random(14)
    rows = [(f"d{i % 3}", i, f"w{int(r.paretovariate(0.35))}") for i in range(120) for _ in range(r.randrange(1, 5))]
    out = knowledge.overlap_groups(spark.createDataFrame(rows, "day string, id long, entity string"), "day", shared, least)
    want = []
    for day in ("d0", "d1", "d2"):
        left = {i: {e for _, j, e in rows if j == i} for d, i, _ in rows if d == day}
        while left:
            first = min(left)
            words, group = left.pop(first), [first]
            for i in sorted(left):
                if len(words & left[i]) >= shared:
                    words |= left.pop(i)
                    group.append(i)
            want += [(day, first, i) for i in group] if len(group) >= least else []
    assert sorted(tuple(x) for x in out.collect()) == sorted(want) and len({f for _, f, _ in want}) > 3
    out.explain()
    assert "InPandas" not in capsys.readouterr().out  # a block's entities were Python strings in sets


def test_searches_copy_no_documents(spark, monkeypatch):
    copied, every = [], cells._every
    monkeypatch.setattr(cells, "_every", lambda n, name: copied.append(name) or every(n, name))
    monkeypatch.setattr(cells, "LEAST", 8)
    monkeypatch.setattr(cells, "MOST", 8)
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 7}") for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(f"q{k}", f"w{k % 7}") for k in range(70)], "query_id string, term string")
    found = rank.search(rank.inverted_index(docs, "id", "text", asked), asked, 60, True, 3)
    got = [(x.query_id, x["rank"], x.id) for x in found.collect()]
    want = []
    for k in range(70):
        score = {i: (i % 5 == k % 7) + (i % 7 == k % 7) for i in range(60)}
        want += [(f"q{k}", n + 1, i) for n, i in enumerate(sorted((i for i in score if score[i]), key=lambda i: (-score[i], i))[:3])]
    assert sorted(got) == sorted(want)
    assert copied == ["i"]  # questions go to every block; documents went to each block of questions
