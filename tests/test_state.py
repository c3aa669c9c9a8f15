"""Stream state across batches and restarts, the versioned table, bounded search and chains, against plain Python."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspan.operators import knowledge, rank
from loomspan.sources.versioned import VersionedTable
from loomspan.streaming import keyed, runs

T0 = datetime(2024, 1, 1, tzinfo=UTC)
EVENTS = "user_id long, ts timestamp, id long, value double"


def minutes(n):
    return T0 + timedelta(minutes=n)


def feed(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")


def readings():
    """Three files of two users' readings; the second file holds some that are older than the first one's last, within the delay."""
    r = random.Random(5)
    rows, value = [], 100.0
    for n in range(60):
        value = max(0.0, value + r.choice((1, 5, 60, -3, -0.5)))
        rows.append((n % 2, minutes(n * 7 if n < 40 else n * 7 + 130), n, value))
    first, second, third = rows[:20], rows[20:40], rows[40:]
    second.append(first.pop(15))
    third.append((0, minutes(5000), 99, 0.0))  # moves the watermark past all others
    for part in (first, second, third):
        r.shuffle(part)
    return first, second, third


def twin(rows, ttl=120):
    out, last = [], {}
    for user, ts, i, value in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if user in last and ts - last[user][0] < timedelta(minutes=ttl):
            d = value - last[user][1]
            if d < -1 or d > 50:
                out.append((user, i, round(d, 6)))
        last[user] = (ts, value)
    return sorted(out)


@pytest.fixture
def folder(spark):
    return runs.shared_folder(spark, "test")


def continued(spark, folder, schema, key, processor):
    """Run a job over what is there, from its checkpoint on; all rows that it has written so far."""
    with keyed.rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        out = keyed.in_order(stream, key, processor)
        job = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_counter_state_across_batches_and_restart(spark, folder):
    parts = readings()
    for n, rows in enumerate(parts[:2]):
        feed(spark, folder, n, rows, EVENTS)
    before = continued(spark, folder, EVENTS, "user_id", keyed.CounterReadings(bucket_seconds=1800)).count()
    feed(spark, folder, 2, parts[2], EVENTS)
    got = continued(spark, folder, EVENTS, "user_id", keyed.CounterReadings(bucket_seconds=1800)).collect()
    want = twin([x for p in parts for x in p if x[2] != 99])
    assert sorted((r.user_id, r.event_id, round(r.delta, 6)) for r in got) == want and 0 < before < len(want)


def test_turn_buffer_fills_replies_later(spark, folder):
    schema = "session_id string, ts timestamp, id long, role string, content string"
    rows = [("a", minutes(k), k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(8)] + [("b", minutes(3), 0, "user", "q"), ("b", minutes(4), 5, "assistant", "to nobody"), ("b", minutes(4), 6, "system", "x")]
    feed(spark, folder, 0, [r for r in rows if r[2] != 5 or r[0] == "b"], schema)
    feed(spark, folder, 1, [r for r in rows if r[2] == 5 and r[0] == "a"] + [("c", minutes(150), 0, "user", "later")], schema)
    feed(spark, folder, 2, [("c", minutes(9000), 0, "user", "end")], schema)
    table = VersionedTable(spark, f"{folder}/table", "session_id string, turn long, query string, reply string, live boolean, at long", ["session_id", "turn"], 4)
    with keyed.rocks(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        runs.upsert(keyed.in_order(stream, "session_id", keyed.TurnBuffer(most=2, ttl_seconds=3600)), folder, table, F.struct("at", ~F.col("live")))
    got = {(r.session_id, r.turn): (r.query, r.reply, r.live) for r in table.read().collect()}
    want = {("a", k): (f"t{k}", f"t{k + 1}", False) for k in (0, 2, 4, 6)} | {("b", 0): ("q", "", False), ("c", 0): ("later", "", False)}
    assert got == want


def test_sliding_limit(spark, folder):
    r = random.Random(2)
    rows = [(n % 3, T0 + timedelta(seconds=r.randrange(900)), n, 0.0) for n in range(150)]
    feed(spark, folder, 0, rows, EVENTS)
    feed(spark, folder, 1, [(9, minutes(900), 999, 0.0)], EVENTS)
    want, calls = [], {}
    for user, ts, i, _ in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        calls[user] = [t for t in calls.get(user, []) if ts - t < timedelta(seconds=60)]
        if len(calls[user]) >= 3:
            want.append((user, i))
        else:
            calls[user].append(ts)
    got = continued(spark, folder, EVENTS, "user_id", keyed.SlidingLimit(most=3, bucket_seconds=120)).collect()
    assert sorted((x.user_id, x.event_id) for x in got) == sorted(want) and len(want) > 5


def test_versioned_table(spark, folder):
    table = VersionedTable(spark, f"{folder}/t", "k long, name string, n long", ["k"], buckets=4)
    assert table.read().count() == 0
    add = {"n": F.coalesce(F.col("old.n"), F.lit(0)) + F.col("new.n")}
    first = spark.createDataFrame([(k, "a", 1) for k in range(20)], "k long, name string, n long")
    assert table.merge(first, 0, add) and not table.merge(first, 0, add)
    state = table._current()
    held = table.read()
    assert table.merge(spark.createDataFrame([(3, "b", 5), (40, None, 2)], first.schema), 7, add) and not table.merge(first, 6, add)
    assert sum(state["folders"].get(b) != f for b, f in table._current()["folders"].items()) <= 2
    assert sorted(map(tuple, held.collect())) == [(k, "a", 1) for k in range(20)]  # a reader from before the merge
    assert sorted(map(tuple, table.read().collect())) == sorted([(k, "a", 1) for k in range(20) if k != 3] + [(3, "b", 6), (40, None, 2)])
    with pytest.raises(Exception, match="(?i)boom"):
        table.merge(first.withColumn("n", F.raise_error(F.lit("boom")).cast("long")), 8, add)
    table.clean()
    assert table.read().count() == 21 and VersionedTable(spark, f"{folder}/t", table.schema, ["k"], 4).read().count() == 21


def corpus(n=300):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    return {i: [words[min(int(r.paretovariate(0.7)) - 1, 199)] for _ in range(r.randrange(1, 60))] for i in range(n)}


def test_bounded_search_reads_less_and_loses_nothing(spark):
    docs = corpus()
    index = spark.createDataFrame([(i, t, ws.count(t)) for i, ws in docs.items() for t in set(ws)], "id long, term string, tf long").cache()
    r = random.Random(8)
    asked = {f"q{k}": {r.choice(r.choice(list(docs.values()))) for _ in range(6)} | ({"none"} if k % 5 == 0 else set()) for k in range(40)}
    q = spark.createDataFrame([(k, t) for k, ts in asked.items() for t in ts], "query_id string, term string")
    import math

    df = {t: sum(t in ws for ws in docs.values()) for ts in asked.values() for t in ts}
    for every in (True, False):
        want = []
        for k, ts in asked.items():
            hits = {i: sum(ws.count(t) * math.log(1 + len(docs) / df[t]) for t in ts if t in ws) for i, ws in docs.items() if (all if every else any)(t in ws for t in ts)}
            want += [(k, i, n) for n, (i, _) in enumerate(sorted(hits.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10], 1)]
        got = rank.search(index, q, len(docs), every)
        assert sorted((x.query_id, x.id, x.rank) for x in got.collect()) == sorted(want)
    wanted = rank.weighted(index, q, len(docs))
    assert rank.candidates(index, wanted, 10).count() * 3 < q.join(index, "term").select("query_id", "id").distinct().count()


def test_covering_keeps_the_best(spark):
    docs = {i: set(ws) for i, ws in corpus().items()}
    prior = {i: (i * 37 % 41) / 100 for i in docs}
    r = random.Random(9)
    asked = {k: {r.choice(r.choice([*map(sorted, docs.values())])) for _ in range(r.randrange(1, 12))} for k in range(30)}
    index = spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "id long, word string")
    q = spark.createDataFrame([(k, len(ws), w) for k, ws in asked.items() for w in ws], "query_id long, n_words int, word string")
    found = rank.covering(q, index, spark.createDataFrame(list(prior.items()), "id long, prior double"), 0.6, 5).collect()
    for k, ws in asked.items():
        score = {i: 0.6 * len(ws & d) / len(ws) + prior[i] for i, d in docs.items() if ws & d}
        got = sorted(((x.id, 0.6 * x.shared / x.n_words + x.prior) for x in found if x.query_id == k), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in got] == [i for i, _ in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]]


def test_chains_go_to_their_ends(spark):
    links = [(i, i + 1) for i in range(12)] + [(2, 7), (20, 21), (21, 22), (22, 20), (30, 30)]
    got = {(r.start, r.node, r.depth) for r in knowledge.chain(spark.createDataFrame(links, "old long, new long")).collect()}
    want = set()
    for sign in (1, -1):
        step = {}
        for a, b in links:
            if a != b:
                step.setdefault(*((a, set()) if sign > 0 else (b, set()))).add(b if sign > 0 else a)
        for s in {x for a, b in links if a != b for x in (a, b)}:
            seen, front, d = {s}, {s}, 0
            want.add((s, s, 0))
            while front:
                d += 1
                front = {y for x in front for y in step.get(x, ())} - seen
                seen |= front
                want |= {(s, y, sign * d) for y in front}
    assert got == want
