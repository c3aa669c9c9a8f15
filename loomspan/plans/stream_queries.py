"""Streaming queries, run over the tables' files until all are read, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans import views
from loomspan.plans.registry import query
from loomspan.plans.views import sql
from loomspan.sources.versioned import VersionedTable
from loomspan.streaming import detectors, keyed, runs

c = F.col
START = 1_704_067_200  # 2024-01-01 in seconds


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.read(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))


@query("x2_late_drop", "SELECT event_id, user_id FROM events WHERE event_id % 10 != 0 OR ts > (SELECT max(ts) FROM events WHERE event_id % 10 NOT IN (0, 5)) - INTERVAL 1 HOUR")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches, a tenth of them in the last one: what is then older than the watermark goes."""
    folder, e = runs.shared_folder(spark, "late-in"), views.table(spark, sf_dir, "events").select("event_id", "user_id", c("ts").cast("timestamp").alias("ts"))
    for n, part in enumerate(("event_id % 10 NOT IN (0, 5)", "event_id % 10 = 5", "event_id % 10 = 0")):
        e.filter(part).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    fresh = stream.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return runs.run(fresh.select("event_id", "user_id"), "late")


@query("x3_dedup_prefix", "SELECT DISTINCT conv_id, substring(text, 1, 80) AS prefix FROM conversations WHERE text IS NOT NULL")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = runs.read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    t = t.select("conv_id", F.substring("text", 1, 80).alias("prefix"), F.timestamp_micros((c("conv_id") + START) * 1_000_000).alias("ts"))
    return runs.run(t.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["conv_id", "prefix"]).select("conv_id", "prefix"), "dedup")


#: What event time has passed when a run is over: the newest time less the watermark's delay of an hour, in whole milliseconds.
_PASSED = "(SELECT (epoch_ms(max(ts)) - 3600000) * 1000 FROM {})"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "ts", c("event_id").alias("id"), "value")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = runs.read(spark, sf_dir, "conversations")
    ts = F.timestamp_micros((c("conv_id") * 3600 + c("turn") * 60 + START) * 1_000_000)
    return t.select(c("conv_id").cast("string").alias("session_id"), ts.alias("ts"), c("turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("content"), views.token_est("text").alias("tokens"))


@query("x5_rate_limit", f"""SELECT user_id, unnest(f.out) AS event_id FROM (SELECT user_id, list_reduce(l, lambda s, r: {{'id': r.id, 'at': r.at,
  'calls': CASE WHEN len(list_filter(s.calls, lambda x: r.at - x < 43200000000)) >= 3 THEN list_filter(s.calls, lambda x: r.at - x < 43200000000) ELSE list_append(list_filter(s.calls, lambda x: r.at - x < 43200000000), r.at) END,
  'out': CASE WHEN len(list_filter(s.calls, lambda x: r.at - x < 43200000000)) >= 3 THEN list_append(s.out, r.id) ELSE s.out END}}, {{'id': 0::BIGINT, 'at': 0::BIGINT, 'calls': []::BIGINT[], 'out': []::BIGINT[]}}) AS f
  FROM (SELECT user_id, list({{'id': event_id, 'at': epoch_us(ts), 'calls': []::BIGINT[], 'out': []::BIGINT[]}} ORDER BY ts, event_id) AS l FROM events WHERE epoch_us(ts) <= {_PASSED.format("events")} GROUP BY 1))""")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls beyond three in twelve hours (by default ten in a minute)."""
    with keyed.rocks(spark):
        return runs.run(keyed.in_order(_calls(spark, sf_dir).drop("value"), "user_id", keyed.SlidingLimit(3, 12 * 3600, 24 * 3600)), "rate")


@query("x9_session_expiry", f"""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR, true) AS new FROM events)) GROUP BY user_id, s HAVING epoch_us(max(ts)) + 3600000000 <= {_PASSED.format("events")}""")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of an hour's gap, each once it is over."""
    s = _events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return runs.run(s.select("user_id", views.stamp("w.start").alias("started"), "n"), "sessions")


@query("x12_rolling_utility", f"""SELECT user_id, strftime(w, '%Y-%m-%d') AS window_start, round(sum(value), 4) AS score FROM (SELECT user_id, value, unnest(range(date_trunc('day', ts) - INTERVAL 59 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM events)
  WHERE epoch_us(w) + 60 * 86400000000 <= {_PASSED.format("events")} GROUP BY user_id, w""")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of sixty days, one for each day, each once its window has closed."""
    u = _events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "60 days", "1 day").alias("w")).agg(F.round(F.sum("value"), 4).alias("score"))
    return runs.run(u.select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "score"), "utility")


@query("x8_counter_state", f"""SELECT user_id, event_id, round(delta, 6) AS delta FROM (SELECT *, value - lag(value) OVER w AS delta, ts - lag(ts) OVER w AS gap FROM events WHERE epoch_us(ts) <= {_PASSED.format("events")}
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE (delta < -1.0 OR delta > 50) AND gap < INTERVAL 2 HOUR""")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    with keyed.rocks(spark):
        return runs.run(keyed.in_order(_calls(spark, sf_dir), "user_id", keyed.CounterReadings(bucket_seconds=24 * 3600)), "counter").withColumn("delta", F.round("delta", 6))


@query("x4_session_state", sql("turns", f"""SELECT u.session_id, u.turn_index AS turn, u.content AS query, coalesce(a.content, '') AS reply, r <= 20 AND epoch_us(touched) + 4 * 3600000000 > {_PASSED.format("turns")} AS live
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS r FROM t WHERE role = 'user') u LEFT JOIN (SELECT * FROM t WHERE role = 'assistant') a ON a.session_id = u.session_id AND a.turn_index = u.turn_index + 1
  JOIN (SELECT t.session_id, max(t.ts) AS touched FROM t LEFT JOIN t p ON p.session_id = t.session_id AND p.turn_index = t.turn_index - 1 WHERE t.role = 'user' OR t.role = 'assistant' AND p.role = 'user' GROUP BY 1) m ON m.session_id = u.session_id""", t=f"SELECT * FROM turns WHERE epoch_us(ts) <= {_PASSED.format('turns')}"))
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer of each session as a table that every batch of changes is merged into."""
    folder = runs.shared_folder(spark, "buffer")
    table = VersionedTable(spark, f"{folder}/table", "session_id string, turn long, query string, reply string, live boolean, at long", ["session_id", "turn"], 8)
    with keyed.rocks(spark):
        changes = keyed.in_order(_turns(spark, sf_dir).drop("tokens"), "session_id", keyed.TurnBuffer())
        runs.upsert(changes, folder, table, F.struct("at", ~c("live")))
    return table.read().drop("at")


@query("x6_circuit_breaker", """SELECT user_id, unnest(f.out) AS event_id FROM (SELECT user_id, list_reduce(l, lambda s, r: {'id': r.id, 'e': r.e, 'at': r.at, 'run': CASE WHEN r.at < s.until THEN CASE WHEN r.at - s.at >= 172800000000 THEN 0 ELSE s.run END WHEN NOT r.e THEN 0 WHEN CASE WHEN r.at - s.at >= 172800000000 THEN 0 ELSE s.run END + 1 >= 3 THEN 0 ELSE CASE WHEN r.at - s.at >= 172800000000 THEN 0 ELSE s.run END + 1 END::BIGINT,
  'until': CASE WHEN r.at >= s.until AND r.e AND r.at - s.at < 172800000000 AND s.run + 1 >= 3 THEN r.at + 43200000000 ELSE s.until END::BIGINT, 'out': CASE WHEN r.at >= s.until AND r.e AND r.at - s.at < 172800000000 AND s.run + 1 >= 3 THEN list_append(s.out, r.id) ELSE s.out END}, {'id': 0::BIGINT, 'e': false, 'at': 0::BIGINT, 'run': 0::BIGINT, 'until': 0::BIGINT, 'out': []::BIGINT[]}) AS f
  FROM (SELECT user_id, list({'id': event_id, 'e': event_type = 'error', 'at': epoch_us(ts), 'run': 0::BIGINT, 'until': 0::BIGINT, 'out': []::BIGINT[]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1))""")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run(detectors.breaker(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")), "breaker")


@query("x7_cooldown", """SELECT user_id, unnest(f.out) AS event_id FROM (SELECT user_id, list_reduce(l, lambda s, r: {'id': r.id, 'at': r.at, 'last': CASE WHEN s.last IS NULL OR r.at - s.last >= 86400000000 THEN r.at ELSE s.last END::BIGINT,
  'out': CASE WHEN s.last IS NULL OR r.at - s.last >= 86400000000 THEN list_append(s.out, r.id) ELSE s.out END}, {'id': 0::BIGINT, 'at': 0::BIGINT, 'last': NULL::BIGINT, 'out': []::BIGINT[]}) AS f
  FROM (SELECT user_id, list({'id': event_id, 'at': epoch_us(ts), 'last': NULL::BIGINT, 'out': []::BIGINT[]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1))""")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run(detectors.cooldown(_events(spark, sf_dir).select("user_id", "event_id", "ts")), "cooldown")


@query("x10_turn_outcome_join", sql("turns", f"SELECT q.session_id, q.turn_index, length(a.content) AS reply_length FROM turns q JOIN turns a ON a.session_id = q.session_id AND a.turn_index = q.turn_index + 1 WHERE q.role = 'user' AND a.role = 'assistant' AND epoch_us(a.ts) <= {_PASSED.format('turns')}"))
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    with keyed.rocks(spark):
        return runs.run(keyed.in_order(_turns(spark, sf_dir).drop("tokens"), "session_id", keyed.TurnOutcomes()), "outcome")


@query("x13_idempotent_sink", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run(_events(spark, sf_dir), "sink").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("x11_pressure_alert", sql("turns", f"SELECT session_id, turn_index, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, sum(token_est) OVER (PARTITION BY session_id ORDER BY turn_index) AS tokens FROM turns WHERE epoch_us(ts) <= {_PASSED.format('turns')}) WHERE tokens >= 300"))
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns at which a session has come to three quarters of 400 tokens (by default of 200,000) or more."""
    with keyed.rocks(spark):
        return runs.run(keyed.in_order(_turns(spark, sf_dir).drop("role", "content"), "session_id", keyed.Pressure(400)), "pressure")


@query("x1_hot_ingest", sql("turns", "SELECT conv_id, CAST(turns AS BIGINT) AS turns, last_turn FROM (SELECT conv_id, count(*) AS turns, max(turn_index) AS last_turn, max(ts) AS last FROM turns GROUP BY 1) WHERE last >= (SELECT max(ts) FROM turns) - INTERVAL 30 MINUTE"))
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a turn in the last half hour, from a table that each batch of files updates: only the sessions it touches."""
    folder = runs.shared_folder(spark, "ingest")
    t = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", (c("conv_id") * 60 + c("turn")).alias("minute"))
    t.withColumn("part", F.floor(c("minute") * 4 / 60) % 4).repartition(4, "part").drop("part").write.parquet(f"{folder}/in")
    table = VersionedTable(spark, f"{folder}/table", "conv_id long, turns long, last_turn long, minute long", ["conv_id"], 8)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).option("maxFileAge", "60m").parquet(f"{folder}/in")

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.max("minute").alias("minute"))
        most = lambda n: F.greatest(c(f"old.{n}"), c(f"new.{n}"))
        table.merge(fresh, number, {"turns": F.coalesce(c("old.turns"), F.lit(0)) + c("new.turns"), "last_turn": most("last_turn"), "minute": most("minute")})

    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    newest = table.read().agg(F.max("minute")).first()[0]
    return table.read().filter(c("minute") >= F.lit(newest) - 30).select("conv_id", "turns", "last_turn")


@query("s12_versioned_upsert", "SELECT user_id, count(*) AS n, max(value) AS most, CAST(max(event_id) AS BIGINT) AS last_event FROM events GROUP BY 1")
def s12_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per user, merged batch by batch into a table whose versions are swapped whole; each batch is tried twice."""
    folder = runs.shared_folder(spark, "versions")
    table = VersionedTable(spark, f"{folder}/table", "user_id long, n long, most double, last_event long", ["user_id"], 8)
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    e.repartition(3, "event_id").write.parquet(f"{folder}/in")

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.max("event_id").alias("last_event"))
        rules = {"n": F.coalesce(c("old.n"), F.lit(0)) + c("new.n"), "most": F.greatest(c("old.most"), c("new.most")), "last_event": F.greatest(c("old.last_event"), c("new.last_event"))}
        for _ in range(2):
            table.merge(fresh, number, rules)

    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    table.clean()
    return table.read()
