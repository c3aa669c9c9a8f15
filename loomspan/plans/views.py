"""Views of the test tables that stand for conversation, memory, graph and event data; each also as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import trimmed

AS_OF, EDGES_AS_OF, EPISODES_AS_OF = "2024-02-01 00:00:00", "2001-06-01 00:00:00", "2001-08-02 00:00:00"

# Phrases put before a text by id % 16, so that rules fire.
SEEDS = (
    "Fixed the connection error", "Decided to use Docker instead of a VM because it is simpler", "Must always run on port 5100",
    "The API key is stored at /root/keys", "what was that project config?", "yes", "how do I parse JSON in Python",
    "compare Docker vs Podman for this server?", "MQTT sensor added to Home Assistant", "restart nginx",
    "No, actually it is 10.0.0.50", "originally used v1, no longer active", "unclear, needs verification",
    "deployed the container, root cause was a crash", "we discussed the setup last time", "",
)
SOURCES = ("memo_search", "graph", "narrative", "open_question", "peripheral", "patterns", "identity", "session_buffer", "relevant_context", "cluster")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plus(c: Column, days: Column | None = None, minutes: Column | None = None) -> Column:
    zero = F.lit(0)
    return c + F.make_dt_interval((days if days is not None else zero).cast("int"), zero, (minutes if minutes is not None else zero).cast("int"))


def days_since(c: Column | str, as_of: str) -> Column:
    return (micros(at(as_of)) - micros(c)) / F.lit(86_400_000_000.0)


def stamp(c: Column | str) -> Column:
    """A timestamp as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def seeded(id_col: str, text_col: str) -> Column:
    return trimmed(F.concat(pick(SEEDS, F.col(id_col) % 16), F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", seeded("doc_id", "text").alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ts = plus(at("2024-01-01 00:00:00"), minutes=F.col("conv_id") * 60 + F.col("turn"))
    return c.select("conv_id", F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.coalesce("text", F.lit("")).alias("content"), token_est("text").alias("token_est"), ts.alias("ts"))


def token_est(text: str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4)).cast("long")


def seeded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.withColumn("n", F.col("conv_id") * 8 + F.col("turn_index")).withColumn("content", seeded("n", "content"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    created = plus(at("2024-01-01 00:00:00"), minutes=i * 7919 % 40320)
    d = d.select(i.alias("id"), F.col("text").alias("summary"), "source", created.alias("created_at"))
    i = F.col("id")
    return d.select(
        "*", F.when(i % 7 != 0, plus(F.col("created_at"), days=i % 3)).alias("last_accessed"), (i % 23).alias("access_count"),
        F.when(i % 10 == 0, "critical").when((i % 10).isin(1, 2), "high").when(i % 10 == 3, "low").otherwise("normal").alias("impact"),
        F.when(i % 5 == 0, "ambient").otherwise("inferred").alias("confidence"), (i % 17 == 0).alias("is_deprecated"), (i % 50 == 0).alias("pinned"),
        F.when(i % 13 == 0, plus(F.col("created_at"), days=F.lit(20))).alias("ttl_expires"),
    )


def memory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).filter("id % 11 = 0")
    return m.select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"), plus(F.col("created_at"), days=F.lit(1)).alias("detected_at"), (F.col("id") % 2 == 0).alias("resolved"))


def memory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    words = F.transform(F.regexp_extract_all("summary", F.lit("[A-Za-z]{8,}"), 0), F.lower)
    return m.select("id", "created_at", F.explode(F.array_distinct(words)).alias("entity"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    predicate = F.when(F.col("l_returnflag") == "A", "USES").when(F.col("l_returnflag") == "N", "RUNS_ON").otherwise("DEPENDS_ON")
    e = li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), predicate.alias("predicate"))
    return e.agg(F.count("*").alias("obs"), F.max("l_shipdate").alias("last_confirmed"))


def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges confirmed by the reference time, with their decay then."""
    e = edges(spark, sf_dir).filter(F.col("last_confirmed") <= at(EDGES_AS_OF))
    return e.withColumn("decay", F.pow(F.lit(2.0), -days_since("last_confirmed", EDGES_AS_OF) / (14.0 * F.log2(F.col("obs") + 1.0))))


def _memory(n: int) -> Column:
    """The memory that a question meets at rank k: of a hot tenth of all documents up to rank 3, of all of them below."""
    i = F.col("conv_id") * 31 + F.col("turn_index") * 7
    return F.when(F.col("k") <= 3, (i + F.col("k")) % max(1, n // 10)).otherwise((i * 53 + F.col("k") * 131) % max(1, n))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of retrievals, without what they take from the memory's text and also where there is no such memory."""
    q = turns(spark, sf_dir).filter("role = 'user'").select("conv_id", "session_id", "turn_index", "content", "ts")
    return q.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("memory_id", _memory(table(spark, sf_dir, "documents").count()))


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieved(spark, sf_dir)
    bucket = F.when(F.col("conv_id") >= 95, "FACTS").otherwise(F.element_at(F.array(F.lit("CONSTRAINTS"), F.lit("PROCEDURES"), F.lit("FACTS"), F.lit(None)), (F.col("memory_id") % 4 + 1).cast("int")))
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("memory_text"))
    r = r.join(m, "memory_id")
    return r.select("conv_id", "session_id", "turn_index", F.col("content").alias("query"), "memory_id", "memory_text", F.col("k").cast("long").alias("result_rank"), (1.0 / F.col("k")).alias("cosine_score"), bucket.alias("packaged_bucket"), F.col("ts").alias("created_at"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    q = t.filter("role = 'user'").select("session_id", "turn_index")
    a = t.filter("role = 'assistant'").select("session_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("content").alias("response"))
    return q.join(a, ["session_id", "turn_index"])


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrievals(spark, sf_dir)
    conf = ((F.col("memory_id") * 37 + F.col("result_rank") * 11) % 100) / 100.0
    return r.select("session_id", "turn_index", "query", "memory_id", "result_rank", pick(SOURCES, F.col("memory_id") % 10).alias("source_type"), F.col("memory_text").alias("content"), conf.alias("confidence"), token_est("memory_text").alias("token_est"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    lines = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("turn_count"), F.array_sort(F.collect_set(F.concat("p_brand", F.lit("-"), "p_size"))).alias("topics"), F.array_sort(F.collect_set(F.concat(F.lit("S"), "l_suppkey"))).alias("entities")
    )
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial").otherwise("abandoned")
    lesson = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("lesson "), F.col("o_orderkey"))).otherwise("")
    return o.join(per, "o_orderkey").select(F.col("o_orderkey").alias("episode_id"), outcome.alias("outcome"), F.col("o_orderdate").alias("started_at"), "turn_count", "topics", "entities", lesson.alias("lesson"))


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    verdict = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "view", "warn").otherwise("approve")
    return e.select("event_id", F.floor(i / 3).alias("request"), (i % 3).alias("auditor"), verdict.alias("verdict"), (1 + i % 5).alias("risk"), (i % 29 == 0).alias("error"), "ts", "user_id", "event_type")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pole = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("balanced")
    return e.select("event_id", F.col("user_id").alias("preference_id"), "ts", F.when(F.col("event_type") == "error", "challenges").otherwise("supports").alias("direction"), pole.alias("pole"), ((1 + F.col("event_id") % 10) / 10.0).alias("confidence"), "event_type", "value")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").join(n, "p_partkey", "left")
    return p.select("p_partkey", "p_name", (1 + F.col("p_partkey") % 5).alias("rating"), F.coalesce("n", F.lit(0)).cast("long").alias("review_count"), F.col("p_retailprice").alias("price"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1)
    priority = F.when(digit == "1", "critical").when(digit == "2", "high").when(digit == "3", "normal").otherwise("low")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("title"), priority.alias("priority"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("active").alias("status"), plus(F.col("o_orderdate"), days=F.lit(90)).alias("deadline"), "o_orderdate")


def _list(values: tuple) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SEED_SQL = "trim({seeds}[({id} % 16 + 1)::INT] || ' ' || coalesce({text}, ''))"
SQL = {
    "docs": f"SELECT doc_id, lang, source, {_SEED_SQL.format(seeds=_list(SEEDS), id='doc_id', text='text')} AS text FROM documents",
    "turns": "SELECT conv_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, role, coalesce(text, '') AS content, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS token_est, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS ts FROM conversations",
    "sturns": f"SELECT * REPLACE ({_SEED_SQL.format(seeds=_list(SEEDS), id='(conv_id * 8 + turn_index)', text='content')} AS content), conv_id * 8 + turn_index AS n FROM turns",
    "memories": """SELECT *, CASE WHEN id % 7 != 0 THEN created_at + to_days((id % 3)::INT) END AS last_accessed, id % 23 AS access_count,
      CASE WHEN id % 10 = 0 THEN 'critical' WHEN id % 10 IN (1, 2) THEN 'high' WHEN id % 10 = 3 THEN 'low' ELSE 'normal' END AS impact, CASE WHEN id % 5 = 0 THEN 'ambient' ELSE 'inferred' END AS confidence,
      id % 17 = 0 AS is_deprecated, id % 50 = 0 AS pinned, CASE WHEN id % 13 = 0 THEN created_at + INTERVAL 20 DAY END AS ttl_expires
      FROM (SELECT doc_id AS id, text AS summary, source, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 40320) AS created_at FROM documents)""",
    "memory_pairs": "SELECT id AS a_id, id + 1 AS b_id, created_at + INTERVAL 1 DAY AS detected_at, id % 2 = 0 AS resolved FROM memories WHERE id % 11 = 0",
    "memory_entities": "SELECT id, created_at, unnest(list_distinct(list_transform(regexp_extract_all(summary, '[A-Za-z]{8,}'), lambda x: lower(x)))) AS entity FROM memories",
    "edges": "SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, CASE l_returnflag WHEN 'A' THEN 'USES' WHEN 'N' THEN 'RUNS_ON' ELSE 'DEPENDS_ON' END AS predicate, count(*) AS obs, max(l_shipdate) AS last_confirmed FROM lineitem GROUP BY ALL",
    "live_edges": f"SELECT *, pow(2.0, -((epoch_us(TIMESTAMP '{EDGES_AS_OF}') - epoch_us(last_confirmed)) / 86400000000.0) / (14.0 * log2(obs + 1.0))) AS decay FROM edges WHERE last_confirmed <= TIMESTAMP '{EDGES_AS_OF}'",
    "retrievals": """SELECT conv_id, session_id, turn_index, content AS query, memory_id, d.text AS memory_text, k AS result_rank, 1.0::DOUBLE / k AS cosine_score,
      CASE WHEN conv_id >= 95 THEN 'FACTS' ELSE ['CONSTRAINTS', 'PROCEDURES', 'FACTS', NULL][(memory_id % 4 + 1)::INT] END AS packaged_bucket, ts AS created_at
      FROM (SELECT *, CASE WHEN k <= 3 THEN (conv_id * 31 + turn_index * 7 + k) % greatest(1, n // 10) ELSE ((conv_id * 31 + turn_index * 7) * 53 + k * 131) % greatest(1, n) END AS memory_id FROM (SELECT *, unnest(range(1, 6)) AS k FROM turns WHERE role = 'user'), (SELECT count(*) AS n FROM documents)) JOIN documents d ON d.doc_id = memory_id""",
    "responses": "SELECT q.session_id, q.turn_index, a.content AS response FROM turns q JOIN turns a ON a.session_id = q.session_id AND a.turn_index = q.turn_index + 1 WHERE q.role = 'user' AND a.role = 'assistant'",
    "proposals": f"SELECT session_id, turn_index, query, memory_id, result_rank, {_list(SOURCES)}[(memory_id % 10 + 1)::INT] AS source_type, memory_text AS content, ((memory_id * 37 + result_rank * 11) % 100) / 100.0::DOUBLE AS confidence, CAST(greatest(1, length(memory_text) // 4) AS BIGINT) AS token_est FROM retrievals",
    "episodes": """SELECT o_orderkey AS episode_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'abandoned' END AS outcome, o_orderdate AS started_at, turn_count, topics, entities,
      CASE WHEN o_orderkey % 3 = 0 THEN 'lesson ' || o_orderkey ELSE '' END AS lesson FROM orders JOIN (SELECT l_orderkey, count(*) AS turn_count, list_sort(list(DISTINCT p_brand || '-' || p_size)) AS topics, list_sort(list(DISTINCT 'S' || l_suppkey)) AS entities
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "audits": "SELECT event_id, event_id // 3 AS request, event_id % 3 AS auditor, CASE event_type WHEN 'error' THEN 'deny' WHEN 'view' THEN 'warn' ELSE 'approve' END AS verdict, 1 + event_id % 5 AS risk, event_id % 29 = 0 AS error, ts, user_id, event_type FROM events",
    "evidence": "SELECT event_id, user_id AS preference_id, ts, CASE event_type WHEN 'error' THEN 'challenges' ELSE 'supports' END AS direction, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'balanced' END AS pole, (1 + event_id % 10) / 10.0::DOUBLE AS confidence, event_type, value FROM events",
    "products": "SELECT p_partkey, p_name, 1 + p_partkey % 5 AS rating, coalesce(n, 0)::BIGINT AS review_count, p_retailprice AS price FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "goals": "SELECT o_orderkey AS title, CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'normal' ELSE 'low' END AS priority, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'active' END AS status, o_orderdate + INTERVAL 90 DAY AS deadline, o_orderdate FROM orders",
}
_NEEDS = {"sturns": ["turns"], "memory_pairs": ["memories"], "memory_entities": ["memories"], "live_edges": ["edges"], "retrievals": ["turns"], "responses": ["turns"], "proposals": ["turns", "retrievals"]}


def sql(names: str, body: str, **more: str) -> str:
    """A DuckDB query over the named views and further CTEs."""
    order: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            for y in [*_NEEDS.get(x, []), x]:
                if y not in order:
                    order.append(y)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
