"""Retrieval, ranking, mining and knowledge queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import rules, scores, text
from loomspan.operators import knowledge, rank
from loomspan.plans import views
from loomspan.plans.outcome_queries import FREQ, REC
from loomspan.plans.registry import query
from loomspan.plans.scalar_queries import SQL_COMPLEXITY, q, shared, word_set
from loomspan.plans.views import AS_OF, EPISODES_AS_OF, sql
from loomspan.streaming import runs

c = F.col


@query("r1_vector_search", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
  SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(s, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) AS s
  FROM n a JOIN n b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 10""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's ten nearest by cosine."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    return rank.nearest(e, "vec_id % 100 = 0").withColumn("cosine", F.round("cosine", 6))


_ASK = "SELECT session_id || '-' || turn_index AS query_id, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+'))[1:8]) AS term FROM turns WHERE role = 'user'"
_IX = "SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY ALL"
_HITS = "SELECT query_id, id, count(*) AS matched, sum(tf * ln(1.0 + (SELECT count(*) FROM documents)::DOUBLE / df)) AS score FROM ask JOIN ix USING (term) JOIN (SELECT term, count(*) AS df FROM ix GROUP BY 1) USING (term) GROUP BY ALL"
_TOP = "SELECT query_id, id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM {}) WHERE r <= 10"


def _search(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    u = views.turns(spark, sf_dir).filter("role = 'user'")
    terms = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), 0)), 1, 8)
    asked = u.select(F.concat_ws("-", "session_id", "turn_index").alias("query_id"), F.explode(terms).alias("term"))
    index = runs.stored(rank.inverted_index(d, "doc_id", "text", asked), "index")
    return rank.search(index, asked, d.count(), every).withColumn("score", F.round("score", 6))


@query("r2_full_text_all", sql("turns", _TOP.format("(SELECT h.* FROM hits h JOIN (SELECT query_id, count(*) AS k FROM ask GROUP BY 1) USING (query_id) WHERE matched = k)"), ask=_ASK.replace("list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+'))[1:8]", "w[1:8]").replace("FROM turns WHERE role = 'user'", "FROM (SELECT session_id, turn_index, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]) AS w FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9_]+') AS l FROM turns WHERE role = 'user'))"), ix=_IX, hits=_HITS))
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, True)


@query("r3_full_text_any", sql("turns", _TOP.format("hits"), ask="SELECT session_id || '-' || turn_index AS query_id, unnest(w[1:8]) AS term FROM (SELECT session_id, turn_index, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]) AS w FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9_]+') AS l FROM turns WHERE role = 'user'))", ix=_IX, hits=_HITS))
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, False)


_RANKS = "SELECT 'chars' AS list, doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT 'source', doc_id, row_number() OVER (ORDER BY source, doc_id) FROM documents UNION ALL SELECT 'age', doc_id, row_number() OVER (ORDER BY doc_id DESC) FROM documents"


@query("a25_rank_fusion", f"WITH r AS ({_RANKS}), l AS (SELECT * FROM r WHERE rank <= 100) SELECT id, round(sum(1.0::DOUBLE / (60.0 + rank)), 6) AS fused FROM l GROUP BY 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    lists = [("chars", [F.desc("n_chars"), c("doc_id")]), ("source", [c("source"), c("doc_id")]), ("age", [F.desc("doc_id")])]
    out = None
    for name, order in lists:
        top = d.orderBy(*order).limit(100).select(F.lit(name).alias("list"), c("doc_id").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
        out = top if out is None else out.union(top)
    return rank.fuse(out).withColumn("fused", F.round("fused", 6))


_SIG = f"SELECT session_id, turn_index, memory_id, result_rank, cosine_score AS semantic, {REC.format(0.05)} AS recency, {FREQ} AS frequency, CASE WHEN memory_id % 4 = 0 THEN 1.0 ELSE 0.3 END::DOUBLE AS working_mode FROM retrievals JOIN memories ON id = memory_id"


def _w(name: str) -> str:
    w = rules.WEIGHTS[name]
    return f"round((greatest(0.15, semantic * {w['semantic']}) + recency * {w['recency']} + frequency * {w['frequency']} + working_mode * {w['working_mode']}) * 1.0, 4)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir).select(c("id").alias("memory_id"), scores.recency(views.days_since("last_accessed", AS_OF), c("pinned")).alias("recency"), scores.frequency(c("access_count")).alias("frequency"))
    r = views.retrievals(spark, sf_dir).join(m, "memory_id")
    return r.select("session_id", "turn_index", "memory_id", "result_rank", c("cosine_score").alias("semantic"), "recency", "frequency", F.when(c("memory_id") % 4 == 0, 1.0).otherwise(0.3).alias("working_mode"))


def _salience(name: str) -> F.Column:
    return rank.salience({s: c(s) for s in ("semantic", "recency", "frequency", "working_mode")}, rules.WEIGHTS[name], F.lit(0.0), F.lit(1.0))


@query("r5_salience", sql("retrievals memories", f"SELECT session_id, turn_index, memory_id, result_rank, {_w('default')}::DOUBLE AS salience FROM sig", sig=_SIG))
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("session_id", "turn_index", "memory_id", "result_rank", _salience("default").alias("salience"))


@query("r6_weight_profiles", sql("retrievals memories", " UNION ALL ".join(f"SELECT {q(n)} AS profile, memory_id, round(sum({_w(n)}), 4)::DOUBLE AS total_salience FROM sig GROUP BY memory_id" for n in rules.WEIGHTS), sig=_SIG))
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("profile"), _salience(n).alias("s")) for n in rules.WEIGHTS])
    x = _signals(spark, sf_dir).select("memory_id", F.explode(each).alias("p"))
    return x.groupBy("p.profile", "memory_id").agg(F.round(F.sum("p.s"), 4).alias("total_salience"))


@query("w14_rank_movement", sql("retrievals memories", f"SELECT session_id, turn_index, memory_id, result_rank, CAST(a - b AS INTEGER) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY {_w('default')} DESC, result_rank) AS a, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY {_w('recency-heavy')} DESC, result_rank) AS b FROM sig)", sig=_SIG))
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda n: F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy(_salience(n).desc(), "result_rank"))
    return _signals(spark, sf_dir).withColumns({"a": place("default"), "b": place("recency-heavy")}).select("session_id", "turn_index", "memory_id", "result_rank", (c("a") - c("b")).alias("moved"))


_WS = word_set("memory_text")
_CAND = f"SELECT session_id, turn_index, result_rank AS pos, memory_id AS id, cosine_score AS score, {_WS} AS words FROM retrievals"
_JAC = f"CASE WHEN len(c.words) = 0 OR len(p.words) = 0 THEN 0.0::DOUBLE ELSE {shared('c.words', 'p.words')} / len(list_distinct(list_concat(c.words, p.words)))::DOUBLE END"
_K = "session_id, turn_index"


def _mmr_sql(limit: int = 3, cand: str = _CAND, x: str = "") -> dict[str, str]:
    """CTEs of the greedy picks: m1, m2 ... of candidates (keys, pos, id, score, words), all names with prefix x."""
    first = f"SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY round(0.7 * score, 9) DESC, pos) AS r FROM {x}cand"
    out = {f"{x}cand": cand, f"{x}m1": f"SELECT {_K}, pos, id, words, round(0.7 * score, 9) AS mmr, 1 AS rank FROM ({first}) WHERE r = 1"}
    for n in range(2, limit + 1):
        out[f"{x}p{n}"] = " UNION ALL ".join(f"SELECT * FROM {x}m{i}" for i in range(1, n))
        value = f"""SELECT c.session_id, c.turn_index, c.pos, c.id, c.words, round(0.7 * c.score - 0.3 * max({_JAC}), 9) AS v
          FROM {x}cand c JOIN {x}p{n} p ON p.session_id = c.session_id AND p.turn_index = c.turn_index
          GROUP BY c.session_id, c.turn_index, c.pos, c.id, c.words, c.score HAVING NOT bool_or(p.pos = c.pos)"""
        ranked = f"SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY v DESC, pos) AS r FROM ({value})"
        out[f"{x}m{n}"] = f"SELECT {_K}, pos, id, words, v AS mmr, {n} AS rank FROM ({ranked}) WHERE r = 1"
    return out


@query("r9_diverse_rerank", sql("retrievals", f"SELECT {_K}, CAST(rank AS INTEGER) AS rank, id, round(mmr, 6) AS mmr FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)", **_mmr_sql()))
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = views.retrievals(spark, sf_dir).select("session_id", "turn_index", c("result_rank").alias("pos"), c("memory_id").alias("id"), c("cosine_score").alias("score"), text.word_set(c("memory_text")).alias("words"))
    return rank.diverse(cand, ["session_id", "turn_index"]).withColumn("mmr", F.round("mmr", 6))


_BASE = "CASE source_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.BASE_THRESHOLDS.items()) + " END::DOUBLE"
_T1 = f"CASE cx WHEN 'complex' THEN greatest(0.20, {_BASE} - 0.10) WHEN 'trivial' THEN least(0.90, {_BASE} + 0.20) ELSE {_BASE} END"
_T2 = f"CASE WHEN turn_index = 0 THEN greatest(0.20, {_T1} - 0.15) ELSE {_T1} END"
_T3 = f"CASE WHEN days <= 3 AND source_type IN ('narrative', 'open_question', 'peripheral') THEN greatest(0.20, {_T2} - 0.15) ELSE {_T2} END"
_T4 = f"CASE WHEN rate > 0.10 THEN least(0.90, {_T3} + 0.05) ELSE {_T3} END"
_CX = SQL_COMPLEXITY.replace("content", "query")
_GATED = f"SELECT *, coalesce({_T4}, 0.50)::DOUBLE AS threshold FROM (SELECT *, {_CX} AS cx, turn_index % 7 AS days, CASE WHEN session_id LIKE '%3' THEN 0.2 ELSE 0.0 END AS rate FROM proposals)"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.proposals(spark, sf_dir).withColumns({"cx": text.complexity(F.regexp_replace("query", "[À-ɏ]", "x")), "days": c("turn_index") % 7, "rate": F.when(F.endswith("session_id", F.lit("3")), 0.2).otherwise(0.0)})
    return p.withColumn("threshold", rank.thresholds(c("cx"), c("turn_index") == 0, c("days"), c("rate"), c("source_type")))


@query("r11_adaptive_thresholds", sql("proposals", "SELECT session_id, turn_index, memory_id, result_rank, source_type, round(threshold, 6) AS threshold, round(confidence, 9) >= round(threshold, 9) AS cleared FROM g", g=_GATED))
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("session_id", "turn_index", "memory_id", "result_rank", "source_type", F.round("threshold", 6).alias("threshold"), (F.round("confidence", 9) >= F.round("threshold", 9)).alias("cleared"))


_CAP = "CASE source_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.TOKEN_CAPS.items()) + " ELSE 300 END"
_PRIO = "CASE source_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in rules.PRIORITY.items()) + " ELSE 99 END"
_ORD = f"SELECT *, {_CAP}::BIGINT AS cap, row_number() OVER (PARTITION BY {_K} ORDER BY {_PRIO}, -confidence, result_rank) AS i FROM proposals"
_ADM = """SELECT session_id, turn_index, 0::BIGINT AS i, 120::BIGINT AS room, MAP {}::MAP(VARCHAR, BIGINT) AS used, NULL::BIGINT AS memory_id, false AS ok FROM (SELECT DISTINCT session_id, turn_index FROM ord) UNION ALL
  SELECT o.session_id, o.turn_index, o.i, CASE WHEN f THEN room - token_est ELSE room END, CASE WHEN f THEN map_concat(used, MAP {source_type: u + token_est}) ELSE used END, o.memory_id, f FROM (SELECT o.*, a.room, a.used, coalesce(a.used[o.source_type], 0) AS u, coalesce(a.used[o.source_type], 0) + o.token_est <= o.cap AND o.token_est <= a.room AS f
  FROM adm a JOIN ord o ON o.session_id = a.session_id AND o.turn_index = a.turn_index AND o.i = a.i + 1) o"""


@query("r12_budgeted_admission", sql("proposals", "SELECT session_id, turn_index, CAST(row_number() OVER (PARTITION BY session_id, turn_index ORDER BY i) - 1 AS INTEGER) AS place, memory_id FROM adm WHERE ok", ord=_ORD, adm=_ADM).replace("WITH ", "WITH RECURSIVE ", 1))
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.admit(views.proposals(spark, sf_dir), ["session_id", "turn_index"], 120).select("session_id", "turn_index", "place", "memory_id")


@query("r14_gate_statistics", sql("proposals", "SELECT source_type, count(*) AS proposed, count(*) FILTER (round(confidence, 9) >= round(threshold, 9)) AS cleared, count(*) FILTER (round(confidence, 9) < round(threshold, 9)) AS below FROM g GROUP BY 1", g=_GATED))
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.round("confidence", 9) >= F.round("threshold", 9)
    return _gated(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("proposed"), F.count_if(ok).alias("cleared"), F.count_if(~ok).alias("below"))


@query("r20_session_buffer", sql("turns", f"SELECT session_id, turn_index, other, round(cov, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY round(cov, 9) DESC, other) AS r FROM (SELECT a.session_id, a.turn_index, b.turn_index AS other, {shared('a.w', 'b.w')} / len(a.w)::DOUBLE AS cov FROM t a JOIN t b ON a.session_id = b.session_id AND b.turn_index < a.turn_index AND b.turn_index >= a.turn_index - 20 WHERE len(a.w) > 0) WHERE cov > 0.10) WHERE r <= 3", t=f"SELECT session_id, turn_index, {word_set('content')} AS w FROM turns"))
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir).select("session_id", "turn_index", text.word_set(c("content")).alias("w"))
    o = t.select("session_id", c("turn_index").alias("other"), c("w").alias("v"))
    pairs = t.join(o, "session_id").filter((c("other") < c("turn_index")) & (c("other") >= c("turn_index") - 20)).withColumn("cov", text.coverage(c("w"), c("v"))).filter("cov > 0.10")
    r = F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy(F.round("cov", 9).desc(), "other"))
    return pairs.withColumn("r", r).filter("r <= 3").select("session_id", "turn_index", "other", F.round("cov", 6).alias("coverage"))


_EP = "SELECT *, unnest(topics) AS topic FROM episodes"


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.episodes(spark, sf_dir).withColumn("topic", F.explode("topics"))


@query("a12_topic_pairs", sql("episodes", "SELECT t1, t2, n FROM (SELECT a.topic AS t1, b.topic AS t2, count(*) AS n FROM t a JOIN t b ON a.episode_id = b.episode_id AND a.topic < b.topic GROUP BY ALL HAVING count(*) >= 2) ORDER BY n DESC, t1, t2 LIMIT 10", t=_EP))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.episodes(spark, sf_dir).withColumn("t1", F.explode("topics"))
    pairs = e.withColumn("t2", F.explode("topics")).filter("t1 < t2").groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n >= 2")
    return pairs.orderBy(F.desc("n"), "t1", "t2").limit(10)


@query("a13_momentum", sql("episodes", f"SELECT topic, days, n, round(done / n::DOUBLE, 2) AS completion, CASE WHEN days < 3 THEN 'active' WHEN days < 7 THEN 'cooling' ELSE 'stale' END AS status FROM (SELECT topic, (epoch_us(TIMESTAMP '{EPISODES_AS_OF}') - epoch_us(max(started_at))) // 86400000000 AS days, count(*) AS n, count(*) FILTER (outcome = 'completed') AS done FROM t GROUP BY 1)", t=_EP))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _topics(spark, sf_dir).groupBy("topic").agg(F.floor(views.days_since(F.max("started_at"), EPISODES_AS_OF)).alias("days"), F.count("*").alias("n"), F.count_if(c("outcome") == "completed").alias("done"))
    return g.select("topic", "days", "n", F.round(c("done") / c("n"), 2).alias("completion"), F.when(c("days") < 3, "active").when(c("days") < 7, "cooling").otherwise("stale").alias("status"))


@query("a14_trouble_entities", sql("episodes", "SELECT entity, n, round(done / n::DOUBLE, 6) AS completion FROM (SELECT entity, count(*) AS n, count(*) FILTER (outcome = 'completed') AS done FROM (SELECT outcome, unnest(entities) AS entity FROM episodes) GROUP BY 1) WHERE n >= 2 AND 1 - done / n::DOUBLE > 0.4 ORDER BY done / n::DOUBLE, entity LIMIT 10"))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.episodes(spark, sf_dir).select("outcome", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"), F.count_if(c("outcome") == "completed").alias("done"))
    rate = c("done") / c("n")
    return g.filter((c("n") >= 2) & (1 - rate > 0.4)).orderBy(rate, "entity").limit(10).select("entity", "n", F.round(rate, 6).alias("completion"))


@query("a15_session_complexity", sql("episodes", "SELECT topic, round(avg(turn_count), 6) AS avg_turns, max(turn_count) AS max_turns FROM t GROUP BY 1 HAVING count(*) >= 2", t=_EP))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).groupBy("topic").agg(F.round(F.avg("turn_count"), 6).alias("avg_turns"), F.max("turn_count").alias("max_turns"), F.count("*").alias("n")).filter("n >= 2").drop("n")


@query("a16_lesson_density", sql("episodes", "SELECT topic, count(*) AS lessons FROM t WHERE lesson != '' GROUP BY 1 ORDER BY lessons DESC, topic LIMIT 10", t=_EP))
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).filter("lesson != ''").groupBy("topic").agg(F.count("*").alias("lessons")).orderBy(F.desc("lessons"), "topic").limit(10)


@query("a18_model_candidates", sql("episodes", "SELECT entity, count(*) AS n FROM (SELECT unnest(entities) AS entity FROM episodes) GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, entity LIMIT 50"))
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.episodes(spark, sf_dir).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "entity").limit(50)


@query("t7_recent_lessons", sql("episodes", "SELECT episode_id, lesson FROM episodes WHERE lesson != '' ORDER BY started_at DESC, episode_id LIMIT 20"))
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.episodes(spark, sf_dir).filter("lesson != ''").orderBy(F.desc("started_at"), "episode_id").limit(20).select("episode_id", "lesson")


@query("j12_array_membership", sql("episodes", "SELECT episode_id, list_has_any(entities, ['S1', 'S7', 'S9']) AS related FROM episodes"))
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.episodes(spark, sf_dir).select("episode_id", F.arrays_overlap("entities", F.array(F.lit("S1"), F.lit("S7"), F.lit("S9"))).alias("related"))


@query("a17_entity_topics", sql("episodes", "SELECT entity, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, topic) AS r FROM (SELECT entity, topic, count(*) AS n FROM (SELECT entity, unnest(topics) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY started_at DESC, episode_id) AS k FROM (SELECT *, unnest(entities) AS entity FROM episodes)) WHERE k <= 10) GROUP BY ALL)) WHERE r <= 5"))
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.episodes(spark, sf_dir).select("episode_id", "started_at", "topics", F.explode("entities").alias("entity"))
    recent = e.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("started_at"), "episode_id"))).filter("k <= 10")
    n = recent.select("entity", F.explode("topics").alias("topic")).groupBy("entity", "topic").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "topic"))).filter("r <= 5").select("entity", "topic", "n")


_TOPIC_SQL = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'n': -len(regexp_extract_all(regexp_replace(text, '[À-ɏ]', 'x', 'g'), {q(p)}, 0, 'i')), 'i': {i}, 'topic': {q(t)}}}" for i, (t, p) in enumerate(rules.TOPICS)) + "], lambda s: s.n < 0)), lambda s: s.topic)"
_FW = f"SELECT doc_id, coalesce({_TOPIC_SQL}[1], 'general') AS topic, text, {word_set('text')} AS w FROM docs"


@query("g12_fact_invalidation", sql("docs", f"SELECT old, new, topic, round(ratio, 6) AS ratio FROM (SELECT a.doc_id AS old, b.doc_id AS new, a.topic, count(*) / least(len(a.w), len(b.w))::DOUBLE AS ratio FROM (SELECT *, unnest(w) AS x FROM f) a JOIN (SELECT *, unnest(w) AS x FROM f) b ON a.topic = b.topic AND a.x = b.x AND a.doc_id < b.doc_id WHERE a.text != b.text AND len(a.w) >= 3 AND len(b.w) >= 3 GROUP BY a.doc_id, b.doc_id, a.topic, len(a.w), len(b.w)) WHERE ratio > 0.6", f=_FW))
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.docs(spark, sf_dir).select("doc_id", F.get(text.topics(c("text")), F.lit(0)).alias("topic"), "text", text.word_set(c("text")).alias("w"))
    return knowledge.invalidations(f).withColumn("ratio", F.round("ratio", 6))


@query("g13_current_facts", sql("memories", "SELECT id, ttl_expires IS NULL OR ttl_expires > TIMESTAMP '2024-02-01' AS current FROM memories WHERE created_at <= TIMESTAMP '2024-01-20'"))
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir).filter(c("created_at") <= views.at("2024-01-20 00:00:00"))
    return m.select("id", (c("ttl_expires").isNull() | (c("ttl_expires") > views.at(AS_OF))).alias("current"))


@query("r18_topic_store", sql("docs", "SELECT topic, count(*) AS facts, count(DISTINCT text) AS distinct_facts FROM f GROUP BY 1", f=_FW))
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.docs(spark, sf_dir).groupBy(F.get(text.topics(c("text")), F.lit(0)).alias("topic")).agg(F.count("*").alias("facts"), F.countDistinct("text").alias("distinct_facts"))


@query("t3_top_per_bucket", sql("retrievals", "SELECT packaged_bucket, session_id, turn_index, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY packaged_bucket ORDER BY cosine_score DESC, conv_id, turn_index, result_rank) AS r FROM retrievals) WHERE r <= 5"))
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("packaged_bucket").orderBy(F.desc("cosine_score"), "conv_id", "turn_index", "result_rank"))
    return views.retrievals(spark, sf_dir).withColumn("r", r).filter("r <= 5").select("packaged_bucket", "session_id", "turn_index", "memory_id")


@query("u2_candidate_merge", sql("retrievals", "SELECT session_id, turn_index, memory_id, arg_min(source, o) AS source FROM (SELECT session_id, turn_index, memory_id, 'semantic' AS source, 1 AS o FROM retrievals WHERE result_rank <= 3 UNION ALL SELECT session_id, turn_index, memory_id, 'cooccurrence', 2 FROM retrievals WHERE packaged_bucket = 'FACTS' UNION ALL SELECT session_id, turn_index, memory_id, 'hop', 3 FROM retrievals) GROUP BY ALL"))
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.retrievals(spark, sf_dir)
    tag = lambda df, name, o: df.select("session_id", "turn_index", "memory_id", F.lit(name).alias("source"), F.lit(o).alias("o"))
    every = tag(r.filter("result_rank <= 3"), "semantic", 1).union(tag(r.filter("packaged_bucket = 'FACTS'"), "cooccurrence", 2)).union(tag(r, "hop", 3))
    return every.groupBy("session_id", "turn_index", "memory_id").agg(F.min_by("source", "o").alias("source"))


@query("j13_priority_resolution", """WITH al(alias, target) AS (SELECT 'alias ' || s_name, s_suppkey FROM supplier), q(name) AS (SELECT 'alias ' || s_name FROM supplier UNION ALL SELECT s_name FROM supplier UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT 'nobody')
  SELECT q.name, coalesce('S' || al.target, 'S' || s.s_suppkey, 'P' || p.k, 'new') AS resolved FROM (SELECT DISTINCT name FROM q) q LEFT JOIN al ON al.alias = q.name LEFT JOIN supplier s ON s.s_name = q.name LEFT JOIN (SELECT lower(p_name) AS n, min(p_partkey) AS k FROM part GROUP BY 1) p ON p.n = lower(q.name)""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = views.table(spark, sf_dir, "supplier"), views.table(spark, sf_dir, "part")
    alias = s.select(F.concat(F.lit("alias "), "s_name").alias("name"), F.concat(F.lit("S"), "s_suppkey").alias("by_alias"))
    exact = s.select(c("s_name").alias("name"), F.concat(F.lit("S"), "s_suppkey").alias("by_name"))
    folded = p.groupBy(F.lower("p_name").alias("low")).agg(F.concat(F.lit("P"), F.min("p_partkey")).alias("by_part"))
    asked = alias.select("name").union(exact.select("name")).union(p.select(F.upper("p_name"))).union(spark.range(1).select(F.lit("nobody"))).distinct()
    out = asked.join(alias, "name", "left").join(exact, "name", "left").withColumn("low", F.lower("name")).join(folded, "low", "left")
    return out.select("name", F.coalesce("by_alias", "by_name", "by_part", F.lit("new")).alias("resolved"))


@query("p28_lean_bars", "SELECT event_id, CASE WHEN v < 0.2 THEN 'Strongly leans toward a' WHEN v < 0.35 THEN 'Leans toward a' WHEN v < 0.45 THEN 'Slightly leans toward a' WHEN v <= 0.55 THEN 'Balanced between a and b' WHEN v <= 0.65 THEN 'Slightly leans toward b' WHEN v <= 0.8 THEN 'Leans toward b' ELSE 'Strongly leans toward b' END AS lean, '[' || repeat('=', floor(v * 20)::INT) || '|' || repeat('=', 20 - floor(v * 20)::INT) || ']' AS bar FROM (SELECT event_id, (event_id % 101) / 101.0::DOUBLE AS v FROM events)")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (c("event_id") % 101) / F.lit(101.0)
    return views.table(spark, sf_dir, "events").select("event_id", text.lean(v, "a", "b").alias("lean"), text.bar(v).alias("bar"))


@query("p35_bands", sql("edges", "SELECT count(*) FILTER (obs >= 3) AS often, count(*) FILTER (obs = 2) AS twice, count(*) FILTER (obs < 2) AS once FROM edges"))
def p35(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c("obs")
    return views.edges(spark, sf_dir).agg(F.count_if(o >= 3).alias("often"), F.count_if(o == 2).alias("twice"), F.count_if(o < 2).alias("once"))


@query("r26_signal_blocks", sql("memories", "SELECT impact, count(*) AS n, string_agg('- ' || substring(summary, 1, 40), chr(10) ORDER BY id) AS block FROM (SELECT *, row_number() OVER (PARTITION BY impact ORDER BY created_at DESC, id) AS r FROM memories) WHERE r <= 5 GROUP BY 1"))
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("impact").orderBy(F.desc("created_at"), "id"))).filter("r <= 5")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "summary"))), lambda x: F.concat(F.lit("- "), F.substring(x["summary"], 1, 40)))
    return m.groupBy("impact").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("block"))
