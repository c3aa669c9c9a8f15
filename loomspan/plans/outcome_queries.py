"""Scoring loop queries: memory scores, labels, utility, promotions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import scores
from loomspan.operators import outcome
from loomspan.plans import views
from loomspan.plans.registry import query
from loomspan.plans.scalar_queries import SQL_CORRECTION, cover_sql, word_set
from loomspan.plans.views import AS_OF, sql

_AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{}})) / 86400000000.0)"
REC = f"CASE WHEN pinned THEN 1.0 WHEN last_accessed IS NULL THEN 0.1 ELSE exp(-{{}} * {_AGE.format('last_accessed')}) END::DOUBLE"
FREQ = "CASE WHEN access_count <= 0 THEN 0.0 ELSE least(1.0, ln(access_count + 1.0) / ln(20.0)) END::DOUBLE"
IMP = "CASE impact WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'normal' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.5 END::DOUBLE"
c = F.col


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir)
    days = views.days_since("last_accessed", AS_OF)
    return m.withColumns({"rec": scores.recency(days, c("pinned")), "slow": scores.recency(days, c("pinned"), 0.023), "freq": scores.frequency(c("access_count")), "imp": scores.impact_score(c("impact")), "auth": F.when(c("confidence") == "ambient", 0.3).otherwise(0.6)})


_M = f"SELECT *, {REC.format(0.05)} AS rec, {REC.format(0.023)} AS slow, {FREQ} AS freq, {IMP} AS imp, CASE WHEN confidence = 'ambient' THEN 0.3 ELSE 0.6 END::DOUBLE AS auth FROM memories"
_C1 = "(rec * 0.35 + freq * 0.20 + auth * 0.30 + {e} * 0.15)"
_C2 = "(rec * 0.30 + freq * 0.20 + auth * 0.30 + {e} * 0.15 + imp * 0.05)"


@query("d1_d2_recency_frequency", sql("memories", "SELECT id, round(rec, 6) AS recency, round(slow, 6) AS slow_recency, round(freq, 6) AS frequency FROM m", m=_M))
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round("rec", 6).alias("recency"), F.round("slow", 6).alias("slow_recency"), F.round("freq", 6).alias("frequency"))


@query("d3_d4_composites", sql("memories", f"SELECT id, round({_C1.format(e='0.0')}, 6) AS v1, round({_C2.format(e='0.0')} * greatest(0.8, least(1.5, 0.4 + 1.1 * imp)), 6) AS v2 FROM m", m=_M))
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (c("rec"), c("freq"), c("auth"), F.lit(0.0))
    return _scored(spark, sf_dir).select("id", F.round(scores.composite(*args), 6).alias("v1"), F.round(scores.composite_impact(*args, c("imp")), 6).alias("v2"))


_IDF = "SELECT entity, ln((SELECT count(*) FROM memories)::DOUBLE / count(DISTINCT id)) AS idf FROM memory_entities GROUP BY 1"
_BOOST = "SELECT id, least(1.0, sum(idf) / 8.0) AS boost FROM memory_entities JOIN idf USING (entity) GROUP BY 1"


def _boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    me, total = views.memory_entities(spark, sf_dir), views.memories(spark, sf_dir).count()
    idf = me.groupBy("entity").agg(F.log(F.lit(float(total)) / F.countDistinct("id")).alias("idf"))
    return me.join(idf, "entity").groupBy("id").agg(F.least(F.lit(1.0), F.sum("idf") / 8.0).alias("boost"))


@query("a8_entity_idf", sql("memory_entities memories", f"SELECT entity, round(idf, 6) AS idf FROM ({_IDF})"))
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = views.memories(spark, sf_dir).count()
    return views.memory_entities(spark, sf_dir).groupBy("entity").agg(F.round(F.log(F.lit(float(total)) / F.countDistinct("id")), 6).alias("idf"))


@query("a9_entity_boost", sql("memory_entities memories", "SELECT id, round(coalesce(boost, 0.0), 6) AS boost FROM memories LEFT JOIN boost USING (id)", idf=_IDF, boost=_BOOST))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.memories(spark, sf_dir).select("id").join(_boost(spark, sf_dir), "id", "left").select("id", F.round(F.coalesce("boost", F.lit(0.0)), 6).alias("boost"))


@query("d19_recompute", sql("memory_entities memories", f"SELECT id, round({_C2.format(e='coalesce(boost, 0.0)').replace('rec *', 'slow *')} * greatest(0.8, least(1.5, 0.4 + 1.1 * imp)), 6) AS composite FROM m LEFT JOIN boost USING (id) WHERE NOT is_deprecated", idf=_IDF, boost=_BOOST, m=_M))
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir).filter("not is_deprecated").join(_boost(spark, sf_dir), "id", "left")
    return m.select("id", F.round(scores.composite_impact(c("slow"), c("freq"), c("auth"), F.coalesce("boost", F.lit(0.0)), c("imp")), 6).alias("composite"))


@query("t1_active_by_composite", sql("memories", f"SELECT id, round({_C1.format(e='0.0')}, 6) AS composite FROM m WHERE NOT is_deprecated ORDER BY {_C1.format(e='0.0')} DESC NULLS LAST, id LIMIT 100", m=_M))
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir).filter("not is_deprecated").withColumn("composite", scores.composite(c("rec"), c("freq"), c("auth"), F.lit(0.0)))
    return m.orderBy(F.desc_nulls_last("composite"), "id").limit(100).select("id", F.round("composite", 6).alias("composite"))


@query("d7_protection", sql("memories", "SELECT id, CASE WHEN pinned THEN 'pinned' WHEN impact IN ('critical', 'high') THEN 'impact' WHEN is_deprecated THEN 'superseded' END AS reason FROM memories"))
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.memories(spark, sf_dir).select("id", F.when(c("pinned"), "pinned").when(c("impact").isin("critical", "high"), "impact").when(c("is_deprecated"), "superseded").alias("reason"))


@query("d13_review_view", sql("memories memory_pairs", f"""SELECT id, CASE WHEN contradicted THEN 'contradicted' WHEN {_AGE.format('coalesce(last_accessed, created_at)')} > 30 THEN 'stale' WHEN confidence = 'ambient' AND access_count < 2 THEN 'unproven' END AS review
  FROM (SELECT m.*, id IN (SELECT a_id FROM memory_pairs WHERE NOT resolved UNION ALL SELECT b_id FROM memory_pairs WHERE NOT resolved) AS contradicted FROM memories m) WHERE NOT is_deprecated AND (ttl_expires IS NULL OR ttl_expires > TIMESTAMP '{AS_OF}')"""))
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_pairs = views.memory_pairs(spark, sf_dir).filter("not resolved")
    ends = open_pairs.select(c("a_id").alias("id")).union(open_pairs.select("b_id")).distinct().withColumn("hit", F.lit(True))
    m = views.memories(spark, sf_dir).filter(~c("is_deprecated") & (c("ttl_expires").isNull() | (c("ttl_expires") > views.at(AS_OF)))).join(ends, "id", "left")
    age = views.days_since(F.coalesce("last_accessed", "created_at"), AS_OF)
    return m.select("id", F.when(c("hit"), "contradicted").when(age > 30, "stale").when((c("confidence") == "ambient") & (c("access_count") < 2), "unproven").alias("review"))


@query("j7_contradicted", sql("memories memory_pairs", "SELECT id FROM memories WHERE EXISTS (SELECT 1 FROM memory_pairs p WHERE p.a_id = id OR p.b_id = id)"))
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = views.memory_pairs(spark, sf_dir).select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return views.memories(spark, sf_dir).select("id").join(ends, "id", "left_semi")


_LABELLED = f"""SELECT *, CASE WHEN correction AND overlap > 0.3 THEN 0.0 WHEN overlap > 0.5 THEN 1.0 WHEN overlap > 0.2 THEN 0.5 ELSE 0.1 END::DOUBLE AS label FROM (SELECT r.*, {cover_sql('wa', 'wb')} AS overlap FROM (
  SELECT r.*, {word_set('memory_text')} AS wa, {word_set("CASE WHEN memory_id % 3 = 0 THEN memory_text || ' ' || response ELSE response END")} AS wb, coalesce({SQL_CORRECTION.replace('content', 'n.content')}, false) AS correction
  FROM retrievals r JOIN responses p ON p.session_id = r.session_id AND p.turn_index = r.turn_index LEFT JOIN turns n ON n.session_id = r.session_id AND n.turn_index = r.turn_index + 2 AND n.role = 'assistant') r)"""
_DELTA = "CASE WHEN label <= 0.05 THEN -1.0 WHEN label >= 0.9 AND coalesce(packaged_bucket, '') = 'CONSTRAINTS' THEN 3.0 WHEN label >= 0.9 THEN 2.0 WHEN label > 0.3 THEN 0.5 WHEN result_rank > 3 THEN -0.10 ELSE -0.25 END::DOUBLE"
_UTIL = f"""SELECT memory_id, score, n, useful, partial, irrelevant, harmful, last_seen, dominant, round(coalesce(k, 0) / n::DOUBLE, 3) AS share, CASE WHEN coalesce(dominant = 'CONSTRAINTS', false) THEN greatest(0.75, ramp) ELSE ramp END AS factor FROM (
  SELECT *, CASE WHEN n < 3 THEN 1.0 WHEN n < 6 THEN 1.0 + (n - 3) / 3.0 * (raw - 1.0) ELSE raw END::DOUBLE AS ramp FROM (SELECT *, greatest(0.5, least(1.2, 0.85 + score / 10.0)) AS raw FROM (SELECT memory_id, sum({_DELTA}) AS score, count(*) AS n,
  count(*) FILTER (label >= 0.9) AS useful, count(*) FILTER (label > 0.3 AND label < 0.9) AS partial, count(*) FILTER (label > 0.05 AND label <= 0.3) AS irrelevant, count(*) FILTER (label <= 0.05) AS harmful, max(created_at) AS last_seen FROM labelled GROUP BY 1) u
  LEFT JOIN (SELECT memory_id, packaged_bucket AS dominant, k FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY k DESC, first, packaged_bucket) AS r FROM (SELECT memory_id, packaged_bucket, count(*) AS k, min(created_at) AS first FROM labelled WHERE packaged_bucket IS NOT NULL GROUP BY ALL)) WHERE r = 1) USING (memory_id)))"""
V = "turns retrievals responses"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.label(views.retrievals(spark, sf_dir), views.responses(spark, sf_dir), views.turns(spark, sf_dir))


@query("d9_outcome_labels", sql(V, f"SELECT session_id, turn_index, memory_id, result_rank, round(overlap, 6) AS overlap, correction, label, {_DELTA} AS delta FROM labelled", labelled=_LABELLED))
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = scores.utility_delta(c("label"), c("result_rank"), c("packaged_bucket"))
    return _labelled(spark, sf_dir).select("session_id", "turn_index", "memory_id", "result_rank", F.round("overlap", 6).alias("overlap"), "correction", "label", delta.alias("delta"))


@query("a5_rolling_utility", sql(V, "SELECT memory_id, round(score, 6) AS score, n, useful, partial, irrelevant, harmful, dominant, share, round(factor, 6) AS factor, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM util", labelled=_LABELLED, util=_UTIL))
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = outcome.utility(_labelled(spark, sf_dir))
    return u.withColumns({"score": F.round("score", 6), "factor": F.round("factor", 6), "last_seen": views.stamp("last_seen")})


@query("d10_promotions", sql(V, """SELECT memory_id, current, suggested, n, round(use_rate, 6) AS use_rate FROM (SELECT u.*, current, (useful + partial) / n::DOUBLE AS use_rate, CASE WHEN dominant = 'CONSTRAINTS' AND current != 'CONSTRAINTS' THEN 'CONSTRAINTS' WHEN dominant = 'PROCEDURES' AND current = 'FACTS' THEN 'PROCEDURES' END AS suggested
  FROM util u JOIN (SELECT memory_id, arg_max(packaged_bucket, (created_at, result_rank)) AS current FROM retrievals WHERE packaged_bucket IS NOT NULL GROUP BY 1) USING (memory_id) WHERE n >= 5 AND share >= 0.8) WHERE use_rate >= 0.7 AND suggested IS NOT NULL""", labelled=_LABELLED, util=_UTIL))
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outcome.promotions(outcome.utility(_labelled(spark, sf_dir)), views.retrievals(spark, sf_dir))
    return out.select("memory_id", "current", "suggested", "n", F.round("use_rate", 6).alias("use_rate"))


@query("a4_label_distribution", sql(V, "SELECT packaged_bucket, count(*) AS n, count(*) FILTER (label >= 0.9) AS useful, count(*) FILTER (label > 0.3 AND label < 0.9) AS partial, count(*) FILTER (label <= 0.3) AS rest, count(DISTINCT memory_id) AS memories FROM labelled GROUP BY 1", labelled=_LABELLED))
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = c("label")
    return _labelled(spark, sf_dir).groupBy("packaged_bucket").agg(F.count("*").alias("n"), F.count_if(x >= 0.9).alias("useful"), F.count_if((x > 0.3) & (x < 0.9)).alias("partial"), F.count_if(x <= 0.3).alias("rest"), F.countDistinct("memory_id").alias("memories"))


@query("a3_correction_rate", sql(V, "SELECT round(count(*) FILTER (correction) / count(*)::DOUBLE, 6) AS rate, count(*) AS n FROM labelled WHERE created_at > TIMESTAMP '2024-01-03'", labelled=_LABELLED))
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _labelled(spark, sf_dir).filter(c("created_at") > views.at("2024-01-03 00:00:00"))
    return recent.agg(F.round(F.try_divide(F.count_if("correction"), F.count("*")), 6).alias("rate"), F.count("*").alias("n"))


@query("a7_ignored_constraints", sql(V, "SELECT memory_id, count(*) AS ignored, round(avg(label), 6) AS mean_label FROM labelled WHERE packaged_bucket = 'CONSTRAINTS' AND label <= 0.3 GROUP BY 1 HAVING count(*) >= 2 ORDER BY ignored DESC, memory_id LIMIT 20", labelled=_LABELLED))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _labelled(spark, sf_dir).filter((c("packaged_bucket") == "CONSTRAINTS") & (c("label") <= 0.3)).groupBy("memory_id").agg(F.count("*").alias("ignored"), F.round(F.avg("label"), 6).alias("mean_label"))
    return bad.filter("ignored >= 2").orderBy(F.desc("ignored"), "memory_id").limit(20)


@query("t4_best_and_worst", sql(V, "SELECT * FROM (SELECT 'best' AS side, memory_id, round(score, 6) AS score FROM util ORDER BY util.score DESC, memory_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS side, memory_id, round(score, 6) AS score FROM util ORDER BY util.score, memory_id LIMIT 5)", labelled=_LABELLED, util=_UTIL))
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = outcome.utility(_labelled(spark, sf_dir)).withColumn("score", F.round("score", 9))
    side = lambda name, order: u.orderBy(order, "memory_id").limit(5).select(F.lit(name).alias("side"), "memory_id", F.round("score", 6).alias("score"))
    return side("best", F.desc("score")).union(side("worst", F.asc("score")))


@query("j1_unlabelled_pairs", sql(V, "SELECT r.session_id, r.turn_index, r.memory_id, length(response) AS n FROM retrievals r JOIN responses USING (session_id, turn_index) WHERE r.packaged_bucket IS NULL"))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.retrievals(spark, sf_dir).filter("packaged_bucket IS NULL").join(views.responses(spark, sf_dir), ["session_id", "turn_index"]).select("session_id", "turn_index", "memory_id", F.char_length("response").cast("long").alias("n"))


@query("j2_next_turn", sql("turns", "SELECT session_id, turn_index, lead(role) OVER w AS next_role, length(lead(content) OVER w) AS next_length FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)"))
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn_index")
    return views.turns(spark, sf_dir).select("session_id", "turn_index", F.lead("role").over(w).alias("next_role"), F.char_length(F.lead("content").over(w)).cast("long").alias("next_length"))


@query("j17_latest_bucket", sql("retrievals", "SELECT memory_id, arg_max(packaged_bucket, (created_at, result_rank)) AS current FROM retrievals WHERE packaged_bucket IS NOT NULL GROUP BY 1"))
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.retrievals(spark, sf_dir).filter("packaged_bucket IS NOT NULL").groupBy("memory_id").agg(F.max_by("packaged_bucket", F.struct("created_at", "result_rank")).alias("current"))


@query("r28_access_tracking", sql("memories retrievals", "SELECT id, access_count + coalesce(n, 0) AS access_count, strftime(greatest(last_accessed, ts), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM memories LEFT JOIN (SELECT memory_id, count(*) AS n, max(created_at) AS ts FROM retrievals GROUP BY 1) ON memory_id = id"))
def r28(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = views.retrievals(spark, sf_dir).groupBy(c("memory_id").alias("id")).agg(F.count("*").alias("n"), F.max("created_at").alias("ts"))
    return views.memories(spark, sf_dir).join(used, "id", "left").select("id", (c("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"), views.stamp(F.greatest("last_accessed", "ts")).alias("last_accessed"))


@query("d14_nearest_deadline", sql("goals", "SELECT priority, round(min((epoch_us(deadline) - epoch_us(TIMESTAMP '2000-01-01')) / 86400000000.0), 6) AS days FROM goals WHERE status = 'active' AND deadline > TIMESTAMP '2000-01-01' GROUP BY 1"))
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.goals(spark, sf_dir).filter((c("status") == "active") & (c("deadline") > views.at("2000-01-01 00:00:00")))
    return g.groupBy("priority").agg(F.round(F.min(-views.days_since("deadline", "2000-01-01 00:00:00")), 6).alias("days"))


@query("t2_priority_order", sql("goals", "SELECT title, priority FROM goals WHERE status = 'active' ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, o_orderdate DESC, title LIMIT 50"))
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(c("priority") == "critical", 0).when(c("priority") == "high", 1).when(c("priority") == "normal", 2).otherwise(3)
    return views.goals(spark, sf_dir).filter("status = 'active'").orderBy(order, F.desc("o_orderdate"), "title").limit(50).select("title", "priority")


@query("d17_pin", sql("memories", "SELECT id, pinned OR id % 9 = 0 AS pinned, CASE WHEN pinned OR id % 9 = 0 THEN 1.0 ELSE round(rec, 6) END::DOUBLE AS recency FROM m", m=_M))
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir)
    changes = m.filter("id % 9 = 0").select("id", F.lit(True).alias("pin"))
    out = m.join(changes, "id", "left").withColumn("pinned", c("pinned") | F.coalesce("pin", F.lit(False)))
    return out.select("id", "pinned", F.when(c("pinned"), 1.0).otherwise(F.round("rec", 6)).alias("recency"))
