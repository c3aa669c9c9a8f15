"""Recall, packaging, knowledge and reporting queries with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import rules, text
from loomspan.operators import detect, graph, recall
from loomspan.plans import views
from loomspan.plans.detect_queries import _DRIFT
from loomspan.plans.fold_queries import CLUSTER_CTES, _recursive, leaves
from loomspan.plans.registry import query
from loomspan.plans.scalar_queries import SQL_BUCKET, SQL_BUCKET_CONF, q, shared, word_set, words
from loomspan.plans.views import sql

c = F.col


@query("p15_condense_fact", "SELECT doc_id, CASE WHEN length(text) < 200 THEN text ELSE substring(regexp_split_to_array(text, '[.!?]\\s+')[1], 1, 200) END AS fact FROM documents")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring(F.get(F.split("text", r"[.!?]\s+"), F.lit(0)), 1, 200)
    return views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") < 200, c("text")).otherwise(first).alias("fact"))


_ASKS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'find me 5 of the top red ' || event_type WHEN 1 THEN 'compare 3 ' || event_type || ' under $' || (event_id % 300 + 10) WHEN 2 THEN 'best 10 ' || event_type || ' over ' || (event_id % 90 + 10) WHEN 3 THEN event_type || ' between $' || (event_id % 90 + 10) || ' - $' || (event_id % 90 + 200) ELSE event_type END AS ask FROM events"


@query("p18_product_queries", f"""SELECT event_id, CAST(least(20, coalesce(try_cast(nullif(regexp_extract(ask, '\\b(\\d{{1,2}})\\b\\s+(of\\s+the\\s+(top|best)|(top|best))', 1), '') AS INT), try_cast(nullif(regexp_extract(ask, '(compare|find|show|get)\\s+(me\\s+)?(\\d{{1,2}})\\b', 3), '') AS INT), try_cast(nullif(regexp_extract(ask, '(top|best)\\s+(\\d{{1,2}})\\b', 2), '') AS INT), 5)) AS INTEGER) AS wanted,
  coalesce(try_cast(nullif(regexp_extract(ask, '\\$(\\d+)\\s*-\\s*\\$(\\d+)', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(ask, '(over|above|more\\s+than|at\\s+least)\\s+\\$?(\\d+)', 2), '') AS DOUBLE), 0.0) AS low,
  coalesce(try_cast(nullif(regexp_extract(ask, '\\$(\\d+)\\s*-\\s*\\$(\\d+)', 2), '') AS DOUBLE), try_cast(nullif(regexp_extract(ask, '(under|below|less\\s+than|max)\\s+\\$?(\\d+)', 2), '') AS DOUBLE), 0.0) AS high FROM ({_ASKS})""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = views.table(spark, sf_dir, "events"), c("event_id")
    ask = (
        F.when(i % 5 == 0, F.concat(F.lit("find me 5 of the top red "), "event_type")).when(i % 5 == 1, F.concat(F.lit("compare 3 "), "event_type", F.lit(" under $"), i % 300 + 10))
        .when(i % 5 == 2, F.concat(F.lit("best 10 "), "event_type", F.lit(" over "), i % 90 + 10)).when(i % 5 == 3, F.concat("event_type", F.lit(" between $"), i % 90 + 10, F.lit(" - $"), i % 90 + 200)).otherwise(c("event_type"))
    )
    e = e.select("event_id", ask.alias("ask"))

    def got(pattern: str, group: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract("ask", pattern, group), F.lit("")).try_cast(kind)

    n = F.coalesce(got(r"\b(\d{1,2})\b\s+(of\s+the\s+(top|best)|(top|best))", 1, "int"), got(r"(compare|find|show|get)\s+(me\s+)?(\d{1,2})\b", 3, "int"), got(r"(top|best)\s+(\d{1,2})\b", 2, "int"), F.lit(5))
    span = r"\$(\d+)\s*-\s*\$(\d+)"
    low = F.coalesce(got(span, 1, "double"), got(r"(over|above|more\s+than|at\s+least)\s+\$?(\d+)", 2, "double"), F.lit(0.0))
    high = F.coalesce(got(span, 2, "double"), got(r"(under|below|less\s+than|max)\s+\$?(\d+)", 2, "double"), F.lit(0.0))
    return e.select("event_id", F.least(F.lit(20), n).alias("wanted"), low.alias("low"), high.alias("high"))


@query("p39_name_dedup", sql("memory_entities", """SELECT id, array_to_string(list_sort(f.k), ',') AS names FROM (SELECT id, list_reduce(l, lambda s, r: {'n': r.n, 'k': CASE WHEN len(list_filter(s.k, lambda x: contains(x, r.n) OR contains(r.n, x))) > 0 THEN s.k ELSE list_append(s.k, r.n) END}, {'n': '', 'k': []::VARCHAR[]}) AS f
  FROM (SELECT id, list({'n': entity, 'k': []::VARCHAR[]} ORDER BY length(entity) DESC, entity) AS l FROM memory_entities GROUP BY 1))"""))
def p39(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.memory_entities(spark, sf_dir).groupBy("id").agg(F.collect_list("entity").alias("names"))  # twelve at most
    return g.select("id", F.array_join(recall.dedup_names(c("names")), ",").alias("names"))


_LATER = re.compile(r"[ \n\t]*")
_CH = "SELECT doc_id, 0 AS n, '' AS chunk, text AS rest FROM documents UNION ALL SELECT doc_id, n + 1, substring(rest, 1, sp), ltrim(substring(rest, sp + 1), ' ' || chr(10) || chr(9)) FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest) WHEN nl >= 250 THEN nl WHEN bl >= 250 THEN bl ELSE 500 END AS sp FROM (SELECT *, 500 - strpos(reverse(substring(rest, 1, 500)), chr(10)) * (strpos(substring(rest, 1, 500), chr(10)) > 0)::INT - 500 * (strpos(substring(rest, 1, 500), chr(10)) = 0)::INT AS nl, 500 - strpos(reverse(substring(rest, 1, 500)), ' ') * (strpos(substring(rest, 1, 500), ' ') > 0)::INT - 500 * (strpos(substring(rest, 1, 500), ' ') = 0)::INT AS bl FROM ch WHERE rest != '')) s"


@query("p19_message_chunks", f"WITH RECURSIVE ch AS ({_CH}) SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_no, chunk FROM ch WHERE n > 0")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from collections.abc import Iterator

    import pandas as pd

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, whole in zip(f.doc_id, f.text.fillna("")):
                n = start = 0
                while start < len(whole):
                    end = len(whole)
                    if end - start > 500:
                        end = next((p for p in (whole.rfind("\n", start, start + 500), whole.rfind(" ", start, start + 500)) if p >= start + 250), start + 500)
                    out.append((doc_id, n, whole[start:end]))
                    n, start = n + 1, _LATER.match(whole, end).end()
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "chunk"])

    return views.table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk_no int, chunk string")


@query("j4_memory_entities", sql("memory_entities memories", "SELECT m.id, entity, impact FROM memories m JOIN memory_entities e ON e.id = m.id WHERE impact = 'critical'"))
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir).filter("impact = 'critical'").select("id", "impact")
    return m.join(views.memory_entities(spark, sf_dir).select("id", "entity"), "id").select("id", "entity", "impact")


_NODES = "SELECT session_id, turn_start, turn_end, 0 AS depth, 20::BIGINT AS token_est FROM leaves UNION ALL SELECT session_id, min(turn_start), max(turn_end), 1, 25::BIGINT FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn_start) - 1) // 2 AS g FROM leaves) GROUP BY session_id, g HAVING count(*) = 2"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = leaves(spark, sf_dir)
    g = F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("turn_start")) - 1) / 2)
    up = flat.withColumn("g", g).groupBy("session_id", "g").agg(F.min("turn_start").alias("turn_start"), F.max("turn_end").alias("turn_end"), F.count("*").alias("n")).filter("n = 2")
    base = flat.select("session_id", "turn_start", "turn_end", F.lit(0).alias("depth"), F.lit(20).cast("long").alias("token_est"))
    return base.union(up.select("session_id", "turn_start", "turn_end", F.lit(1).alias("depth"), F.lit(25).cast("long").alias("token_est")))


@query("j9_interval_overlap", _recursive("SELECT session_id, turn_start, turn_end, CAST(depth AS INTEGER) AS depth FROM nodes WHERE turn_start <= 3 AND turn_end >= 1", nodes=_NODES))
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).filter((c("turn_start") <= 3) & (c("turn_end") >= 1)).select("session_id", "turn_start", "turn_end", "depth")


_PICK = """SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS used, []::STRUCT(a BIGINT, b BIGINT, d INT)[] AS kept FROM (SELECT DISTINCT session_id FROM nodes) UNION ALL
  SELECT session_id, i, CASE WHEN f THEN used + token_est ELSE used END, CASE WHEN f THEN list_append(kept, {'a': turn_start, 'b': turn_end, 'd': depth}) ELSE kept END FROM (SELECT o.*, p.used, p.kept, len(list_filter(p.kept, lambda k: k.a <= o.turn_end AND o.turn_start <= k.b)) = 0 AND p.used + o.token_est <= 60 AS f FROM pick p JOIN ord o ON o.session_id = p.session_id AND o.i = p.i + 1) s"""


@query("r16_recall", _recursive("SELECT session_id, k.a AS turn_start, k.b AS turn_end, k.d AS depth FROM (SELECT session_id, unnest(kept) AS k FROM (SELECT session_id, arg_max(kept, i) AS kept FROM pick GROUP BY 1))", nodes=_NODES, ord="SELECT *, depth::INT AS dd, row_number() OVER (PARTITION BY session_id ORDER BY turn_start DESC, depth DESC) AS i FROM nodes", pick=_PICK.replace("'d': depth", "'d': dd")))
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall(_nodes(spark, sf_dir), 60)


@query("r19_best_cover", _recursive("SELECT session_id, arg_max(turn_end, (depth, -turn_start)) AS turn_end, CAST(max(depth) AS INTEGER) AS depth FROM nodes WHERE turn_start <= 0 AND turn_end >= 0 GROUP BY 1", nodes=_NODES))
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = _nodes(spark, sf_dir).filter((c("turn_start") <= 0) & (c("turn_end") >= 0))
    return over.groupBy("session_id").agg(F.max_by("turn_end", F.struct("depth", (-c("turn_start")).alias("s"))).alias("turn_end"), F.max("depth").alias("depth"))


@query("a23_cluster_summary", sql("edges", "SELECT source, count(DISTINCT target) AS size, array_to_string(list_sort(list(DISTINCT target))[1:3], ',') AS label, arg_max(predicate, (n, predicate)) AS predicate FROM (SELECT source, target, predicate, count(*) OVER (PARTITION BY source, predicate) AS n FROM edges) GROUP BY 1"))
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir)
    n = e.groupBy("source", "predicate").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("predicate", F.struct("n", "predicate")).alias("predicate"))
    s = e.groupBy("source").agg(F.countDistinct("target").alias("size"), F.array_join(F.slice(F.array_sort(F.collect_set("target")), 1, 3), ",").alias("label"))
    return s.join(n, "source").select("source", "size", "label", "predicate")


@query("w1_terciles", sql("memory_entities", "SELECT entity, id, CAST(ntile(3) OVER (PARTITION BY entity ORDER BY created_at, id) AS INTEGER) AS third FROM memory_entities"))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.memory_entities(spark, sf_dir).select("entity", "id", F.ntile(3).over(Window.partitionBy("entity").orderBy("created_at", "id")).alias("third"))


@query("w5_result_rank", sql("retrievals", "SELECT session_id, turn_index, memory_id, CAST(row_number() OVER (PARTITION BY session_id, turn_index ORDER BY cosine_score DESC, result_rank) AS INTEGER) AS rank FROM retrievals"))
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy(F.desc("cosine_score"), "result_rank"))
    return views.retrievals(spark, sf_dir).select("session_id", "turn_index", "memory_id", r.alias("rank"))


@query("t8_filtered_listing", "SELECT p_partkey, p_size FROM part WHERE p_size > 25 ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 40")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").filter("p_size > 25").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "p_size")


@query("u3_neighbour_difference", sql("memory_entities", f"SELECT entity, CAST(gained AS INTEGER) AS gained, CAST(lost AS INTEGER) AS lost FROM ({_DRIFT})"))
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.topic_drift(views.memory_entities(spark, sf_dir), below=2.0, union=0).select("entity", "gained", "lost")


@query("u6_distinct_steps", sql("edges", "SELECT DISTINCT source, predicate FROM edges"))
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edges(spark, sf_dir).select("source", "predicate").distinct()


_CW = words("memory_text")


@query("r13_redundancy", sql("retrievals", f"""SELECT session_id, turn_index, unnest(list_transform(f.k, lambda x: x.id)) AS id FROM (SELECT session_id, turn_index, list_reduce(l, lambda s, r: {{'id': r.id, 'w': r.w, 'k': CASE WHEN len(list_filter(s.k, lambda x: len(list_intersect(x.w, r.w)) / greatest(least(len(x.w), len(r.w)), 1)::DOUBLE > 0.3)) > 0 THEN s.k ELSE list_append(s.k, {{'id': r.id, 'w': r.w}}) END}}, {{'id': 0::BIGINT, 'w': []::VARCHAR[], 'k': []::STRUCT(id BIGINT, w VARCHAR[])[]}}) AS f
  FROM (SELECT session_id, turn_index, list({{'id': memory_id, 'w': {_CW}, 'k': []::STRUCT(id BIGINT, w VARCHAR[])[]}} ORDER BY result_rank) AS l FROM retrievals GROUP BY ALL))"""))
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.retrievals(spark, sf_dir).select("session_id", "turn_index", c("result_rank").alias("pos"), c("memory_id").alias("id"), text.white_words(c("memory_text")).alias("words"))
    return recall.drop_redundant(rows, ["session_id", "turn_index"], 0.3)


@query("r21_packaged_buckets", sql("retrievals", f"SELECT session_id, turn_index, bucket, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index, bucket ORDER BY conf DESC, result_rank) AS r FROM (SELECT session_id, turn_index, memory_id, result_rank, {SQL_BUCKET} AS bucket, round({SQL_BUCKET_CONF} * (0.7 + 0.3 * cosine_score), 6) AS conf FROM (SELECT *, memory_text AS text FROM retrievals))) WHERE r <= 3"))
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory that a question meets is judged once, not once for each question."""
    met = views.retrieved(spark, sf_dir).select("session_id", "turn_index", "memory_id", c("k").cast("long").alias("result_rank"), (1.0 / c("k")).alias("cosine_score"))
    d = views.table(spark, sf_dir, "documents").select(c("doc_id").alias("memory_id"), "text").join(met.select("memory_id").distinct(), "memory_id", "left_semi")
    judged = d.select("memory_id", text.memory_bucket(c("text")).alias("b"))
    conf = F.round(c("b.confidence").cast("double") * (F.lit(0.7) + F.lit(0.3) * c("cosine_score")), 6)
    x = met.join(judged, "memory_id").select("session_id", "turn_index", "memory_id", "result_rank", "b.bucket", conf.alias("conf"))
    r = F.row_number().over(Window.partitionBy("session_id", "turn_index", "bucket").orderBy(F.desc("conf"), "result_rank"))
    return x.withColumn("r", r).filter("r <= 3").select("session_id", "turn_index", "bucket", "memory_id")


@query("r25_predictive_context", sql("episodes", "SELECT entity, topic, votes FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY votes DESC, topic) AS r FROM (SELECT entity, topic, count(*) + 0.5::DOUBLE * max((started_at > TIMESTAMP '2001-07-26')::INT) AS votes FROM (SELECT started_at, entity, unnest(topics) AS topic FROM (SELECT *, unnest(entities) AS entity FROM episodes)) GROUP BY ALL)) WHERE r <= 3"))
def r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.episodes(spark, sf_dir).select("started_at", "topics", F.explode("entities").alias("entity")).select("started_at", "entity", F.explode("topics").alias("topic"))
    active = F.max((c("started_at") > views.at("2001-07-26 00:00:00")).cast("int"))
    v = e.groupBy("entity", "topic").agg((F.count("*") + F.lit(0.5) * active).alias("votes"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("votes"), "topic"))).filter("r <= 3").select("entity", "topic", "votes")


@query("r27_task_lookup", sql("turns", "SELECT session_id, turn_index FROM turns WHERE ts < (SELECT max(ts) - INTERVAL 2 HOUR FROM turns) ORDER BY ts DESC, conv_id DESC, turn_index DESC LIMIT 30"))
def r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir)
    now = t.agg((F.max("ts") - F.expr("INTERVAL 2 HOUR")).alias("now"))
    return t.join(F.broadcast(now), c("ts") < c("now")).orderBy(F.desc("ts"), F.desc("conv_id"), F.desc("turn_index")).limit(30).select("session_id", "turn_index")  # one row


@query("r29_episode_input", sql("turns", "SELECT session_id, string_agg(role || ': ' || substring(content, 1, 300), chr(10) ORDER BY turn_index) AS input FROM (SELECT *, sum(least(length(content), 300)) OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS total FROM turns) WHERE total <= 1000 GROUP BY 1"))
def r29(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.least(F.char_length("content"), F.lit(300))).over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    t = views.turns(spark, sf_dir).withColumn("total", total).filter("total <= 1000")
    rows = F.array_sort(F.collect_list(F.struct("turn_index", F.concat("role", F.lit(": "), F.substring("content", 1, 300)).alias("t"))))
    return t.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("input"))


@query("g7_cluster_edges", sql("live_edges", "SELECT l.label, l.members, coalesce(i.edges, 0) AS edges FROM (SELECT label, count(*) AS members FROM l3 GROUP BY 1) l LEFT JOIN (SELECT a.label, count(*) AS edges FROM live_edges e JOIN l3 a ON a.node = e.source JOIN l3 b ON b.node = e.target WHERE a.label = b.label AND decay > 0.1 GROUP BY 1) i USING (label)", **CLUSTER_CTES))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = views.live_edges(spark, sf_dir)
    labels = graph.propagate(graph.qualified(live))
    a, b = labels.select(c("node").alias("source"), "label"), labels.select(c("node").alias("target"), c("label").alias("other"))
    inside = live.filter("decay > 0.1").join(a, "source").join(b, "target").filter("label = other").groupBy("label").agg(F.count("*").alias("edges"))
    members = labels.groupBy("label").agg(F.count("*").alias("members"))
    return members.join(inside, "label", "left").select("label", "members", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("g8_weighted_walk", sql("live_edges", "SELECT node, round(least(0.5, max(w)), 6) AS score FROM (SELECT other AS node, decay * 0.5 AS w FROM b WHERE node = 'S1' UNION ALL SELECT y.other, x.decay * 0.5 * y.decay * 0.5 FROM b x JOIN b y ON y.node = x.other WHERE x.node = 'S1') WHERE node != 'S1' GROUP BY 1", b="SELECT source AS node, target AS other, decay FROM live_edges WHERE decay > 0.01 UNION ALL SELECT target, source, decay FROM live_edges WHERE decay > 0.01"))
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = graph.both_ways(views.live_edges(spark, sf_dir).filter("decay > 0.01").select("source", "target", "decay"))
    one = b.filter("node = 'S1'").select(c("other").alias("node"), (c("decay") * 0.5).alias("w"))
    two = one.join(b, "node").select(c("other").alias("node"), (c("w") * c("decay") * 0.5).alias("w"))
    return one.union(two).filter("node != 'S1'").groupBy("node").agg(F.round(F.least(F.lit(0.5), F.max("w")), 6).alias("score"))


@query("g16_pattern_confirmation", sql("memory_entities episodes memories", "SELECT id, hits FROM (SELECT e.id, count(*) AS hits FROM memory_entities e JOIN (SELECT entity FROM memory_entities GROUP BY 1 HAVING count(*) >= 5) p USING (entity) GROUP BY 1 HAVING count(*) >= 2) WHERE id NOT IN (SELECT id FROM memories WHERE is_deprecated)"))
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    me = views.memory_entities(spark, sf_dir).select("id", "entity")
    pattern = me.groupBy("entity").agg(F.count("*").alias("n")).filter("n >= 5").select("entity")
    hits = me.join(pattern, "entity").groupBy("id").agg(F.count("*").alias("hits")).filter("hits >= 2")
    return hits.join(views.memories(spark, sf_dir).filter("is_deprecated").select("id"), "id", "left_anti")


@query("a32_run_summary", sql("memory_entities memories", f"SELECT 'drift' AS detector, count(*) AS found, count(*) AS stored, count(*) FILTER (overlap < 0.2) AS high FROM ({_DRIFT}) WHERE overlap < 0.35 AND either >= 3 UNION ALL SELECT 'critical', count(*), count(DISTINCT summary), count(*) FILTER (access_count >= 10) FROM memories WHERE impact = 'critical' AND NOT is_deprecated"))
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each detector the signals found, those stored (one for each text) and those of high priority."""
    drift = detect.topic_drift(views.memory_entities(spark, sf_dir)).select(F.lit("drift").alias("detector"), c("entity").alias("text"), (c("overlap") < 0.2).alias("high"))
    critical = views.memories(spark, sf_dir).filter("impact = 'critical' AND NOT is_deprecated").select(F.lit("critical").alias("detector"), c("summary").alias("text"), (c("access_count") >= 10).alias("high"))
    return drift.union(critical).groupBy("detector").agg(F.count("*").alias("found"), F.countDistinct(F.md5("text")).alias("stored"), F.count_if("high").alias("high"))


@query("j6_left_defaults", sql("memories retrievals", "SELECT id, CASE WHEN n IS NULL THEN 0.1 ELSE 0.3 END::DOUBLE AS keyscore, coalesce(f, 1.0)::DOUBLE AS factor, coalesce(n, 0) AS history FROM memories LEFT JOIN (SELECT memory_id AS id, count(*) AS n, round(avg(cosine_score), 6) AS f FROM retrievals GROUP BY 1) USING (id)"))
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with the key score, factor and history of their retrievals, and defaults without any."""
    seen = views.retrievals(spark, sf_dir).groupBy(c("memory_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("cosine_score"), 6).alias("f"))
    out = views.memories(spark, sf_dir).join(seen, "id", "left")
    return out.select("id", F.when(c("n").isNull(), 0.1).otherwise(0.3).alias("keyscore"), F.coalesce("f", F.lit(1.0)).alias("factor"), F.coalesce("n", F.lit(0)).alias("history"))


@query("a22_goal_word_rate", sql("sturns", f"SELECT session_id, turn_index, round(0.5 * least(1.0, coalesce(items, 0) / (SELECT count(*) FROM part)::DOUBLE) + 0.5 * coalesce(hits, 0) / greatest(1, len(w))::DOUBLE, 4) AS proximity FROM (SELECT session_id, turn_index, {word_set('content')} AS w FROM sturns WHERE role = 'user') LEFT JOIN (SELECT session_id, turn_index, count(DISTINCT p_partkey) AS items, count(DISTINCT x) AS hits FROM (SELECT session_id, turn_index, unnest({word_set('content')}) AS x FROM sturns WHERE role = 'user') JOIN (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS x FROM part) USING (x) GROUP BY ALL) USING (session_id, turn_index)"))
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    total = p.count()
    named = p.select("p_partkey", F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("x"))
    u = views.seeded_turns(spark, sf_dir).filter("role = 'user'").select("session_id", "turn_index", text.word_set(c("content")).alias("w"))
    hits = u.select("session_id", "turn_index", F.explode("w").alias("x")).join(named, "x").groupBy("session_id", "turn_index").agg(F.countDistinct("p_partkey").alias("items"), F.countDistinct("x").alias("hits"))
    score = F.least(F.lit(1.0), F.coalesce("items", F.lit(0)) / F.lit(float(max(1, total)))) * 0.5 + F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), F.size("w")) * 0.5
    return u.join(hits, ["session_id", "turn_index"], "left").select("session_id", "turn_index", F.round(score, 4).alias("proximity"))


@query("r7_open_question_boost", sql("retrievals sturns", f"SELECT r.session_id, r.turn_index, r.result_rank, CASE WHEN {shared(word_set('memory_text'), word_set('asked'))} >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS boost FROM retrievals r JOIN (SELECT session_id, turn_index, content AS asked FROM sturns) USING (session_id, turn_index)"))
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions meet their ranks before the memories, so that each memory's text is shuffled once, not once for each question."""
    asked = views.seeded_turns(spark, sf_dir).select("session_id", "turn_index", c("content").alias("asked"))
    met = views.retrieved(spark, sf_dir).select("session_id", "turn_index", "memory_id", c("k").cast("long").alias("result_rank")).join(asked, ["session_id", "turn_index"])
    memories = views.table(spark, sf_dir, "documents").select(c("doc_id").alias("memory_id"), c("text").alias("memory_text"))
    n = F.size(F.array_intersect(text.word_set(c("memory_text")), text.word_set(c("asked"))))
    return met.join(memories, "memory_id").select("session_id", "turn_index", "result_rank", F.when(n >= 2, 1.0).otherwise(0.0).alias("boost"))


@query("n10_pattern_candidates", sql("docs", f"SELECT doc_id, CASE WHEN {' OR '.join(f'text ILIKE {q(f'%{w}%')}' for w in rules.FAILURE_WORDS)} THEN 'failure' WHEN {' OR '.join(f'text ILIKE {q(f'%{w}%')}' for w in rules.PREFERENCE_WORDS)} THEN 'preference' END AS kind FROM docs"))
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda ws: text.any_of([c("text").ilike(f"%{w}%") for w in ws])
    return views.docs(spark, sf_dir).select("doc_id", F.when(hit(rules.FAILURE_WORDS), "failure").when(hit(rules.PREFERENCE_WORDS), "preference").alias("kind"))
