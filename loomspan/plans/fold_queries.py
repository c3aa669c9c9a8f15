"""Ordered folds and graph operators with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import folds, graph
from loomspan.plans import views
from loomspan.plans.registry import query
from loomspan.plans.views import sql

EV = "evidence"
_LIST = "list({} ORDER BY ts, event_id)"


@query("w9_moving_lean", sql(EV, f"""SELECT preference_id, round(list_reduce(l, lambda s, r: {{'w': r.w, 'o': r.o, 's': r.w * r.o + (1.0 - r.w) * s.s}}, {{'w': 0.0::DOUBLE, 'o': 0.0::DOUBLE, 's': 0.5::DOUBLE}}).s, 6) AS lean
  FROM (SELECT preference_id, {_LIST.format("{'w': 0.15 * confidence, 'o': CASE pole WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.0 ELSE 0.5 END::DOUBLE, 's': 0.0::DOUBLE}")} AS l FROM evidence GROUP BY 1)"""))
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.moving_lean(views.evidence(spark, sf_dir)).withColumn("lean", F.round("lean", 6))


_KIND = "CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'resolution' WHEN event_type = 'signup' THEN 'breakthrough' ELSE 'update' END"
_DELTA = "CASE event_type WHEN 'error' THEN -0.2 WHEN 'view' THEN 0.05 ELSE 0.15 END::DOUBLE"


@query("w10_arc_position", sql(EV, f"""SELECT preference_id, round(f.p, 6) AS position, f.st AS status FROM (SELECT preference_id, list_reduce(l, lambda s, r: {{'d': r.d, 'k': r.k, 'p': CASE WHEN r.k = 'resolution' THEN 1.0 ELSE greatest(0.0, least(1.0, s.p + r.d)) END::DOUBLE,
  'st': CASE WHEN r.k = 'resolution' THEN 'completed' WHEN r.k = 'breakthrough' AND greatest(0.0, least(1.0, s.p + r.d)) >= 0.7 THEN 'climax' ELSE s.st END}}, {{'d': 0.0::DOUBLE, 'k': '', 'p': 0.0::DOUBLE, 'st': 'active'}}) AS f
  FROM (SELECT preference_id, {_LIST.format(f"{{'d': {_DELTA}, 'k': {_KIND}, 'p': 0.0::DOUBLE, 'st': ''}}")} AS l FROM evidence GROUP BY 1))"""))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.evidence(spark, sf_dir)
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "resolution").when(F.col("event_type") == "signup", "breakthrough").otherwise("update")
    delta = F.when(F.col("event_type") == "error", -0.2).when(F.col("event_type") == "view", 0.05).otherwise(0.15)
    return folds.arc_position(e.withColumns({"kind": kind, "delta": delta})).withColumn("position", F.round("position", 6))


_UP, _DOWN = "(s.u + CASE WHEN r.y THEN 1 ELSE 0 END)", "(s.c + CASE WHEN r.y THEN 0 ELSE 1 END)"
_RUNG = " OR ".join(f"(s.l = {i} AND {_UP} >= {a} AND {_DOWN} / ({_UP} + {_DOWN})::DOUBLE < {b} AND (r.us - coalesce(s.f, r.us)) // 86400000000 >= {d})" for i, (a, b, d) in enumerate(folds.LADDER))


@query("w11_preference_ladder", sql(EV, f"""SELECT preference_id, f.l::INT AS level, f.u AS supports, f.c AS challenges FROM (SELECT preference_id, list_reduce(l, lambda s, r: {{'y': r.y, 'us': r.us, 'l': CASE WHEN r.y AND ({_RUNG}) THEN s.l + 1
  WHEN NOT r.y AND {_DOWN} / ({_UP} + {_DOWN})::DOUBLE > 0.40 AND s.l > 0 THEN s.l - 1 ELSE s.l END::BIGINT, 'u': {_UP}::BIGINT, 'c': {_DOWN}::BIGINT, 'f': coalesce(s.f, r.us)}}, {{'y': false, 'us': 0::BIGINT, 'l': 0::BIGINT, 'u': 0::BIGINT, 'c': 0::BIGINT, 'f': NULL::BIGINT}}) AS f
  FROM (SELECT preference_id, {_LIST.format("{'y': direction = 'supports', 'us': epoch_us(ts), 'l': 0::BIGINT, 'u': 0::BIGINT, 'c': 0::BIGINT, 'f': NULL::BIGINT}")} AS l FROM evidence GROUP BY 1))"""))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.preference_ladder(views.evidence(spark, sf_dir))


@query("w12_pattern_ladder", sql(EV, f"""SELECT preference_id, f.l::INT AS level, round(f.k, 6) AS confidence FROM (SELECT preference_id, list_reduce(l, lambda s, r: {{'y': r.y, 'u': {_UP}::BIGINT, 'c': {_DOWN}::BIGINT,
  'l': CASE WHEN r.y THEN greatest(s.l, CASE WHEN {_UP} >= 13 AND {_DOWN} / {_UP}::DOUBLE < 0.2 THEN 4 WHEN {_UP} >= 8 THEN 3 WHEN {_UP} >= 5 THEN 2 WHEN {_UP} >= 3 THEN 1 ELSE 0 END)
  WHEN {_UP} > 0 AND {_DOWN} / {_UP}::DOUBLE > 0.4 AND s.l > 0 THEN s.l - 1 ELSE s.l END::BIGINT, 'k': CASE WHEN r.y THEN least(1.0, s.k + 0.03) ELSE greatest(0.0, s.k - 0.05) END::DOUBLE}}, {{'y': false, 'u': 0::BIGINT, 'c': 0::BIGINT, 'l': 0::BIGINT, 'k': 0.5::DOUBLE}}) AS f
  FROM (SELECT preference_id, {_LIST.format("{'y': direction = 'supports', 'u': 0::BIGINT, 'c': 0::BIGINT, 'l': 0::BIGINT, 'k': 0.0::DOUBLE}")} AS l FROM evidence GROUP BY 1))"""))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pattern_ladder(views.evidence(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("w15_earn_back", sql("proposals", """SELECT session_id, source_type, round(list_reduce(l, lambda s, r: {'y': r.y, 'o': CASE WHEN r.y THEN greatest(-0.15, s.o - 0.03) ELSE least(0.15, s.o + 0.05) END::DOUBLE}, {'y': false, 'o': 0.0::DOUBLE}).o, 6) AS "offset"
  FROM (SELECT session_id, source_type, list({'y': confidence > 0.5, 'o': 0.0::DOUBLE} ORDER BY turn_index, result_rank) AS l FROM proposals GROUP BY ALL)"""))
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.proposals(spark, sf_dir).withColumn("useful", F.col("confidence") > 0.5)
    return folds.earn_back(p, ["session_id", "source_type"], ["turn_index", "result_rank"]).withColumn("offset", F.round("offset", 6))


LEAVES = """SELECT session_id, turn_start, turn_end FROM (SELECT session_id, mx, min(turn_index) AS turn_start, max(turn_index) AS turn_end, max(cut::INT) AS done FROM (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM (
  SELECT t.session_id, t.turn_index, t.mx, f.s >= 40 AS cut FROM (SELECT session_id, turn_index, row_number() OVER w AS i, max(turn_index) OVER (PARTITION BY session_id) AS mx FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)) t
  JOIN run f USING (session_id, i))) GROUP BY session_id, mx, grp) WHERE done = 1 AND turn_end < mx - 1"""
RUN = """SELECT session_id, 1::BIGINT AS i, token_est AS s FROM num WHERE i = 1 UNION ALL SELECT n.session_id, n.i, CASE WHEN r.s >= 40 THEN 0 ELSE r.s END + n.token_est FROM run r JOIN num n ON n.session_id = r.session_id AND n.i = r.i + 1"""
NUM = "SELECT session_id, token_est, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS i FROM turns"


def _recursive(body: str, **more: str) -> str:
    return sql("turns", body, num=NUM, run=RUN, leaves=LEAVES, **more).replace("WITH ", "WITH RECURSIVE ", 1)


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.leaf_ranges(views.turns(spark, sf_dir), tokens=40, tail=1)


@query("w3_leaf_ranges", _recursive("SELECT * FROM leaves"))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir)


def _rollup_sql(base: str, fan_in: int, depths: int = 4) -> dict[str, str]:
    out = {"n0": base}
    for d in range(1, depths + 1):
        out[f"n{d}"] = f"SELECT session_id, min(turn_start) AS turn_start, max(turn_end) AS turn_end FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn_start) - 1) // {fan_in} AS g FROM n{d - 1}) GROUP BY session_id, g HAVING count(*) = {fan_in}"
    return out


_ROLLED = " UNION ALL ".join(f"SELECT session_id, {d} AS depth, turn_start, turn_end FROM n{d}" for d in range(1, 5))


@query("w4_rollups", _recursive(_ROLLED, **_rollup_sql("SELECT * FROM leaves", 2)))
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rollups(leaves(spark, sf_dir), fan_in=2)


@query("w4_rollups_deep", sql("", _ROLLED, **_rollup_sql("SELECT user_id AS session_id, i AS turn_start, i AS turn_end FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)", 4)))
def w4_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a leaf of its user: fan-in 4 and four depths."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return folds.rollups(views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), i.alias("turn_start"), i.alias("turn_end")))


@query("j10_turns_in_leaves", _recursive("SELECT t.session_id, t.turn_index, l.turn_start IS NOT NULL AS covered FROM turns t LEFT JOIN leaves l ON l.session_id = t.session_id AND t.turn_index BETWEEN l.turn_start AND l.turn_end"))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, l = views.turns(spark, sf_dir), leaves(spark, sf_dir).withColumnRenamed("session_id", "s")  # noqa: E741
    return t.join(l, (F.col("session_id") == F.col("s")) & F.col("turn_index").between(F.col("turn_start"), F.col("turn_end")), "left").select("session_id", "turn_index", F.col("turn_start").isNotNull().alias("covered"))


@query("a20_context_pressure", _recursive("SELECT t.session_id, CAST(sum(CASE WHEN turn_index > coalesce(last, -1) THEN token_est ELSE 0 END) AS BIGINT) AS open_tokens, sum(CASE WHEN turn_index > coalesce(last, -1) THEN token_est ELSE 0 END) / 200.0 >= 0.75 AS pressed FROM turns t LEFT JOIN (SELECT session_id, max(turn_end) AS last FROM leaves GROUP BY 1) USING (session_id) GROUP BY 1"))
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = leaves(spark, sf_dir).groupBy("session_id").agg(F.max("turn_end").alias("last"))
    open_tokens = F.sum(F.when(F.col("turn_index") > F.coalesce("last", F.lit(-1)), F.col("token_est")).otherwise(0))
    return views.turns(spark, sf_dir).join(last, "session_id", "left").groupBy("session_id").agg(open_tokens.alias("open_tokens")).withColumn("pressed", F.col("open_tokens") / 200.0 >= 0.75)


_KEEP = "SELECT node FROM live GROUP BY node HAVING count(*) >= 2"
_LIVE = "SELECT source AS node, target AS other, decay * log2(obs + 1.0) AS weight FROM live_edges WHERE decay > 0.1 UNION ALL SELECT target, source, decay * log2(obs + 1.0) FROM live_edges WHERE decay > 0.1"
_ADJ = "SELECT node, other, weight FROM live WHERE node IN (SELECT node FROM keep) AND other IN (SELECT node FROM keep)"


@query("g3_edge_decay", sql("live_edges", "SELECT source, target, predicate, round(decay, 6) AS decay, CASE WHEN decay >= 0.7 THEN 'strong' WHEN decay >= 0.4 THEN 'active' WHEN decay >= 0.1 THEN 'fading' ELSE 'dead' END AS band FROM live_edges"))
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("decay")
    return views.live_edges(spark, sf_dir).select("source", "target", "predicate", F.round(d, 6).alias("decay"), F.when(d >= 0.7, "strong").when(d >= 0.4, "active").when(d >= 0.1, "fading").otherwise("dead").alias("band"))


@query("g5_qualified_adjacency", sql("live_edges", "SELECT node, other, round(weight, 6) AS weight FROM adj", live=_LIVE, keep=_KEEP, adj=_ADJ))
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.qualified(views.live_edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_ROUNDS = {"l0": "SELECT DISTINCT node, node AS label FROM adj"} | {
    f"l{i}": f"SELECT node, label FROM (SELECT v.node, v.label, row_number() OVER (PARTITION BY v.node ORDER BY votes DESC, v.label != o.label, v.label) AS r FROM (SELECT a.node, l.label, round(sum(weight), 9) AS votes FROM adj a JOIN l{i - 1} l ON l.node = a.other GROUP BY ALL) v JOIN l{i - 1} o ON o.node = v.node) WHERE r = 1"
    for i in (1, 2, 3)
}
CLUSTER_CTES = {"live": _LIVE, "keep": _KEEP, "adj": _ADJ, **_ROUNDS}


def _rounds(n: int) -> dict[str, str]:
    one = _ROUNDS["l1"]
    return {"l0": _ROUNDS["l0"]} | {f"l{i}": one.replace("l0 ", f"l{i - 1} ") for i in range(1, n + 1)}


@query("g6_label_propagation", sql("live_edges", "SELECT node, label FROM l50 WHERE label IN (SELECT label FROM l50 GROUP BY label HAVING count(*) >= 3)", live=_LIVE, keep=_KEEP, adj=_ADJ, **_rounds(50)).replace("adj AS (", "adj AS MATERIALIZED (").replace(" AS (SELECT node, label FROM (SELECT v.node", " AS MATERIALIZED (SELECT node, label FROM (SELECT v.node"))
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clusters(graph.propagate(graph.qualified(views.live_edges(spark, sf_dir)), rounds=50))


@query("g2_reinforcement", sql("edges", "SELECT source, target, predicate, CAST(coalesce(obs, 0) + coalesce(n, 0) AS BIGINT) AS obs, strftime(greatest(last_confirmed, ts), '%Y-%m-%d %H:%M:%S') AS last_confirmed FROM edges FULL JOIN seen USING (source, target, predicate)",
  seen="SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, 'USES' AS predicate, count(*) AS n, max(l_shipdate + INTERVAL 1 DAY) AS ts FROM lineitem WHERE l_quantity > 45 GROUP BY ALL"))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.lit("USES").alias("predicate"), views.plus(F.col("l_shipdate"), days=F.lit(1)).alias("ts"))
    return graph.reinforce(views.edges(spark, sf_dir), seen).withColumn("last_confirmed", views.stamp("last_confirmed"))


_BOTH = "SELECT source AS node, target AS other, predicate FROM edges UNION ALL SELECT target, source, predicate FROM edges"


@query("g4_walk", sql("edges", "SELECT * FROM w1 UNION ALL SELECT DISTINCT w.start, b.other AS node, b.predicate, 2 AS depth FROM (SELECT DISTINCT start, node FROM w1) w JOIN both_ways b ON b.node = w.node", both_ways=_BOTH, w1="SELECT DISTINCT node AS start, other AS node, predicate, 1 AS depth FROM both_ways WHERE node IN ('S1', 'S2', 'P7')"))
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([("S1",), ("S2",), ("P7",)], "start string")
    return graph.walk(views.edges(spark, sf_dir), starts)


@query("j8_neighbours", sql("edges", "SELECT node, count(*) AS links, count(DISTINCT other) AS others FROM both_ways GROUP BY node", both_ways=_BOTH))
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ways(views.edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("links"), F.countDistinct("other").alias("others"))


@query("a11_orphans", sql("live_edges", "SELECT p AS name, coalesce(n, 0) AS links FROM (SELECT 'P' || p_partkey AS p FROM part) LEFT JOIN (SELECT node, count(*) AS n FROM live GROUP BY 1) ON node = p WHERE coalesce(n, 0) < 2 ORDER BY links, name LIMIT 30", live=_LIVE))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = graph.both_ways(views.live_edges(spark, sf_dir).filter("decay > 0.1").select("source", "target")).groupBy("node").agg(F.count("*").alias("n"))
    parts = views.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    out = parts.join(live, parts.name == live.node, "left").select("name", F.coalesce("n", F.lit(0)).alias("links"))
    return out.filter("links < 2").orderBy("links", "name").limit(30)


@query("g9_relation_types", sql("edges", "SELECT node, CASE WHEN bool_or(predicate = 'USES' AND out) THEN 'agent' WHEN bool_or(predicate = 'RUNS_ON' AND NOT out) THEN 'infrastructure' WHEN bool_or(predicate = 'DEPENDS_ON' AND NOT out) THEN 'service' ELSE 'general' END AS kind FROM (SELECT source AS node, predicate, true AS out FROM edges UNION ALL SELECT target, predicate, false FROM edges) GROUP BY node"))
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("node"), "predicate", F.lit(True).alias("out")).union(e.select("target", "predicate", F.lit(False)))
    seen = lambda p, out: F.bool_or((F.col("predicate") == p) & (F.col("out") == out))
    return ends.groupBy("node").agg(F.when(seen("USES", True), "agent").when(seen("RUNS_ON", False), "infrastructure").when(seen("DEPENDS_ON", False), "service").otherwise("general").alias("kind"))


@query("g11_type_hierarchy", "SELECT n_name AS type, r_name AS ancestor, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD', 2 FROM nation UNION ALL SELECT r_name, 'WORLD', 1 FROM region")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("type"), F.col("r_name").alias("ancestor"))
    top = r.select(F.col("r_name").alias("type"), F.lit("WORLD").alias("ancestor"))
    two = up.join(top.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("type", F.col("next").alias("ancestor"), F.lit(2).alias("depth"))
    return up.withColumn("depth", F.lit(1)).union(top.withColumn("depth", F.lit(1))).union(two)


@query("r22_constraints", sql("live_edges", "SELECT source, target, predicate, round(least(0.85, 0.70 + 0.02 * obs), 6) AS confidence FROM (SELECT * FROM live_edges WHERE decay > 0.3 AND predicate IN ('USES', 'DEPENDS_ON', 'RUNS_ON', 'REQUIRES') ORDER BY decay DESC, source, target, predicate LIMIT 8)"))
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = views.live_edges(spark, sf_dir).filter((F.col("decay") > 0.3) & F.col("predicate").isin("USES", "DEPENDS_ON", "RUNS_ON", "REQUIRES"))
    best = strong.orderBy(F.desc("decay"), "source", "target", "predicate").limit(8)
    return best.select("source", "target", "predicate", F.round(F.least(F.lit(0.85), F.lit(0.70) + F.lit(0.02) * F.col("obs")), 6).alias("confidence"))
