"""The registered queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import audit, html_text, licenses, lm, mixing, negatives, packing, quality, secret_scan, simhash, substring, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "n_unseen", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    place = F.array(*[F.lit(k) for k in secret_scan.KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    keyed = F.transform(F.concat("base_spans", "linked_spans"), lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    both = F.array_sort(keyed)
    return found.select("doc_id", *[number(k) for k in ("assign", "access", "hex")], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(both).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
lowest AS (SELECT w, min(doc_id) AS lo FROM win GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN lowest USING (w) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tot AS (SELECT sum(len(ws)) AS total FROM d),
p AS (SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS u, CASE WHEN i > 2 THEN ws[i - 2] END AS t FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
o1 AS (SELECT r, w, count(*) AS n FROM p GROUP BY r, w),
o2 AS (SELECT r, u, w, count(*) AS n FROM p WHERE i > 1 GROUP BY r, u, w),
o3 AS (SELECT r, t, u, w, count(*) AS n FROM p WHERE i > 2 GROUP BY r, t, u, w),
l1 AS (SELECT r, w, sum(n) OVER (PARTITION BY w) - n AS c FROM o1),
l2 AS (SELECT r, u, w, sum(n) OVER (PARTITION BY u, w) - n AS c FROM o2),
l3 AS (SELECT r, t, u, w, sum(n) OVER (PARTITION BY t, u, w) - n AS c FROM o3),
x AS (SELECT p.r, p.i, a.c AS c1, b.c AS c2, e.c AS c3, f.c AS cu, g.c AS ct FROM p JOIN l1 a ON a.r = p.r AND a.w = p.w
  LEFT JOIN l2 b ON b.r = p.r AND b.u = p.u AND b.w = p.w LEFT JOIN l3 e ON e.r = p.r AND e.t = p.t AND e.u = p.u AND e.w = p.w
  LEFT JOIN l1 f ON f.r = p.r AND f.w = p.u LEFT JOIN l2 g ON g.r = p.r AND g.u = p.t AND g.w = p.u),
y AS (SELECT *, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k FROM x),
s AS (SELECT y.r, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 0) AS n0,
  sum(ln(CASE k WHEN 3 THEN c3 / ct WHEN 2 THEN c2 / cu WHEN 1 THEN c1 / greatest(1, total - len(ws)) ELSE 1 / greatest(1, total - len(ws)) END) + ln(0.4) * (least(i, 3) - k)) AS log_score
  FROM y JOIN d ON d.r = y.r, tot GROUP BY y.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram, coalesce(n0, 0) AS n_unseen,
  round(log_score, 4) AS log_score, round(log_score / len(ws), 5) AS mean_log_score FROM d LEFT JOIN s ON s.r = d.r
"""


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r != b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS slot FROM s WHERE same) WHERE slot <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.slot ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score::HUGEINT <= 100 * s.score::HUGEINT AND 100 * s.score::HUGEINT <= 90 * p.score::HUGEINT)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > lo, false)::INT AS mask
  FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
o AS (SELECT a || b || x || y || z AS o FROM (SELECT unnest(['A','B','C','D','E']) AS a), (SELECT unnest(['A','B','C','D','E']) AS b), (SELECT unnest(['A','B','C','D','E']) AS x),
  (SELECT unnest(['A','B','C','D','E']) AS y), (SELECT unnest(['A','B','C','D','E']) AS z) WHERE len(list_distinct([a, b, x, y, z])) = 5),
s AS (SELECT o, step, 1 << (ascii(substr(o, step, 1)) - 65) AS own, coalesce(list_sum([1 << (ascii(substr(o, j, 1)) - 65) for j in range(1, step)]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, o AS filter_order, step, own, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & own != 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & own != 0 AND mask & before != 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
  sum(good) FILTER (mask & own != 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own != 0 AND mask & before = 0) AS toxic_lost FROM s, c GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""


def _op2_sql(rounds: int = 120, targets: tuple = mixing.TARGETS, seed: str = mixing.SEED) -> str:
    """Raking written out: one table for each margin of each round, more rounds than the tolerance needs."""

    def listed(words: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"

    counts = ", ".join(f"len(list_filter(h, lambda x: list_contains({listed(terms)}, x))) AS n_{name}" for name, terms in mixing.TOPICS.items())
    most = f"greatest({', '.join(f'n_{name}' for name in mixing.TOPICS)})"
    choice = " ".join(f"WHEN n_{name} = {most} THEN '{name}'" for name in mixing.TOPICS)
    every = listed(" ".join(sorted({w for terms in mixing.TOPICS.values() for w in terms.split()})))
    steps = [
        f"""h AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(1, length(coalesce(text, '')) // 4) AS tokens,
  list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: list_contains({every}, x)) AS h FROM documents)""",
        f"n AS (SELECT *, {counts} FROM h)",
        f"d AS (SELECT doc_id, source, lang, tokens, CASE WHEN {most} = 0 THEN 'other' {choice} END AS topic FROM n)",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS own, sum(tokens)::DOUBLE AS f FROM d GROUP BY ALL)",
    ]
    for d in mixing.DIMENSIONS:
        rows = ", ".join(f"('{v}', {share})" for k, v, share in targets if k == d)
        steps.append(f"""g_{d} AS (SELECT {d}, CASE WHEN asked IS NULL THEN greatest(0, 1 - sum(asked) OVER ()) * own / sum(CASE WHEN asked IS NULL THEN own END) OVER ()
  WHEN sum(asked) OVER () > 1 OR count(*) FILTER (asked IS NULL) OVER () = 0 THEN asked / sum(asked) OVER () ELSE asked END AS target
  FROM (SELECT {d}, sum(own) AS own FROM c0 GROUP BY {d}) LEFT JOIN (VALUES {rows}) AS v({d}, asked) USING ({d}))""")
    n = 0
    for _ in range(rounds):
        for d in mixing.DIMENSIONS:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (f), f * target / sum(f) OVER (PARTITION BY c.{d}) AS f FROM c{n} c JOIN g_{d} USING ({d}))")
            n += 1
    last = f"p AS (SELECT source, lang, topic, f / own / max(f / own) OVER () AS probability FROM c{n})"
    digest = f"substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)"
    return "WITH " + ",\n".join([*steps, last]) + f"""
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, CAST('0x' || {digest} AS BIGINT) / 4503599627370496.0 < probability AS sampled FROM d JOIN p USING (source, lang, topic)"""


def queries() -> dict[str, Query]:
    ops = (op1_substring_dedup, op2_mixing, op3_exact_top_k, op4_best_fit_packing, op5_lm_scoring, op6_html_extraction, op7_url_filters, op8_quality_rules, op9_license_scan, op10_simhash, op11_hard_negatives, op12_secret_scan, op13_filter_audit)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_mixing": _op2_sql(), "op3_exact_top_k": OP3_SQL, "op5_lm_scoring": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op13_filter_audit": OP13_SQL}
