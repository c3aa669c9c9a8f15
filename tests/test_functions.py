"""Hand-computed values of the rule and score functions, and null, blank and non-ASCII inputs."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import scores, text
from loomspan.operators import folds, rank


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("prompt", "score"), [("yes", 0.85), ("how do I parse JSON in Python", 0.0), ("what was that project config?", 1.0), ("what's at 10.0.0.50?", 1.0), ("", 0.0), ("  \n", 0.0), (None, 0.0)])
def test_needs_context(spark, prompt, score):
    assert one(spark, text.needs_context(F.lit(prompt).cast("string"))) == pytest.approx(score)


@pytest.mark.parametrize(("n", "value"), [(0, 0.0), (19, 1.0), (50, 1.0), (None, 0.0)])
def test_frequency(spark, n, value):
    assert one(spark, scores.frequency(F.lit(n).cast("long"))) == pytest.approx(value)


def test_recency_and_composite(spark):
    assert one(spark, scores.recency(F.lit(None).cast("double"), F.lit(False))) == pytest.approx(0.1)
    assert one(spark, scores.recency(F.lit(30.0), F.lit(False), 0.023)) == pytest.approx(0.501576, abs=1e-6)
    assert one(spark, scores.composite_impact(F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(0.5))) == pytest.approx(0.45125)


@pytest.mark.parametrize(("score", "n", "factor"), [(5.0, 2, 1.0), (10.0, 5, 1.133333), (-10.0, 6, 0.5)])
def test_utility_factor(spark, score, n, factor):
    assert one(spark, scores.utility_factor(F.lit(score), F.lit(n), F.lit(False))) == pytest.approx(factor, abs=1e-6)


@pytest.mark.parametrize(("label", "rank_", "bucket", "delta"), [(0.1, 2, None, -0.25), (0.1, 4, None, -0.10), (1.0, 1, "CONSTRAINTS", 3.0), (0.0, 1, None, -1.0)])
def test_utility_delta(spark, label, rank_, bucket, delta):
    assert one(spark, scores.utility_delta(F.lit(label), F.lit(rank_), F.lit(bucket).cast("string"))) == pytest.approx(delta)


def test_store_events_need_thirty_characters(spark):
    assert one(spark, text.store_events(F.lit("fixed the bug"))) == []
    assert one(spark, text.store_events(F.lit("Fixed the connection error, root cause found"))) == ["fix"]


def test_fusion(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "list string, id long, rank int")
    assert rank.fuse(df).first().fused == pytest.approx(0.032787, abs=1e-6)


def test_moving_lean(spark):
    df = spark.createDataFrame([(1, 1, 0, "b", 0.7)], "preference_id long, event_id long, ts int, pole string, confidence double")
    assert folds.moving_lean(df).first().lean == pytest.approx(0.5525)


def test_fold_ignores_partitioning(spark):
    df = spark.createDataFrame([(i % 3, i, i, ["supports", "challenges"][i % 4 == 0]) for i in range(300)], "preference_id long, event_id long, ts long, direction string")
    a = sorted(folds.pattern_ladder(df.repartition(7)).collect())
    assert a == sorted(folds.pattern_ladder(df.coalesce(1)).collect())


def test_budget_is_never_exceeded(spark):
    df = spark.createDataFrame([(1, s, 10 * i, i, i / 10, i) for i in range(1, 9) for s in ("graph", "identity", "other")], "query long, source_type string, token_est long, memory_id long, confidence double, result_rank long")
    rows = rank.admit(df, ["query"], 150).collect()
    assert rows and min(r.left for r in rows) >= 0
