"""Detectors over memory entities, counters and sessions; every detector covers all keys in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import stripes


def cooccurrence_spikes(members: DataFrame, age_days: Column, recent_days: float = 7.0, times: float = 3.0, least: int = 2) -> DataFrame:
    """Entity pairs whose recent count is above `times` their weekly history; weeks since the first pair, one at least."""
    weekly = F.when(F.col("before") > 0, F.col("before") / F.greatest(F.lit(1.0), F.col("age") / 7.0)).otherwise(0.0)
    found = stripes.pair_counts(members.withColumn("age", age_days), least, recent_days, F.col("recent") > weekly * times)
    return found.select("e1", "e2", "recent", weekly.alias("weekly"))


def topic_drift(members: DataFrame, least: int = 6, below: float = 0.35, union: int = 3) -> DataFrame:
    """Entities whose neighbours in the first and last third of their memories hardly overlap, for all entities at once."""
    either = F.col("old") + F.col("new") - F.col("both")
    sets = stripes.thirds(members, least).withColumns({"either": either, "overlap": F.col("both") / either})
    drift = sets.filter((F.col("overlap") < below) & (F.col("either") >= union))
    return drift.select("entity", "n", "overlap", (F.col("new") - F.col("both")).alias("gained"), (F.col("old") - F.col("both")).alias("lost"))


def counter_anomalies(readings: DataFrame, drop: float = -1.0, jump: float = 50.0) -> DataFrame:
    """Counters that fall by more than 1 or rise by more than 50 from one reading to the next."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = readings.withColumn("before", before).withColumn("delta", F.col("value") - F.col("before")).filter((F.col("delta") < drop) | (F.col("delta") > jump))
    pct = F.abs("delta") / F.greatest("before", F.lit(0.01)) * 100
    return d.withColumns({"kind": F.when(F.col("delta") < drop, "counter_drop").otherwise("counter_spike"), "priority": F.when((F.col("delta") > jump) | (pct > 20), "high").otherwise("medium")})


def failure_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive failures per user of at least `least` events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = (F.col("event_type") != "error").cast("int")
    runs = events.withColumn("island", F.sum(ok).over(w)).filter("event_type = 'error'").groupBy("user_id", "island")
    return runs.agg(F.count("*").alias("failures"), F.min("event_id").alias("first_event")).filter(F.col("failures") >= least).drop("island")
