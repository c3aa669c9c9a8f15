"""The feedback loop: labels of retrievals, score changes, rolling utility, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import scores, text

KEY = ["session_id", "turn_index"]


def label(retrievals: DataFrame, responses: DataFrame, turns: DataFrame) -> DataFrame:
    """Retrievals with overlap, correction (in the next assistant turn) and label."""
    next_turn = turns.filter("role = 'assistant'").select("session_id", (F.col("turn_index") - 2).alias("turn_index"), F.col("content").alias("later"))
    seen = retrievals.join(responses, KEY).join(next_turn, KEY, "left")
    used = F.when(F.col("memory_id") % 3 == 0, F.concat_ws(" ", "memory_text", "response")).otherwise(F.col("response"))
    overlap = text.coverage(text.word_set(F.col("memory_text")), text.word_set(used))
    correction = F.coalesce(text.is_correction(F.col("later")), F.lit(False))
    return seen.withColumns({"overlap": overlap, "correction": correction}).withColumn("label", scores.outcome_label(F.col("correction"), F.col("overlap")))


def utility(labelled: DataFrame) -> DataFrame:
    """Rolling utility of each memory: score, counts by outcome, dominant bucket and its share, factor."""
    n = labelled.withColumn("delta", scores.utility_delta(F.col("label"), F.col("result_rank"), F.col("packaged_bucket")))
    per = n.groupBy("memory_id").agg(
        F.sum("delta").alias("score"), F.count("*").alias("n"), F.count_if(F.col("label") >= 0.9).alias("useful"), F.count_if((F.col("label") > 0.3) & (F.col("label") < 0.9)).alias("partial"),
        F.count_if((F.col("label") > 0.05) & (F.col("label") <= 0.3)).alias("irrelevant"), F.count_if(F.col("label") <= 0.05).alias("harmful"), F.max("created_at").alias("last_seen"),
    )
    buckets = n.filter("packaged_bucket IS NOT NULL").groupBy("memory_id", "packaged_bucket").agg(F.count("*").alias("k"), F.min("created_at").alias("first"))
    top = buckets.withColumn("r", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("k"), "first", "packaged_bucket"))).filter("r = 1")
    out = per.join(top.select("memory_id", F.col("packaged_bucket").alias("dominant"), "k"), "memory_id", "left").withColumn("share", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 3)).drop("k")
    return out.withColumn("factor", scores.utility_factor(F.col("score"), F.col("n"), F.coalesce(F.col("dominant") == "CONSTRAINTS", F.lit(False))))


def promotions(utility_rows: DataFrame, retrievals: DataFrame, least: int = 5, rate: float = 0.7, share: float = 0.8) -> DataFrame:
    """Memories used well and always in one bucket that differs from their latest one."""
    latest = retrievals.filter("packaged_bucket IS NOT NULL").groupBy("memory_id").agg(F.max_by("packaged_bucket", F.struct("created_at", "result_rank")).alias("current"))
    u = utility_rows.filter((F.col("n") >= least) & (F.col("share") >= share)).withColumn("use_rate", (F.col("useful") + F.col("partial")) / F.col("n")).filter(F.col("use_rate") >= rate)
    u = u.join(latest, "memory_id", "left").withColumn("current", F.coalesce("current", F.lit("FACTS")))
    target = F.when((F.col("dominant") == "CONSTRAINTS") & (F.col("current") != "CONSTRAINTS"), "CONSTRAINTS").when((F.col("dominant") == "PROCEDURES") & (F.col("current") == "FACTS"), "PROCEDURES")
    return u.withColumn("suggested", target).filter("suggested IS NOT NULL")
