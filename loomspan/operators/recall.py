"""Recall over summary nodes and redundancy removal, as folds over bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text


def recall(nodes: DataFrame, budget: int) -> DataFrame:
    """(session_id, turn_start, turn_end, depth): newest start first, deeper first, no overlaps, within the token budget."""
    rows = nodes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("turn_start")).alias("o"), (-F.col("depth")).alias("d"), "turn_start", "turn_end", "depth", "token_est"))).alias("rows"))
    empty = F.array().cast("array<struct<turn_start:bigint,turn_end:bigint,depth:int>>")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept"))

    def step(s: Column, r: Column) -> Column:
        clash = F.exists(s["kept"], lambda k: (k["turn_start"] <= r["turn_end"]) & (r["turn_start"] <= k["turn_end"]))
        fits = ~clash & (s["used"] + r["token_est"] <= budget)
        add = F.array(F.struct(r["turn_start"].alias("turn_start"), r["turn_end"].alias("turn_end"), r["depth"].cast("int").alias("depth")))
        return F.when(fits, F.struct((s["used"] + r["token_est"]).alias("used"), F.concat(s["kept"], add).alias("kept"))).otherwise(s)

    return rows.select("session_id", F.explode(F.aggregate("rows", start, step)["kept"]).alias("k")).select("session_id", "k.*")


def drop_redundant(rows: DataFrame, keys: list[str], above: float = 0.8) -> DataFrame:
    """(keys, id): items in order `pos` whose words are not contained by more than `above` in a kept one."""
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("rows"))
    start = F.array().cast("array<struct<pos:bigint,id:bigint,words:array<string>>>")
    step = lambda s, r: F.when(F.exists(s, lambda k: text.containment(r["words"], k["words"]) > above), s).otherwise(F.concat(s, F.array(F.struct(r["pos"].cast("long").alias("pos"), r["id"].alias("id"), r["words"].alias("words")))))
    return lists.select(*keys, F.explode(F.aggregate("rows", start, step)).alias("k")).select(*keys, "k.id")


def dedup_names(names: Column) -> Column:
    """Names, longest first, without one that contains or is contained in a kept one; sorted."""
    low = F.array_sort(names, lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    step = lambda s, n: F.when(F.exists(s, lambda k: F.contains(k, n) | F.contains(n, k)), s).otherwise(F.concat(s, F.array(n)))
    return F.array_sort(F.aggregate(low, F.array().cast("array<string>"), step))
