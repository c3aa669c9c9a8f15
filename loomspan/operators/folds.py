"""Ordered folds: state carried over the rows of a key in a fixed order.

The folds are not associative, so a key's rows meet in one task; keys are sessions, users or queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, state): step(state, row) over each key's rows in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("rows"))
    return rows.select(*keys, F.aggregate("rows", start, step).alias("state"))


def moving_lean(df: DataFrame, key: str = "preference_id", alpha: float = 0.15) -> DataFrame:
    """Exponential moving average of observations (pole a 0, balanced .5, pole b 1), weighted by confidence."""
    seen = F.when(F.col("pole") == "a", 0.0).when(F.col("pole") == "b", 1.0).otherwise(0.5)
    out = fold(df.withColumns({"seen": seen, "w": F.lit(alpha) * F.col("confidence")}), [key], ["ts", "event_id"], ["seen", "w"], F.lit(0.5), lambda s, r: r["w"] * r["seen"] + (F.lit(1.0) - r["w"]) * s)
    return out.select(key, F.col("state").alias("lean"))


def arc_position(df: DataFrame, key: str = "preference_id") -> DataFrame:
    """Position moved by delta and clamped to 0-1 at each event; resolution completes, breakthrough from .7 on is the climax."""
    start = F.struct(F.lit(0.0).alias("position"), F.lit("active").alias("status"))

    def step(s: Column, r: Column) -> Column:
        moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["position"] + r["delta"]))
        done = r["kind"] == "resolution"
        return F.struct(F.when(done, 1.0).otherwise(moved).alias("position"), F.when(done, "completed").when((r["kind"] == "breakthrough") & (moved >= 0.7), "climax").otherwise(s["status"]).alias("status"))

    return fold(df, [key], ["ts", "event_id"], ["delta", "kind"], start, step).select(key, "state.position", "state.status")


#: Least supports, challenge rate that must not be reached, least days, to leave each level.
LADDER = ((3, 0.30, 0), (5, 0.25, 0), (8, 0.20, 7), (12, 0.15, 30))


def preference_ladder(df: DataFrame, key: str = "preference_id", demote_above: float = 0.40) -> DataFrame:
    """Maturity 0-4: a support may promote by one, a challenge may demote by one, on the counts so far."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("level"), zero.alias("supports"), zero.alias("challenges"), F.lit(None).cast("long").alias("first"))

    def step(s: Column, r: Column) -> Column:
        yes = r["direction"] == "supports"
        up, down = s["supports"] + yes.cast("long"), s["challenges"] + (~yes).cast("long")
        rate, first = down / (up + down), F.coalesce(s["first"], r["us"])
        days = F.floor((r["us"] - first) / F.lit(86_400_000_000))
        level = F.lit(False)
        for i, (least, most, span) in enumerate(LADDER):
            level = level | ((s["level"] == i) & (up >= least) & (rate < most) & (days >= span))
        return F.struct(F.when(yes & level, s["level"] + 1).when(~yes & (rate > demote_above) & (s["level"] > 0), s["level"] - 1).otherwise(s["level"]).alias("level"), up.alias("supports"), down.alias("challenges"), first.alias("first"))

    timed = df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return fold(timed, [key], ["us", "event_id"], ["direction"], start, step).select(key, "state.level", "state.supports", "state.challenges")


def pattern_ladder(df: DataFrame, key: str = "preference_id") -> DataFrame:
    """Levels 0-4 by evidence 3, 5, 8, 13; a challenge demotes above 40 %; confidence +.03 or -.05 within 0-1."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("level"), zero.alias("supports"), zero.alias("challenges"), F.lit(0.5).alias("confidence"))

    def step(s: Column, r: Column) -> Column:
        yes = r["direction"] == "supports"
        up, down = s["supports"] + yes.cast("long"), s["challenges"] + (~yes).cast("long")
        rate = F.when(up > 0, down / up).otherwise(0.0)
        target = F.when((up >= 13) & (rate < 0.2), 4).when(up >= 8, 3).when(up >= 5, 2).when(up >= 3, 1).otherwise(0)
        level = F.when(yes, F.greatest(s["level"], target)).when((up > 0) & (rate > 0.4) & (s["level"] > 0), s["level"] - 1).otherwise(s["level"])
        confidence = F.when(yes, F.least(F.lit(1.0), s["confidence"] + 0.03)).otherwise(F.greatest(F.lit(0.0), s["confidence"] - 0.05))
        return F.struct(level.alias("level"), up.alias("supports"), down.alias("challenges"), confidence.alias("confidence"))

    return fold(df, [key], ["ts", "event_id"], ["direction"], start, step).select(key, "state.level", "state.confidence")


def earn_back(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Threshold offset per source: useful -0.03, ignored +0.05, within +-0.15 at each step."""
    step = lambda s, r: F.when(r["useful"], F.greatest(F.lit(-0.15), s - 0.03)).otherwise(F.least(F.lit(0.15), s + 0.05))
    return fold(df, keys, order, ["useful"], F.lit(0.0), step).select(*keys, F.col("state").alias("offset"))


def leaf_ranges(turns: DataFrame, tokens: int = 2000, tail: int = 20) -> DataFrame:
    """(session_id, turn_start, turn_end): runs of turns cut when their tokens reach the limit, without the last turns."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    start = F.struct(F.lit(None).cast("long").alias("open"), F.lit(0).cast("long").alias("sum"), empty.alias("done"), F.lit(0).cast("long").alias("last"))

    def step(s: Column, r: Column) -> Column:
        first, total = F.coalesce(s["open"], r["turn_index"]), s["sum"] + r["token_est"]
        full = total >= tokens
        cut = F.array(F.struct(first.alias("s"), r["turn_index"].alias("e")))
        return F.struct(F.when(~full, first).alias("open"), F.when(full, 0).otherwise(total).cast("long").alias("sum"), F.when(full, F.concat(s["done"], cut)).otherwise(s["done"]).alias("done"), r["turn_index"].alias("last"))

    out = fold(turns, ["session_id"], ["turn_index"], ["token_est"], start, step)
    return out.select("session_id", F.explode("state.done").alias("r"), F.col("state.last").alias("last")).filter(F.col("r.e") < F.col("last") - tail).select("session_id", F.col("r.s").alias("turn_start"), F.col("r.e").alias("turn_end"))


def rollups(nodes: DataFrame, fan_in: int = 4, depths: int = 4) -> DataFrame:
    """(session_id, depth, turn_start, turn_end): every `fan_in` nodes of a depth, in order, make one of the next; the rest stay orphans."""
    out, at = None, nodes.select("session_id", "turn_start", "turn_end")
    for depth in range(1, depths + 1):
        place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_start")) - 1
        full = at.withColumn("g", F.floor(place / fan_in)).groupBy("session_id", "g").agg(F.min("turn_start").alias("turn_start"), F.max("turn_end").alias("turn_end"), F.count("*").alias("n")).filter(F.col("n") == fan_in)
        at = full.select("session_id", "turn_start", "turn_end")
        level = at.select("session_id", F.lit(depth).alias("depth"), "turn_start", "turn_end")
        out = level if out is None else out.union(level)
    return out
