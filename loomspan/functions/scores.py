"""Time-decayed and outcome scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import clamp

#: Score changes by outcome, neutral factor and its limits.
USEFUL, OBEYED, PARTIAL, IRRELEVANT, TAIL, HARMFUL = 2.0, 1.0, 0.5, -0.25, -0.10, -1.0
NEUTRAL, FLOOR, CEILING, GUARD, NORM = 0.85, 0.5, 1.2, 0.75, 10.0
IMPACT_SCORES = {"critical": 1.0, "high": 0.75, "normal": 0.5, "low": 0.25}


def recency(days: Column, pinned: Column, rate: float = 0.05) -> Column:
    return F.when(pinned, 1.0).when(days.isNull(), 0.1).otherwise(F.exp(-F.lit(rate) * days))


def frequency(n: Column) -> Column:
    return F.when((n <= 0) | n.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.log(n + F.lit(1.0)) / F.log(F.lit(20.0))))


def impact_score(impact: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in IMPACT_SCORES.items() for x in (F.lit(k), F.lit(v))])[impact], F.lit(0.5))


def composite(rec: Column, freq: Column, authority: Column, entity: Column) -> Column:
    return rec * 0.35 + freq * 0.20 + authority * 0.30 + entity * 0.15


def composite_impact(rec: Column, freq: Column, authority: Column, entity: Column, impact: Column) -> Column:
    base = rec * 0.30 + freq * 0.20 + authority * 0.30 + entity * 0.15 + impact * 0.05
    return base * clamp(F.lit(0.4) + impact * 1.1, 0.8, 1.5)


def outcome_label(correction: Column, overlap: Column) -> Column:
    return F.when(correction & (overlap > 0.3), 0.0).when(overlap > 0.5, 1.0).when(overlap > 0.2, 0.5).otherwise(0.1)


def utility_delta(label: Column, rank: Column, bucket: Column, tail: int = 3) -> Column:
    return (
        F.when(label <= 0.05, HARMFUL).when((label >= 0.9) & (F.coalesce(bucket, F.lit("")) == "CONSTRAINTS"), USEFUL + OBEYED).when(label >= 0.9, USEFUL)
        .when(label > 0.3, PARTIAL).when(rank > tail, TAIL).otherwise(IRRELEVANT)
    )


def utility_factor(score: Column, n: Column, protected: Column) -> Column:
    """Neutral below three events, ramped below six, never under the guard when protected."""
    raw = clamp(F.lit(NEUTRAL) + score / NORM, FLOOR, CEILING)
    ramped = F.when(n < 3, 1.0).when(n < 6, F.lit(1.0) + (n - 3) / 3.0 * (raw - 1.0)).otherwise(raw)
    return F.when(protected, F.greatest(F.lit(GUARD), ramped)).otherwise(ramped)
