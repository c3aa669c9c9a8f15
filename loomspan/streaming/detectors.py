"""Stateful stream operators per user: circuit breaker and cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomspan.streaming.runs import stateful


def _micros(rows):
    return rows.ts.astype("datetime64[us]").astype("int64").tolist()


def breaker(events: DataFrame, failures: int = 3, open_seconds: int = 12 * 3600, ttl_seconds: int = 48 * 3600) -> DataFrame:
    """(user_id, event_id): the failures at which a user's breaker opens, after so many in a row; it stays open for a while.

    Failures are forgotten when a user is silent for ttl_seconds, which is no less than open_seconds.
    """
    import pandas as pd

    def step(key, rows, state):
        run, until, last = state or (0, 0, 0)
        out = []
        for event_id, kind, at in zip(rows.event_id, rows.event_type, _micros(rows)):
            run = 0 if at - last >= ttl_seconds * 1_000_000 else run
            last = at
            if at < until:
                continue
            run = run + 1 if kind == "error" else 0
            if run >= failures:
                out.append(event_id)
                run, until = 0, at + open_seconds * 1_000_000
        return pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out}).astype("int64"), (run, until, last)

    return stateful(events, ["user_id"], "user_id long, event_id long", "run int, until long, last long", step, max(ttl_seconds, open_seconds))


def cooldown(events: DataFrame, seconds: int = 24 * 3600) -> DataFrame:
    """(user_id, event_id): events that are not within the cooldown of the last one let through for the user."""
    import pandas as pd

    def step(key, rows, state):
        last = state[0] if state else None
        out = []
        for event_id, at in zip(rows.event_id, _micros(rows)):
            if last is None or at - last >= seconds * 1_000_000:
                out.append(event_id)
                last = at
        return pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out}).astype("int64"), (last,)

    return stateful(events, ["user_id"], "user_id long, event_id long", "last long", step, seconds)
