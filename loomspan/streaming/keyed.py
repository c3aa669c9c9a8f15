"""Keyed stream state in order of event time: rows wait in state until the watermark passes them, then step through one by one.

A key's rows are kept in map state in chunks of whole time buckets, so that neither a batch nor a key's history is ever in memory
at once, only a chunk: a new one begins with the next bucket once CHUNK rows are reached. Most keys have one chunk, and so
a few calls to the state for all their rows, not a few for each bucket. Each processor holds values of its own beside them, with a lifetime (ttl) after which a timer
clears them. Rows arrive in any order within the watermark's delay and any cut into batches: results are the same.
State lives in RocksDB with a changelog in the job's checkpoint, so a lost executor or a restart loses nothing.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000  # microseconds
CHUNK = 2048  # rows


class Ordered(StatefulProcessor):
    """Rows (at: microseconds, id, ...) of a key, in order of (at, id), once the watermark has reached them."""

    output: str  # columns of what step and expire give

    def __init__(self, bucket_seconds: int = 3600):
        self.width = bucket_seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket long", "rows binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare the processor's own state."""

    def load(self) -> None:
        """Read own state before rows are stepped through."""

    def step(self, key: tuple, row: dict[str, Any]) -> Iterator[tuple]:
        raise NotImplementedError

    def expire(self, key: tuple, now: int) -> Iterator[tuple]:
        """Drop what is over its lifetime at `now`."""
        return iter(())

    def save(self) -> int | None:
        """Write own state back; when it ends, if it does, in microseconds."""
        return None

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.output.split(", ")]
        kinds = {"long": "int64", "double": "float64", "boolean": "bool", "string": "object"}
        return pd.DataFrame(rows, columns=names).astype({n: kinds[c.split()[1]] for n, c in zip(names, self.output.split(", "))})

    def _wake(self, at: int, watermark: int) -> None:
        self.handle.registerTimer(max(-(-at // 1000), watermark + 1))

    def _chunk(self, start: int) -> tuple[list[str], list[tuple]]:
        return pickle.loads(self.pending.getValue((start,))[0])

    def _keep(self, start: int, rows: list[tuple]) -> None:
        self.pending.updateValue((start,), (pickle.dumps((self.names, rows)),))

    def _file(self, starts: list[int], rows: list[tuple]) -> None:
        """Put rows, whose first value is their time, into the chunks that begin at `starts` (buckets, in order), or into new ones."""
        rows.sort(key=lambda r: r[0])
        while rows:
            bucket = rows[0][0] // self.width
            at = bisect_right(starts, bucket)
            n = bisect_left(rows, starts[at] * self.width, key=lambda r: r[0]) if at < len(starts) else len(rows)
            part, rows = rows[:n], rows[n:]
            if at and starts[at - 1] <= bucket:
                bucket = starts[at - 1]
                part = sorted(self._chunk(bucket)[1] + part, key=lambda r: r[0])
            else:
                insort(starts, bucket)
            while len(part) > CHUNK:
                after = (part[CHUNK - 1][0] // self.width + 1) * self.width
                cut = bisect_left(part, after, key=lambda r: r[0])
                if cut == len(part):
                    break
                self._keep(bucket, part[:cut])
                part, bucket = part[cut:], part[cut][0] // self.width
                insort(starts, bucket)
            self._keep(bucket, part)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = first = None
        for frame in rows:
            self.names = ["at", "id", *(c for c in frame.columns if c not in ("at", "id", "ts"))]
            values = [frame[c].tolist() if not frame[c].hasnans else [None if x != x else x for x in frame[c].tolist()] for c in self.names]
            starts = sorted(int(k[0]) for k in self.pending.keys()) if starts is None else starts
            self._file(starts, list(zip(*values)))
            first = min(int(min(values[0])), first if first is not None else sys.maxsize)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        now, waiting = watermark * 1000, None
        self.load()
        for start in sorted(int(k[0]) for k in self.pending.keys()):
            if start * self.width > now:
                waiting = start * self.width
                break
            self.names, rows = self._chunk(start)
            rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
            due = bisect_right(rows, now, key=lambda r: r[0])
            if out := [x for row in rows[:due] for x in self.step(key, dict(zip(self.names, row)))]:
                yield self._frame(out)
            if due < len(rows):
                self._keep(start, rows[due:])
                waiting = rows[due][0]
                break
            self.pending.removeKey((start,))
        if out := list(self.expire(key, now)):
            yield self._frame(out)
        ends = self.save()
        for at in (waiting, ends):
            if at is not None:
                self._wake(at, watermark)

    def close(self) -> None:
        pass


class CounterReadings(Ordered):
    """(user_id, event_id, delta) of readings `value` that fall or jump against the last one, held for ttl_seconds."""

    output = "user_id long, event_id long, delta double"

    def __init__(self, drop: float = -1.0, jump: float = 50.0, ttl_seconds: int = 2 * 3600, bucket_seconds: int = 3600):
        super().__init__(bucket_seconds)
        self.drop, self.jump, self.ttl = drop, jump, ttl_seconds * SECOND

    def open(self, handle):
        self.held = handle.getValueState("last", "value double, at long")

    def load(self):
        self.last = tuple(self.held.get()) if self.held.exists() else None

    def step(self, key, row):
        value = None if row["value"] is None else float(row["value"])
        if self.last and row["at"] - self.last[1] < self.ttl and value is not None and self.last[0] is not None:
            delta = value - self.last[0]
            if delta < self.drop or delta > self.jump:
                yield key[0], row["id"], delta
        self.last = (value, int(row["at"]))

    def expire(self, key, now):
        if self.last and self.last[1] + self.ttl <= now:
            self.last = None
        return iter(())

    def save(self):
        if self.last is None:
            self.held.clear()
            return None
        self.held.update(self.last)
        return self.last[1] + self.ttl


class SlidingLimit(Ordered):
    """(user_id, event_id) of calls over the limit: `most` calls were let through in the last `seconds`."""

    output = "user_id long, event_id long"

    def __init__(self, most: int = 10, seconds: int = 60, bucket_seconds: int = 3600):
        super().__init__(bucket_seconds)
        self.most, self.span = most, seconds * SECOND

    def open(self, handle):
        self.held = handle.getListState("calls", "at long")

    def load(self):
        self.calls = [int(x[0]) for x in self.held.get()] if self.held.exists() else []

    def step(self, key, row):
        self.calls = [at for at in self.calls if row["at"] - at < self.span]  # `most` at most
        if len(self.calls) >= self.most:
            yield key[0], row["id"]
        else:
            self.calls.append(int(row["at"]))

    def expire(self, key, now):
        self.calls = [at for at in self.calls if now - at < self.span]
        return iter(())

    def save(self):
        if not self.calls:
            self.held.clear()
            return None
        self.held.put([(at,) for at in self.calls])
        return self.calls[-1] + self.span


def _write(state: Any, before: dict[int, tuple], after: dict[int, tuple]) -> None:
    """What changed since the map state was read."""
    if before and not after:
        state.clear()
        return
    for k in before.keys() - after.keys():
        state.removeKey((k,))
    for k, v in after.items():
        if before.get(k) != v:
            state.updateValue((k,), v)


class TurnBuffer(Ordered):
    """(session_id, turn, query, reply, live, at): changes of a session's newest turns. A user row (id, role, content) adds a turn, the assistant's
    row after it fills in the reply; turns beyond `most`, and all after ttl_seconds of silence, are given once more with live = false."""

    output = "session_id string, turn long, query string, reply string, live boolean, at long"

    def __init__(self, most: int = 20, ttl_seconds: int = 4 * 3600, bucket_seconds: int = 3600):
        super().__init__(bucket_seconds)
        self.most, self.ttl = most, ttl_seconds * SECOND

    def open(self, handle):
        self.turns = handle.getMapState("turns", "turn long", "query string, reply string")
        self.held = handle.getValueState("touched", "at long")

    def load(self):
        self.touched = int(self.held.get()[0]) if self.held.exists() else None
        self.held_turns = {int(k[0]): tuple(v) for k, v in self.turns.iterator()}  # `most` at most
        self.known = dict(self.held_turns)

    def step(self, key, row):
        if self.touched is not None and row["at"] - self.touched >= self.ttl:
            yield from self._end(key, self.touched + self.ttl)
        user = row["role"] == "user"
        turn = int(row["id"]) if user else int(row["id"]) - 1
        if not (user or turn in self.known):
            return
        query, reply = (row["content"] or "", "") if user else (self.known[turn][0], row["content"] or "")
        self.known[turn] = (query, reply)
        self.touched = int(row["at"])
        yield key[0], turn, query, reply, True, self.touched
        for old in sorted(self.known)[: max(0, len(self.known) - self.most)] if user else ():
            yield key[0], old, *self.known.pop(old), False, self.touched

    def _end(self, key, at):
        for turn in sorted(self.known):
            yield key[0], turn, *self.known[turn], False, at
        self.known.clear()
        self.touched = None

    def expire(self, key, now):
        if self.touched is not None and self.touched + self.ttl <= now:
            yield from self._end(key, self.touched + self.ttl)

    def save(self):
        _write(self.turns, self.held_turns, self.known)
        if self.touched is None:
            self.held.clear()
            return None
        self.held.update((self.touched,))
        return self.touched + self.ttl


class TurnOutcomes(Ordered):
    """(session_id, turn_index, reply_length) of user turns and the assistant rows after them, among a session's `most` open turns:
    beyond them the smallest turn is forgotten, and a turn that has its reply is done."""

    output = "session_id string, turn_index long, reply_length long"

    def __init__(self, most: int = 200, bucket_seconds: int = 3600):
        super().__init__(bucket_seconds)
        self.most = most

    def open(self, handle):
        self.waiting = handle.getMapState("waiting", "turn long", "at long")

    def load(self):
        self.held = {int(k[0]): tuple(v) for k, v in self.waiting.iterator()}  # `most` at most
        self.known = dict(self.held)

    def step(self, key, row):
        turn = int(row["id"])
        if row["role"] == "user":
            self.known[turn] = (int(row["at"]),)
            if len(self.known) > self.most:
                del self.known[min(self.known)]
        elif row["role"] == "assistant" and turn - 1 in self.known:
            del self.known[turn - 1]
            yield key[0], turn - 1, len(row["content"] or "")

    def save(self):
        _write(self.waiting, self.held, self.known)
        return None


class Pressure(Ordered):
    """(session_id, turn_index, tokens) of turns at which a session's tokens come to `share` of the limit or more, until it is silent for ttl_seconds."""

    output = "session_id string, turn_index long, tokens long"

    def __init__(self, limit: int = 200_000, share: float = 0.75, ttl_seconds: int = 24 * 3600, bucket_seconds: int = 3600):
        super().__init__(bucket_seconds)
        self.limit, self.share, self.ttl = limit, share, ttl_seconds * SECOND

    def open(self, handle):
        self.held = handle.getValueState("sum", "tokens long, at long")

    def load(self):
        self.sum = tuple(self.held.get()) if self.held.exists() else (0, None)

    def step(self, key, row):
        tokens = (0 if self.sum[1] is None or row["at"] - self.sum[1] >= self.ttl else self.sum[0]) + int(row["tokens"])
        self.sum = (tokens, int(row["at"]))
        if tokens >= self.share * self.limit:
            yield key[0], int(row["id"]), tokens

    def expire(self, key, now):
        if self.sum[1] is not None and self.sum[1] + self.ttl <= now:
            self.sum = (0, None)
        return iter(())

    def save(self):
        if self.sum[1] is None:
            self.held.clear()
            return None
        self.held.update(self.sum)
        return self.sum[1] + self.ttl


def in_order(stream: DataFrame, key: str, processor: Ordered, delay: str = "1 hour") -> DataFrame:
    """The processor's rows over a stream (key, ts, id, ...), in append mode; run it within `rocks`."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = stream.filter("ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State stores of jobs started inside are RocksDB, which processors with several states need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
