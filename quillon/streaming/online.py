"""The learner's state and rate limits as small state machines, run by Structured Streaming or over a whole log.

A machine has keys, a state that is a few integers, and a step from state and event to state and outputs. ``stream`` keeps the states in the
streaming state store; ``replay`` walks a sorted log, a batch of rows at a time, and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Machine:
    keys: list[str] = ["email"]
    #: Output columns after the keys, and the state's, with SQL types.
    output = "id long, allowed boolean"
    state = "start long, n long"
    #: The state before the first event; -1 stands for no time.
    start: tuple = (-1, 0)
    #: Whether only a micro-batch's last output counts.
    last_only = False

    def step(self, state: tuple, at: int, event) -> tuple[tuple, tuple]:
        """The next state and the output, for an event at a time in microseconds."""
        raise NotImplementedError


class FixedWindow(Machine):
    """A window opens at the first request and lets ``most`` through until it is over ``seconds`` old."""

    def __init__(self, most: int, seconds: int):
        self.most, self.size = most, seconds * 1_000_000

    def step(self, state, at, event):
        start, n = state
        if start < 0 or at - start > self.size:
            return (at, 1), (event.id, True)
        if n >= self.most:
            return state, (event.id, False)
        return (start, n + 1), (event.id, True)


class TokenBucket(Machine):
    """A bucket starts full with ``most`` tokens and refills them in ``seconds``; its level is in microseconds of refill."""

    output, state, start = "id long, granted boolean", "level long, last long", (0, -1)

    def __init__(self, most: int, seconds: int):
        self.unit = seconds * 1_000_000 // most
        self.full = self.unit * most

    def step(self, state, at, event):
        level, last = state
        level = self.full if last < 0 else min(self.full, level + at - last)
        return (max(0, level - self.unit), at), (event.id, level >= self.unit)


class ResendGuard(Machine):
    """Events ask for a code or try one: sent, verified, wrong or refused. A code is sent at most every ``again`` seconds, lives ``expiry`` seconds and
    allows ``tries`` tries; a right or dead code is forgotten."""

    output, state = "id long, outcome string", "sent long, tries long"

    def __init__(self, again: int, expiry: int, tries: int):
        self.again, self.expiry, self.tries = again * 1_000_000, expiry * 1_000_000, tries

    def step(self, state, at, event):
        sent, n = state
        if event.asks:
            early = sent >= 0 and at - sent < self.again
            return (state if early else (at, 0)), (event.id, "refused" if early else "sent")
        if sent < 0 or at - sent > self.expiry or n >= self.tries:
            return (-1, 0), (event.id, "refused")
        return ((-1, 0), (event.id, "verified")) if event.good else ((sent, n + 1), (event.id, "wrong"))


class Mastery(Machine):
    """Mastery in hundredths: each event's delta is added and kept from 0 to 100."""

    keys, output, state, start, last_only = ["email", "kp"], "mastery_percent long, attempts long", "score long, n long", (0, 0), True

    def step(self, state, at, event):
        score, n = min(100, max(0, state[0] + int(event.delta))), state[1] + 1
        return (score, n), (score, n)


def _outputs(machine: Machine) -> tuple[str, list[str]]:
    schema = ", ".join([*(f"{k} long" for k in machine.keys), machine.output])
    return schema, [x.split()[0] for x in schema.split(", ")]


def stream(events: DataFrame, machine: Machine) -> DataFrame:
    """events(keys, ts, id, ..) as they arrive; those of one micro-batch are taken in (ts, id) order."""
    schema, names = _outputs(machine)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, rows = state.get if state.exists else machine.start, []
        for e in pd.concat(list(frames)).sort_values(["ts", "id"]).itertuples():
            now, out = machine.step(now, int(e.ts.value // 1000), e)
            rows.append((*key, *out))
        state.update(now)
        yield pd.DataFrame(rows[-1:] if machine.last_only else rows, columns=names)

    return events.groupBy(*machine.keys).applyInPandasWithState(run, schema, machine.state, "update" if machine.last_only else "append", "NoTimeout")


def replay(log: DataFrame, machine: Machine) -> DataFrame:
    """A whole log in (ts, id) order for each key: one shuffle and sort, then memory of a batch and one state however long a key's log is.

    Events without a key, time or id are left out."""
    schema, names = _outputs(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, machine.start
        for b in batches:
            rows = []
            for e in b.itertuples():
                mine = tuple(getattr(e, k) for k in machine.keys)
                if mine != key:
                    key, now = mine, machine.start
                now, out = machine.step(now, int(e.ts.value // 1000), e)
                rows.append((*mine, *out))
            yield pd.DataFrame(rows, columns=names)

    return log.dropna(subset=[*machine.keys, "ts", "id"]).repartition(*machine.keys).sortWithinPartitions(*machine.keys, "ts", "id").mapInPandas(run, schema)


def mastery(events: DataFrame) -> DataFrame:
    """events(email, kp, ts, id, delta) -> (email, kp, mastery_percent, attempts) after each micro-batch."""
    return stream(events, Mastery())


def rate_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """events(email, ts, id) -> (email, id, allowed)."""
    return stream(events, FixedWindow(most, seconds))


def token_bucket(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """events(email, ts, id) -> (email, id, granted)."""
    return stream(events, TokenBucket(most, seconds))


def resend_guard(events: DataFrame, again: int, expiry: int, tries: int) -> DataFrame:
    """events(email, ts, id, asks, good) -> (email, id, outcome)."""
    return stream(events, ResendGuard(again, expiry, tries))


def daily_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers a day and subject; a day is final when the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "subject").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """events(id, email, ts), as a stream or a table -> (email, started_at, ended_at, n): answers with less than ``gap`` between them are one session.

    On a stream an event that comes again is dropped while the watermark hasn't passed it, a session is final when the watermark passes its end, and what comes later is dropped."""
    d = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else events.dropDuplicates(["id"])
    s = d.groupBy("email", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("email", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")
