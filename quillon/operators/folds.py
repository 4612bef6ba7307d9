"""Ordered folds over logs, without a list of a key's events anywhere.

``clamped``: adding a delta and keeping the sum in bounds, x -> min(b, max(a, x + s)), is a function of three numbers, and two of them in a row are one again. So the log is cut
into ranges of (key, order), the ranges of one key are reduced at the same time in as many tasks, and their functions are composed in order afterwards.

``reviews``: spaced repetition isn't such a function, so a key's reviews are walked, in sorted order, with a state of four numbers. States of earlier days come in the same
stream, before a key's first review: a new day's log needs them only.
"""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _heads(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def composed(first: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of each run, which begins at ``first``, composed in order: neighbours in pairs, until one is left of each."""
    size = np.diff(np.append(first, len(s)))
    while (size > 1).any():
        place = np.arange(len(s)) - np.repeat(first, size)
        left = np.flatnonzero(place % 2 == 0)
        pair = left + 1 < np.repeat(first + size, size)[left]
        i, j = left[pair], left[pair] + 1
        # what the first of a pair can give, seen through the second
        low, high = np.minimum(b[j], np.maximum(a[j], a[i] + s[j])), np.minimum(b[j], np.maximum(a[j], b[i] + s[j]))
        s, a, b = s.copy(), a.copy(), b.copy()
        s[i], a[i], b[i] = s[i] + s[j], low, high
        s, a, b = s[left], a[left], b[left]
        size = (size + 1) // 2
        first = np.cumsum(size) - size
    return s, a, b


def _reduced(n_keys: int, n_sums: int):
    """Rows (keys, s, a, b, sums) in order -> (keys, part, s, a, b, sums): one for each run of equal keys of a task."""

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y.cast(x.type)]) for x, y in zip(held.columns, batch.columns)], names=held.schema.names)
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(n_keys)]
            first = _heads(keys)
            numbers = [batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in range(3 + n_sums)]
            one = [*composed(first, *numbers[:3]), *[np.add.reduceat(x, first) for x in numbers[3:]]]
            at = pa.array(first)
            out = pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], *[pa.array(x, pa.int64()) for x in one]], names=batch.schema.names)
            held = out.slice(out.num_rows - 1)  # its run may go on
            if out.num_rows > 1:
                yield with_part(out.slice(0, out.num_rows - 1), part)
        if held is not None:
            yield with_part(held, part)

    def with_part(b, part):
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_keys)], pa.array([part] * b.num_rows, pa.int32()), *[b.column(i) for i in range(n_keys, b.num_columns)]], names=[*b.schema.names[:n_keys], "_part", *b.schema.names[n_keys:]])

    return run


def clamped(log: DataFrame, keys: list[str], order: list[str], delta: str, low: int = 0, high: int = 100, start: int = 0, sums: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, n, sums): ``start`` after every delta of a key in order, each kept between the bounds; whole numbers. n counts events, ``sums`` are summed.

    Rows without a key, order or delta are left out; what ties in all of ``order`` comes in any order. A key with half of all rows is as many tasks."""
    names = [*keys, "_s", "_a", "_b", "_n", *sums]
    d = log.dropna(subset=[*keys, *order, delta])
    d = d.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(delta).cast("long").alias("_s"), F.lit(low).cast("long").alias("_a"), F.lit(high).cast("long").alias("_b"), F.lit(1).cast("long").alias("_n"), *[F.col(c).cast("long").alias(c) for c in sums])
    by = [*keys, *[f"_o{i}" for i in range(len(order))]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema.fields)
    schema = f"{kinds}, _part int, " + ", ".join(f"`{c}` long" for c in names[len(keys) :])
    run = _reduced(len(keys), 1 + len(sums))
    cut = d.repartitionByRange(*by).sortWithinPartitions(*by).select(*names).mapInArrow(run, schema)
    # as many rows of a key as tasks had some of it
    whole = cut.repartition(*keys).sortWithinPartitions(*keys, "_part").select(*names).mapInArrow(run, schema)
    score = F.least(F.col("_b"), F.greatest(F.col("_a"), F.lit(start) + F.col("_s")))
    return whole.select(*keys, score.alias("score"), F.col("_n").alias("n"), *sums)


# --- spaced repetition -------------------------------------------------------------------------------------------------------------
#: What an answer of quality 1 to 5 adds to the ease.
_EASE = {q: (5 - q) * (0.08 + (5 - q) * 0.02) for q in range(0, 6)}
LOG = "id long, d date, quality int, old_mastery long, new_mastery long, old_interval long, new_interval long, old_ease double, new_ease double, n long"


def _reviewed(n_keys: int, names: list[str], needs_state: bool, every: bool):
    def run(batches):
        key, state, last, types = None, None, None, []

        def batch(rows):
            columns = list(zip(*rows))
            kinds = [*types, pa.int64(), pa.date32(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            out, types[:] = [], b.schema.types[:n_keys]
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*columns):
                mine, (known, at, ident, q, gain, score, ease, days, n) = row[:n_keys], row[n_keys:]
                if mine != key:
                    if last is not None and not every:
                        out.append((*key, *last))
                    key, last = mine, None
                    state = None if needs_state else (0, 2.5, 0, 0)
                if known == 0:
                    state = (score, ease, days, n)
                    last = (None, None, None, score, score, days, days, ease, ease, n)  # stays if no review follows
                    continue
                if state is None:
                    continue
                old_score, old_ease, old_days, seen = state
                exact = max(1.3, old_ease + 0.1 - _EASE[q])
                new_days = 1 if q < 3 or old_days == 0 else 6 if old_days == 1 else min(365, int(old_days * exact + 0.5))
                state = (max(0, min(100, old_score + gain)), round(exact, 2), new_days, seen + 1)
                last = (ident, at, q, old_score, state[0], old_days, new_days, old_ease, state[1], seen + 1)
                if every:
                    out.append((*key, *last))
            if out:
                yield batch(out)
        if last is not None and not every:
            yield batch([(*key, *last)])

    return run


def reviews(log: DataFrame, keys: list[str], state: DataFrame | None = None, every: bool = True, needs_state: bool = True, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """log(keys, ts, id, q, gain), state(keys, score, ease, days, n) -> a row for each review (or, without ``every``, each key's last), in ``order``: id, date, quality,
    mastery (0 to 100), interval and ease before and after, and the number of reviews so far.

    ease' = max(1.3, ease + 0.1 - (5 - q)(0.08 + (5 - q) 0.02)), kept in hundredths; the interval is 1 below quality 3, else 1, 6, round(interval * ease'), at most 365.
    Keys without state start with ease 2.5 and nothing else, or are left out if ``needs_state``. A key's state without new reviews is its last row unchanged. Rows without a key, time, id or quality are left out.
    One shuffle and sort; a task holds a batch of rows and one state, however long a key's log is."""
    long = lambda c: F.lit(c).cast("long")
    day = F.col("ts").cast("date")
    placed = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = log.dropna(subset=[*keys, *order, "ts", "q"]).select(*keys, F.lit(1).alias("_known"), *placed, day.alias("_d"), F.col("id").cast("long").alias("id"), F.col("q").cast("int").alias("q"), F.coalesce("gain", F.lit(0)).cast("long").alias("gain"), long(None).alias("score"), F.lit(None).cast("double").alias("ease"), long(None).alias("days"), long(None).alias("n"))
    if state is not None:
        n = F.col("n") if "n" in state.columns else F.lit(0)
        kept = state.dropna(subset=[*keys, "score", "ease", "days"]).select(*keys, F.lit(0).alias("_known"), *[F.lit(None).cast(rows.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))], F.lit(None).cast("date").alias("_d"), long(None).alias("id"), F.lit(None).cast("int").alias("q"), long(None).alias("gain"), F.col("score").cast("long").alias("score"), F.col("ease").cast("double").alias("ease"), F.col("days").cast("long").alias("days"), n.cast("long").alias("n"))
        rows = rows.unionByName(kept)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_known", *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    schema = f"{kinds}, {LOG}"
    names = [*keys, *[x.split()[0] for x in LOG.split(", ")]]
    return ordered.mapInArrow(_reviewed(len(keys), names, needs_state, every), schema)


def last_states(done: DataFrame, keys: list[str]) -> DataFrame:
    """``reviews`` without ``every`` as the state that the next day's starts from."""
    return done.select(*keys, F.col("new_mastery").alias("score"), F.col("new_ease").alias("ease"), F.col("new_interval").alias("days"), "n")


# --- schedule ----------------------------------------------------------------------------------------------------------------------
def priority(score: Column, next_review: Column, now: datetime.datetime | str) -> Column:
    """0.6 (1 - score) + 0.4 overdue, in thousandths rounded: overdue is the share of seven days since the review was due, 0.8 where none was ever scheduled."""
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(next_review.cast("timestamp"))) / F.lit(86_400_000_000.0)
    overdue = F.when(days.isNull(), 0.8).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), days) / 7))
    return F.round((1 - score) * 0.6 + overdue * 0.4, 3)


def daily_tasks(mastery: DataFrame, now: str, limit: int = 20, prefix: str | None = None) -> DataFrame:
    """mastery(email, kp, score, attempts, correct, next_review, interval) -> each learner's tasks of the day, ``limit`` (1 to 100) at most: place, priority, is_overdue,
    days_overdue (both null where nothing was scheduled), accuracy in per cent, and with each the learner's total_due, total_weak and avg_priority over these tasks.

    Points that were practised, of those whose text begins with ``prefix``, three times ``limit`` of the lowest score are taken first."""
    from pyspark.sql import Window

    limit = max(1, min(100, limit))
    d = mastery.where("attempts > 0")
    if prefix:
        d = d.where(F.col("kp").cast("string").startswith(prefix))
    mine = Window.partitionBy("email")
    d = d.withColumn("_r", F.row_number().over(mine.orderBy("score", "kp"))).where(F.col("_r") <= 3 * limit)
    d = d.withColumn("priority", priority(F.col("score"), F.col("next_review"), now))
    d = d.withColumn("place", F.row_number().over(mine.orderBy(F.desc("priority"), "score", "kp"))).where(F.col("place") <= limit)
    at = F.lit(now).cast("timestamp")
    late = (F.unix_micros(at) - F.unix_micros(F.col("next_review").cast("timestamp"))) / F.lit(86_400_000_000.0)
    d = d.withColumns({"is_overdue": F.col("next_review").cast("timestamp") < at, "days_overdue": F.greatest(F.lit(0), F.floor(late + 0.5)), "accuracy": F.round(100 * F.col("correct") / F.col("attempts"), 1)})
    d = d.withColumn("days_overdue", F.when(F.col("next_review").isNotNull(), F.col("days_overdue")))
    # a mean of whole thousandths, rounded in whole numbers
    total, n = F.sum(F.round(F.col("priority") * 1000).cast("long")).over(mine), F.count(F.lit(1)).over(mine)
    every = {"total_due": F.count_if(F.col("is_overdue")).over(mine), "total_weak": F.count_if(F.col("score") < 0.4).over(mine), "avg_priority": F.floor((2 * total + n) / (2 * n)) / 1000}
    return d.withColumns(every).select("email", "place", "kp", "score", "priority", "is_overdue", "days_overdue", "next_review", "interval", "attempts", "correct", "accuracy", *every)
