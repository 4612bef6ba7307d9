"""Learner state as ordered folds over the feedback log: one shuffle by learner (and point), no driver state."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds


def quality(correct: Column, time_ms: Column) -> Column:
    """Recall quality 1..5 of an answer from its correctness and time."""
    return F.when(~correct, F.when(time_ms > 30_000, 2).otherwise(1)).when(time_ms < 10_000, 5).when(time_ms < 30_000, 4).when(time_ms < 60_000, 3).otherwise(2)


def sm2(log: DataFrame, keys: list[str], order: list[str], q: str) -> DataFrame:
    """Spaced repetition state after each key's reviews in order: ease in hundredths, interval in days, reviews; ``folds.reviews`` says how."""
    rows = log.select(*keys, *order, F.col(q).alias("q"), F.lit(0).alias("gain"), *[F.lit(v).alias(c) for c, v in (("ts", datetime.datetime(2000, 1, 1)), ("id", 0)) if c not in {*keys, *order}])
    s = folds.reviews(rows, keys, every=False, needs_state=False, order=tuple(order))
    return s.select(*keys, F.round(F.col("new_ease") * 100).cast("long").alias("ease_hundredths"), F.col("new_interval").alias("interval_days"), F.col("n").alias("reviews"))


def ripple_batch(log: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """log(email, id, kp, delta), edges(src, dst) -> (email, kp, mastery_percent): mastery in hundredths when each answer also moves neighbours: +2 for
    prerequisites once a point reaches 80, -5 for dependents once it is at 40 or less. Later answers see earlier ripples.

    Feedback without learner, point or delta is skipped; with ``most``, so is what comes after a learner's first ``most``. A learner's answers are
    walked in id order, a batch of rows at a time; what is held are the scores of one learner's points."""
    import pandas as pd

    def scores(email, score: dict[int, int]) -> pd.DataFrame:
        return pd.DataFrame({"email": email, "kp": list(score), "mastery_percent": list(score.values())})

    def run(batches):
        email, score, n = None, {}, 0
        for b in batches:
            for r in b.itertuples():
                if r.email != email:
                    if score:
                        yield scores(email, score)
                    email, score, n = r.email, {}, 0
                n += 1
                if most is not None and n > most:
                    continue
                now = score[r.kp] = min(100, max(0, score.get(r.kp, 0) + r.delta))
                if now >= 80:
                    for k in r.ups:
                        score[k] = min(100, score.get(k, 0) + 2)
                if now <= 40:
                    for k in r.downs:
                        score[k] = max(0, score.get(k, 0) - 5)
        if score:
            yield scores(email, score)

    sound = log.where("email is not null and kp is not null and delta is not null")
    return with_neighbours(sound, edges).repartition("email").sortWithinPartitions("email", "id").mapInPandas(run, "email long, kp long, mastery_percent long")


def with_neighbours(log: DataFrame, edges: DataFrame) -> DataFrame:
    ups = edges.groupBy(F.col("src").alias("u")).agg(F.collect_list("dst").alias("ups"))
    downs = edges.groupBy(F.col("dst").alias("d")).agg(F.collect_list("src").alias("downs"))
    none = F.array().cast("array<long>")
    j = log.join(ups, F.col("kp") == F.col("u"), "left").join(downs, F.col("kp") == F.col("d"), "left")
    return j.select("email", "id", "kp", "delta", F.coalesce("ups", none).alias("ups"), F.coalesce("downs", none).alias("downs"))
