"""Associative and streaming folds, the review schedule, and word matching without a bound, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import folds, patterns

DAY = dt.datetime(2024, 1, 1)


# --- clamped folds -------------------------------------------------------------------------------------------------------


def walked(rows, low, high, start):
    out: dict = {}
    for *key, _, delta, extra in sorted((r for r in rows if None not in r[:4]), key=lambda r: r[2]):
        x, n, s = out.get(tuple(key), (start, 0, 0))
        out[tuple(key)] = min(high, max(low, x + delta)), n + 1, s + extra
    return out


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_clamped_fold(spark, partitions):
    r = random.Random(1)
    # one key has half of all rows, and walks against both bounds
    rows = [(1 if i % 2 else r.randint(2, 40), r.choice("xyé"), i, r.choice([15, 5, -20, -40, 60]), 1) for i in range(6_000)]
    rows += [(None, "x", 1, 5, 1), (2, None, 2, 5, 1), (2, "x", None, 5, 1), (2, "x", 3, None, 1)]
    r.shuffle(rows)
    log = spark.createDataFrame(rows, "k long, g string, i long, delta int, extra long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {(x.k, x.g): (x.score, x.n, x.extra) for x in folds.clamped(log, ["k", "g"], ["i"], "delta", 0, 100, 30, ("extra",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == walked(rows, 0, 100, 30)
    assert folds.clamped(log.where("false"), ["k"], ["i"], "delta").count() == 0


def test_a_hot_key_is_many_tasks(spark):
    log = spark.range(40_000).select(F.lit(7).alias("k"), F.col("id").alias("i"), (F.col("id") % 7 - 3).alias("delta")).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        d = folds.clamped(log, ["k"], ["i"], "delta", 0, 5)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange rangepartitioning") == 1
        x = 0
        for i in range(40_000):
            x = min(5, max(0, x + i % 7 - 3))
        assert [tuple(r) for r in d.collect()] == [(7, x, 40_000)]
        one = log.repartitionByRange(4, "k", "i").groupBy(F.spark_partition_id()).count().collect()
        assert len(one) == 4  # the ranges of the key
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# --- spaced repetition -----------------------------------------------------------------------------------------------------


def reviewed(rows, start):
    """(key, id) -> (mastery, interval, ease in hundredths), one review after another."""
    state, out = dict(start), {}
    for key, at, ident, q, gain in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in state:
            continue
        score, ease, days = state[key]
        exact = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        days = 1 if q < 3 or days == 0 else 6 if days == 1 else min(365, int(days * exact + 0.5))
        state[key] = max(0, min(100, score + gain)), round(exact, 2), days
        out[key, ident] = state[key][0], days, round(100 * state[key][1])
    return out


def test_reviews_go_on_from_saved_states(spark):
    r = random.Random(2)
    rows = [(r.randint(1, 12), DAY + dt.timedelta(hours=r.randint(0, 200)), i, r.randint(1, 5), r.choice([12, 5, -15])) for i in range(800)]
    start = {k: (r.randint(0, 100), 2.5, k % 3) for k in range(1, 10)}  # points 10 to 12 have no state; 99 no reviews
    states = spark.createDataFrame([(k, *v) for k, v in start.items()] + [(99, 40, 2.1, 6), (98, None, 2.5, 0)], "k long, score long, ease double, days long")
    log = spark.createDataFrame(rows + [(None, DAY, 900, 5, 12), (1, None, 901, 5, 12), (1, DAY, 902, None, 12)], "k long, ts timestamp, id long, q int, gain long")
    seen = lambda d: {(x.k, x.id): (x.new_mastery, x.new_interval, round(x.new_ease * 100)) for x in d.where("id is not null").collect()}
    whole = folds.reviews(log, ["k"], states)
    assert seen(whole) == reviewed(rows, start)
    # the log of a later time needs the states of the earlier one only
    cut = DAY + dt.timedelta(hours=90)
    early = folds.reviews(log.where(F.col("ts") < F.lit(cut)), ["k"], states, every=False)
    mid = folds.last_states(early, ["k"])
    late = folds.reviews(log.where(F.col("ts") >= F.lit(cut)), ["k"], mid)
    assert seen(late) == {k: v for k, v in reviewed(rows, start).items() if next(x[1] for x in rows if (x[0], x[2]) == k) >= cut}
    last = folds.reviews(log.where(F.col("ts") >= F.lit(cut)), ["k"], mid, every=False)
    final = {x.k: (x.new_mastery, x.new_ease, x.new_interval, x.n) for x in last.collect()}
    assert final == {x.k: (x.new_mastery, x.new_ease, x.new_interval, x.n) for x in folds.reviews(log, ["k"], states, every=False).collect()} and final[99] == (40, 2.1, 6, 0)


def test_a_long_log_takes_linear_time(spark):
    log = spark.range(400_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), "id", (F.col("id") % 5 + 1).cast("int").alias("q"), F.lit(1).alias("gain"))
    out = folds.reviews(log, ["k"], needs_state=False)
    assert out.agg(F.count("id"), F.max("n")).first() == (400_000, 400_000)


def test_schedule(spark):
    rows = [(1, 10 + i, 0.5, 4, 2, None if i == 0 else dt.date(2024, 1, 31) - dt.timedelta(days=i - 3), i) for i in range(8)] + [(1, 99, 0.1, 0, 0, None, 0), (2, 10, 0.3, 3, 1, dt.date(2024, 1, 1), 6)]
    m = spark.createDataFrame(rows, "email long, kp long, score double, attempts long, correct long, next_review date, interval long")
    got = folds.daily_tasks(m, "2024-01-31 00:00:00", limit=3).orderBy("email", "place").collect()
    assert [(x.email, x.kp, x.priority, x.is_overdue, x.days_overdue) for x in got] == [(1, 10, 0.62, None, None), (1, 17, 0.529, True, 4), (1, 16, 0.471, True, 3), (2, 10, 0.82, True, 30)]
    assert [(x.total_due, x.total_weak, x.avg_priority, x.accuracy) for x in got if x.place == 1] == [(2, 0, 0.54, 50.0), (1, 1, 0.82, 33.3)]
    assert folds.daily_tasks(m, "2024-01-31 00:00:00", prefix="99").count() == 0 and folds.daily_tasks(m, "2024-01-31 00:00:00", limit=500, prefix="1").count() == 9


# --- words in texts --------------------------------------------------------------------------------------------------------


def test_held_words(spark):
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abé日 ") for _ in range(n))
    texts = [None, "", "a", "aa", "日"] + [some(r.randint(0, 30)) for _ in range(300)] + ["ab" * 40_000]
    words = [None, "", "a", "日", "aa"] + [some(r.randint(1, 6)) for _ in range(300)]
    t, w = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in words], "word string")
    want = {(x, y) for x in texts for y in words if x and y and y in x}
    for shuffled in (None, True):
        got = [tuple(x) for x in patterns.held_words(t, w, shuffled).collect()]
        assert set(got) == want and len(got) == len(want)
    assert patterns.held_words(t, w.where("false")).count() == 0 and patterns.held_words(t.where("false"), w).count() == 0


def test_a_hundred_thousand_words(spark):
    words = spark.range(100_000).select(F.concat(F.lit("key"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("word"))
    texts = [" ".join(f"key{(i * 7919 + j * 104_729) % 200_000:06d}" for j in range(5)) for i in range(400)]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    want = sorted((x, w) for x in texts for w in set(x.split()) if int(w[3:]) < 100_000)
    assert sorted(tuple(x) for x in patterns.held_words(t, words).collect()) == want
    assert sorted(tuple(x) for x in patterns.held_words(t, words, shuffled=True).collect()) == want


def test_matched_and_mentions(spark):
    rows = spark.createDataFrame([(1, ["the blue ring", "x"], 1), (2, ["nothing"], 1), (3, [], 1), (4, ["the blue ring", "x"], 1), (5, None, 1)], "id long, f array<string>, word int")
    keywords = spark.createDataFrame([("Blue",), ("RING",), ("ing r",), (None,), ("e r",), ("blue",)], "keyword string")
    got = {x.id: x.hits for x in patterns.matched(rows, F.col("f"), keywords).collect()}
    assert got == {1: ["Blue", "RING", "blue", "e r"], 4: ["Blue", "RING", "blue", "e r"]}
    d = spark.createDataFrame([(1, "steel rod", "rod"), (2, "bolt", "bolt"), (3, None, None)], "node long, label string, own string")
    words = spark.createDataFrame([("rod", 2), ("steel", 3), ("a rod of brass", 5), ("rod", 1), (None, 9)], "word string, w long")
    assert {x.node: x.n for x in patterns.mentions(d, "node", words, F.col("label"), F.col("own"), "w").collect()} == {1: 11}
    assert {x.node: x.n for x in patterns.mentions(d, "node", words, F.col("label"), F.col("own")).collect()} == {1: 3}
