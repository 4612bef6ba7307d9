"""As-of join against a loop; session windows and dropped repeats on a stream with late rows, stopped and resumed."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import asof
from quillon.streaming import online

DAY = dt.datetime(2024, 1, 1)


def test_asof(spark):
    r = random.Random(1)
    when = lambda: DAY + dt.timedelta(hours=r.randint(0, 200))
    # one key has half of the rows; times repeat
    left = [(i, 1 if i % 2 else r.randint(2, 9), when()) for i in range(400)] + [(900, None, DAY), (901, 1, None), (902, 77, DAY), (902, 77, DAY)]
    right = [(1 if i % 2 else r.randint(2, 9), when(), i, None if i % 11 == 0 else i * 10) for i in range(300)] + [(None, DAY, 1, 1), (1, None, 2, 2)]
    want = []
    for i, k, t in left:
        before = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        best = max(before, key=lambda x: (x[1], x[2])) if before else (None,) * 4
        want.append((i, best[2], best[3]))
    l, x = spark.createDataFrame(left, "id long, k long, ts timestamp"), spark.createDataFrame(right, "k long, ts timestamp, n long, v long")
    for seconds in (3600, 86_400, 10**9):
        got = asof.asof(l, x, ["k"], "ts", {"n": "last", "v": "value"}, seconds, ["n"]).select("id", "last", "value").collect()
        assert sorted((tuple(g) for g in got), key=str) == sorted(want, key=str)
    assert asof.asof(l, x.where("false"), ["k"], "ts", {"n": "last"}).where("last is null").count() == len(left)
    with pytest.raises(ValueError):
        asof.asof(l, x, ["k"], "ts", {"n": "id"})


def test_sessions_on_a_stream(spark, tmp_path):
    schema = "id long, email long, ts timestamp"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def arrive(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"id": i, "email": e, "ts": (DAY + dt.timedelta(minutes=m)).isoformat()}) + chr(10) for i, e, m in rows))

    def run():  # each call is a new start from the checkpoint
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        q = online.sessions(s, "30 minutes", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)

    first = [(1, 1, 0), (2, 1, 20), (3, 2, 5), (2, 1, 20)]  # one comes twice
    second = [(4, 1, 45), (3, 2, 5), (5, 2, 100)]  # late but in time, and again
    arrive(1, first)
    run()
    arrive(2, second)
    run()
    arrive(3, [(6, 3, 1000)])
    run()
    arrive(4, [(7, 1, 50), (8, 3, 2000)])  # the first is too late
    run()
    got = {(x.email, x.started_at, x.ended_at, x.n) for x in spark.read.parquet(out).collect()}
    at = lambda m: DAY + dt.timedelta(minutes=m)
    assert got == {(1, at(0), at(75), 3), (2, at(5), at(35), 1), (2, at(100), at(130), 1), (3, at(1000), at(1030), 1)}
    table = spark.createDataFrame([(i, e, at(m)) for i, e, m in first + second], schema)
    assert {tuple(x) for x in online.sessions(table).collect()} == {x for x in got if x[0] != 3}
