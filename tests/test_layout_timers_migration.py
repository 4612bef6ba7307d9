"""Writes by partition, tasks with timers on a stopped and resumed stream, migrations broken at every step."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import layout, migrate, tables
from quillon.streaming import timers

DAY = dt.datetime(2024, 1, 1)
OPS = {"upsert": tables.upsert, "upsert_keep": tables.upsert_keep, "update": tables.update, "delete": tables.delete, "replace": tables.replace, "insert_ignore": tables.insert_ignore, "insert": tables.insert}


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "_staged" not in str(p) and "_changes" not in str(p)}


@pytest.mark.parametrize("name", OPS)
def test_writes_by_partition(spark, tmp_path, name):
    kind = "k long, v string, w long"
    old = spark.createDataFrame([(i, f"v{i}", i % 5) for i in range(3000)] + [(None, "a", 1), (None, "b", 2)], kind)
    new = spark.createDataFrame([(i, None if i % 2 else f"n{i}", i) for i in (5, 6, 7, 2999, 3001, 3002)] + [(None, "c", 3)], kind)
    path = str(tmp_path / "t")
    layout.create(old, path, ["k"], 40)
    before = _files(tmp_path / "t")
    op = lambda o, n, key: OPS[name](o, n, key) if name != "insert" else tables.insert(o, n)
    rows = lambda d: sorted(map(tuple, d.select("k", "v", "w").collect()), key=str)
    want = rows(op(old, new, ["k"]))
    touched = layout.write(spark, path, new, op)
    assert 1 <= len(touched) <= 7
    assert rows(layout.read(spark, path)) == want
    after = _files(tmp_path / "t")
    kept = [p for p in before if not any(f"_part={n}/" in p for n in touched) and "_layout" not in p]
    assert len(kept) > 0 and all(after[p] == before[p] for p in kept)
    if name in ("update", "delete"):
        layout.write(spark, path, new, op)
        assert rows(layout.read(spark, path)) == want


def test_write_broken_between_steps(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.create(spark.range(500).selectExpr("id as k", "id * 2 as v"), path, ["k"], 8)
    new = spark.createDataFrame([(3, -1), (700, -2)], "k long, v long")
    layout.stage(spark, path, new, tables.upsert)  # the run ends here
    assert layout.read(spark, path).where("v < 0").count() == 0
    assert layout.finish(spark, path) and not layout.finish(spark, path)
    assert {tuple(x) for x in layout.read(spark, path).where("v < 0").collect()} == {(3, -1), (700, -2)}
    # all rows of a partition go, no change at all, clashing names
    layout.write(spark, path, spark.range(1000).selectExpr("id as k"), tables.delete)
    assert layout.read(spark, path).count() == 0
    assert layout.write(spark, path, new.where("false"), tables.upsert) == []
    with pytest.raises(ValueError):
        layout.create(spark.range(1).withColumn("_part", F.lit(1)), str(tmp_path / "u"), ["id"], 2)


def test_timers_on_a_resumed_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    r = random.Random(3)
    log = []
    for task in range(12):
        t = r.uniform(0, 3000)
        for status in r.choice([["pending", "processing", "completed"], ["processing", "failed"], ["processing"], ["processing", "processing", "processing", "completed"]]):
            log.append((task, len(log), status, t))
            t += r.choice([20, 299.9995, 300, 300.002, 400, 900])
    log.sort(key=lambda x: x[3])
    for i in range(0, len(log) - 3, 4):  # arrive out of order, some twice
        log[i], log[i + 2] = log[i + 2], log[i]
    log += log[-4:]
    schema = "task long, id long, status string, ts timestamp"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    at = lambda s: DAY + dt.timedelta(microseconds=round(s * 1e6))

    def arrive(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"task": t, "id": i, "status": s, "ts": at(x).isoformat()}) + chr(10) for t, i, s, x in rows))

    def run():
        s = spark.readStream.schema(schema).json(source)
        timers.recovered(s, 300, "20 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    cut = len(log) // 3
    for n, rows in enumerate((log[:cut], log[cut : 2 * cut], log[2 * cut :])):
        arrive(n, rows)
        run()  # stopped and started again from the checkpoint
    arrive(9, [(99, 10_000, "pending", 100_000.0)])
    run()
    arrive(10, [(0, 10_001, "processing", 10.0), (98, 10_002, "pending", 100_001.0)])  # the first is too late
    run()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    table = spark.createDataFrame([(t, i, s, at(x)) for t, i, s, x in log], schema)
    want = sorted(map(tuple, timers.recovered_table(table, F.lit(at(98_800))).collect()))
    assert got == want and 3 <= len(want) < len(log)
    loop = []
    for task in range(12):
        mine = sorted({(x, i, s) for t, i, s, x in log if t == task})
        loop += [(task, at(a[0])) for a, b in zip(mine, [*mine[1:], (1e9,)]) if a[2] == "processing" and b[0] - a[0] > 300.001]
    assert {x[:2] for x in want} >= set(loop)


def _sources(spark):
    wrong = [
        (1, 1, '{"subject": "数学", "knowledge_points": ["P1", "P2"], "difficulty": "4 stars", "question_id": 10, "session_id": "s1", "user_answer": "A", "correct_answer": {"x": 1}}'),
        (2, 1, '{"subject": "physics", "knowledge_point_id": "P9", "knowledge_points": ["P1"], "difficulty": 77, "question_id": "12", "session_id": "s1"}'),
        (3, 1, '{"subject": "art", "knowledge_points": [], "difficulty": "hard", "question_id": 0, "session_id": "gone"}'),
        (4, 2, "not json"), (5, 2, None), (6, 2, "[1, 2]"), (7, 2, '{"knowledge_point_id": 5, "knowledge_points": ["P3"], "difficulty": null, "question_id": 404}'),
        (8, 2, "not json"), (9, 2, None), (10, 2, '{"session_id": "s2"}'),
    ]
    questions = [(10, 1, 1, '["P1", "P1", {"id": "P2"}, {"x": 1}, 7, ""]'), (11, 1, 1, '"P5"'), (12, 1, 2, "{bad"), (13, 2, 1, None), (14, 77, 1, '{"id": "P6"}')]
    return {
        "wrong": spark.createDataFrame(wrong, "id long, email long, data string"),
        "questions": spark.createDataFrame(questions, "id long, paper_id long, question_number long, knowledge_points string"),
        "papers": spark.createDataFrame([(1, 4, 2020, "math"), (2, 5, 2021, "physics")], "id long, province long, yr int, subject string"),
        "sessions": spark.createDataFrame([("s1", 1, "math", "completed"), ("s2", 2, "math", "open")], "id string, email long, subject string, status string"),
    }


def _state(t):
    return {n: sorted((str(x) for x in d.select(*sorted(d.columns)).collect())) for n, d in t.items() if n in ("wrong", "questions", "question_points", "practice")}


def test_migration(spark, tmp_path):
    t = migrate.migrate(spark, str(tmp_path / "whole"), migrate.STEPS, _sources(spark))
    w = {x.id: x for x in t["wrong"].collect()}
    assert set(w) == {1, 2, 4, 5, 6, 10}  # 8 and 9 repeat, 3 and 7 refer to nothing
    assert (w[1].subject_code, w[1].knowledge_point_id, w[1].difficulty, w[1].question_id, w[1].user_answer, w[1].correct_answer) == ("math", "P1", 4, 10, "A", '{"x":1}')
    assert (w[2].subject_code, w[2].knowledge_point_id, w[2].difficulty, w[2].question_id) == ("physics", "P9", 5, 12)
    assert all(w[i].difficulty is None and w[i].subject_code is None for i in (4, 5, 6, 10))
    assert {tuple(x) for x in t["question_points"].collect()} == {(10, "P1"), (10, "P2"), (11, "P5"), (14, "P6")}
    assert {(x.id, x.subject_code, x.province_code, x.year) for x in t["questions"].collect()} == {(10, "math", 4, 2020), (12, "math", 4, 2020), (13, "physics", 5, 2021), (14, None, None, None)}
    assert {(x.wrong_id, x.session_id) for x in t["practice"].collect()} == {(1, "s1"), (2, "s1")}
    typed = {x.id: x for x in migrate.typed(_sources(spark)["wrong"]).collect()}
    assert (typed[3].difficulty, typed[3].subject_code, typed[3].question_id) == (1, None, None)
    assert (typed[7].knowledge_point_id, typed[7].difficulty, typed[7].question_id) == (None, None, 404)
    want = _state(t)
    for broken in range(len(migrate.STEPS)):
        folder = str(tmp_path / f"b{broken}")

        def fail(tables, s=migrate.STEPS[broken]):
            next(iter(s.run(tables).values())).write.mode("overwrite").parquet(f"{folder}/{s.version:04d}/{next(iter(s.run(tables)))}")
            raise RuntimeError("lost")

        steps = [s._replace(run=fail) if i == broken else s for i, s in enumerate(migrate.STEPS)]
        with pytest.raises(RuntimeError):
            migrate.migrate(spark, folder, steps, _sources(spark))
        assert len(migrate.ledger(spark, folder)) == broken
        assert _state(migrate.migrate(spark, folder, migrate.STEPS, _sources(spark))) == want
    with pytest.raises(ValueError):
        migrate.migrate(spark, folder, [migrate.STEPS[0]._replace(name="other")], _sources(spark))
