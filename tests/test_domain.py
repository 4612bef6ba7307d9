"""Golden values of the tutor's operators on small frames, worked out by hand from their definitions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import parse
from quillon.operators import patterns, relational, study


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("history, want", [
    ([], 3.0), ([(18, 20, 4.0), (16, 20, 3.5)], 4.0), ([(5, 20, 3.0), (4, 20, 2.5)], 2.0),
    ([(20, 20, 5.0)] * 3 + [(0, 20, 1.0)] * 2, 4.0), ([(0, 20, 1.0)] * 3 + [(20, 20, 5.0)] * 2, 2.0)])
def test_ability(spark, history, want):
    rows = [(1, i, dt.datetime(2024, 1, 28 - i), c, n, d) for i, (c, n, d) in enumerate(history)]
    sessions = spark.createDataFrame(rows, "email long, id long, started_at timestamp, correct_count long, question_count long, avg_difficulty double")
    users = spark.createDataFrame([(1,)], "email long")
    assert study.ability(users, sessions).first().ability == want


@pytest.mark.parametrize("able, ratio, want", [(3.0, 0.1, 3.5), (3.0, 0.3, 3.0), (3.0, 0.7, 2.5), (0.5, 0.9, 1.8), (5.5, 0.0, 4.3)])
def test_adaptive_difficulty(spark, able, ratio, want):
    assert one(spark, study.adaptive_difficulty(F.lit(able), F.lit(ratio))) == pytest.approx(want)


@pytest.mark.parametrize("level, minutes, want", [(2.0, 120, (12, 6, 2, 27)), (3.0, 120, (8, 8, 4, 27)), (3.5, 120, (5, 8, 7, 27)), (5.0, 120, (3, 6, 11, 27)), (3.5, 60, (4, 5, 4, 20)), (3.5, 150, (6, 9, 7, 29))])
def test_distribution(spark, level, minutes, want):
    assert tuple(one(spark, study.distribution(F.lit(level), F.lit(minutes)))) == want


def test_reviews_follow_the_sm2_trace(spark):
    answers = {5: (True, 5_000), 4: (True, 20_000), 3: (True, 40_000), 1: (False, 1_000)}
    log = [(1, 7, dt.datetime(2024, 1, 1 + i), i, *answers[q]) for i, q in enumerate([5, 5, 5, 4, 3, 1, 4, 5])] + [(1, 8, dt.datetime(2024, 1, 1), 99, True, None)]
    reviews = spark.createDataFrame(log, "email long, kp long, ts timestamp, id long, is_correct boolean, time_ms long")
    state = spark.createDataFrame([(1, 7, 50, 2.5, 0)], "email long, kp long, score long, ease double, days long")
    got = study.complete_reviews(state, reviews).orderBy("id").collect()
    assert [r.new_ease for r in got] == [260, 270, 280, 280, 266, 212, 212, 222]
    assert [r.new_interval for r in got] == [1, 6, 17, 48, 128, 1, 6, 13]
    assert [r.new_mastery for r in got] == [62, 74, 86, 98, 100, 85, 97, 100] and [r.old_mastery for r in got][0] == 50
    assert got[0].next_review == dt.date(2024, 1, 2) and len(got) == 8  # point 8 has no state


def test_weakness_of_two_questions(spark):
    words = {"MATH-001": ["函数", "导数", "单调性", "极值", "切线", "零点", "切线斜率", "极限"], "MATH-002": ["解析几何", "椭圆", "双曲线", "抛物线", "圆锥曲线", "韦达", "直线与曲线"]}
    core = {"导数", "椭圆"}
    keywords = spark.createDataFrame([(k, w, w in core) for k, ws in words.items() for w in ws], "kp string, keyword string, core boolean")
    kps = spark.createDataFrame([("MATH-001", "a", 4, "高"), ("MATH-002", "b", 5, "高")], "kp string, name string, difficulty int, frequency string")
    wrong = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), json.dumps({"analysis": "导数与函数单调性"}), "q1"), (1, 2, dt.datetime(2024, 1, 2), json.dumps({"analysis": "椭圆和双曲线的韦达定理"}), "q2"), (1, 3, dt.datetime(2024, 1, 3), None, "q3")], "email long, id long, ts timestamp, data string, content string")
    got = {r.kp: r for r in study.weak_points(patterns.matched(wrong, parse.search_fields(F.col("data")), keywords), kps, keywords).collect()}
    assert got["MATH-001"].weakness == pytest.approx(4 * 4 / 3 * 1.5) and got["MATH-002"].weakness == pytest.approx(4 * 5 / 3 * 1.5)
    assert got["MATH-001"].confidence == pytest.approx(3 / 8) and got["MATH-001"].errors == 1 and [s.id for s in got["MATH-002"].samples] == [2]


def test_ripple_bounds(spark):
    state = spark.createDataFrame([(1, 1, 85), (1, 2, 99), (1, 3, 10), (1, 4, 3)], "email long, kp long, score long")
    edges = spark.createDataFrame([(1, 2), (1, 9), (4, 3), (8, 3)], "src long, dst long")
    up = {r.kp: (r.old, r.new) for r in study.ripple(state, state, edges, True).collect()}
    down = {r.kp: (r.old, r.new) for r in study.ripple(state, state, edges, False).collect()}
    assert up == {2: (99, 100), 9: (None, 2)} and down == {4: (3, 0), 8: (None, 0)}


def test_tasks(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "processing", 0, now - dt.timedelta(minutes=6)), (2, "processing", 0, now - dt.timedelta(minutes=5)), (3, "processing", 2, now), (4, "pending", 0, now), (5, "processing", 1, now), (6, None, 0, None)]
    tasks = spark.createDataFrame(rows, "id long, status string, retry_count long, updated_at timestamp")
    clock = F.lit(now).cast("timestamp")
    assert {r.id: r.status for r in study.recover_stale(tasks, clock).collect()} == {1: "pending", 2: "processing", 3: "processing", 4: "pending", 5: "processing", 6: None}
    outcomes = spark.createDataFrame([(1, True), (3, False), (4, True), (5, False)], "id long, ok boolean")
    got = {r.id: (r.status, r.retry_count) for r in study.finish_tasks(tasks, outcomes, clock).collect()}
    assert got == {1: ("completed", 0), 2: ("processing", 0), 3: ("failed", 2), 4: ("pending", 0), 5: ("pending", 2), 6: (None, 0)}


def test_lists_of_a_learner_without_anything(spark):
    users = spark.createDataFrame([(1,)], "email long")
    none = spark.createDataFrame([], "email long, kp long, subject string, is_correct boolean, ts timestamp, id long")
    kps = spark.createDataFrame([(5,), (3,), (4,)], "kp long")
    d = study.dashboard(users, none, none, kps)
    assert [(r.position, r.kp, r.level) for r in d["weak_points"].orderBy("position").collect()] == [(1, 3, "normal"), (2, 4, "normal"), (3, 5, "normal")]
    assert [r.type for r in d["suggestions"].collect()] == ["success"] and d["overview"].first().practised == 0
    weak = spark.createDataFrame([], "email long, kp long, name string, difficulty int, weakness double")
    assert [(r.week, r.level) for r in study.phases(users, weak).collect()] == [(1, "medium"), (2, "hard")]


def test_parameters(spark):
    df = spark.createDataFrame([(i, i % 3, None if i == 7 else i * 2) for i in range(20)], "id long, g long, x long")
    assert relational.matching(df, {"g": 1, "x": None}).count() == 7 and relational.matching(df, {"g": ""}).count() == 20
    assert relational.between(df, "x", 4, 8).count() == 3 and relational.any_of(df, "g", None).count() == 20
    assert [r.id for r in relational.page(df, [F.desc("id")], 2, 5).collect()] == [14, 13, 12, 11, 10]
    assert [r.x for r in relational.sorted_by(df, "drop table", ["x", "g"], True, 2, 500, ["id"]).collect()] == [38, 36]
    label = F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">"))
    many = patterns.mentions(df, "id", spark.range(20_005).selectExpr("concat('<', id, '>') as word"), label, label)  # as many words as there are
    assert {(r.id, r.n) for r in many.collect()} == {(i, 1) for i in range(20)}


def test_texts_that_are_null(spark):
    null = F.lit(None).cast("string")
    assert one(spark, parse.json_array_elements(null)) == [] and one(spark, parse.lenient_json(null)) is None and one(spark, parse.suspicious(null)) is False
    assert one(spark, parse.search_fields(null)) == [] and one(spark, parse.image_quality(null, null, null, F.lit(None), F.lit(None).cast("array<string>"), F.lit(None).cast("int"))) == 0


@pytest.mark.parametrize("answer, want", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": 1} and so on', '{"a": 1}'), ('{"a": [1, 2,],}', '{"a": [1, 2]}'), ('<think>hm</think>{"a": 1}', '{"a": 1}'), ("no object", None)])
def test_model_answers(spark, answer, want):
    got = one(spark, parse.lenient_json(F.lit(answer)))
    assert (got and json.loads(got)) == (want and json.loads(want))


@pytest.mark.parametrize("broken, want", [('{"a": 1}', {"a": 1}), ("{'a': 'b',}", {"a": "b"}), ('{"a": "c\\d"}', {"a": "c\\d"}), ("{'a': 'x\\y',}", {"a": "x\\y"}), ("{a", None)])
def test_three_attempts(spark, broken, want):
    got = one(spark, parse.repaired_json(F.lit(broken)))
    assert (got and json.loads(got)) == want


def test_ripple_batch_over_a_table(spark):
    from quillon import registry
    from quillon.operators import learner

    sf = "/root/testdata/sf0.001"
    got = {(r.email, r.kp): r.mastery_percent for r in registry.queries()["dom_batch"](spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    edges = {(p, q) for p in range(n) for q in (p // 2, p // 3) if p != q and q > 0}
    score = {}
    for e in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda e: e.event_id):
        i, kp = e.event_id, e.event_id % 50
        right, hint = i % 3 != 0, i % 7 == 0
        mine = score.setdefault(e.user_id, {})
        now = mine[kp] = min(100, max(0, mine.get(kp, 0) + (5 if right and hint else 15 if right else -20)))
        for a, b in edges:
            if now >= 80 and a == kp:
                mine[b] = min(100, mine.get(b, 0) + 2)
            if now <= 40 and b == kp:
                mine[a] = max(0, mine.get(a, 0) - 5)
    assert got == {(u, k): s for u, m in score.items() for k, s in m.items()}
    log = spark.createDataFrame([(1, i, 1, 15) for i in range(150)] + [(1, 200, None, 15), (None, 201, 1, 15), (1, 202, 1, None)], "email long, id long, kp long, delta long")
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in learner.ripple_batch(log, none, most=3).collect()] == [(1, 1, 45)]


def test_chunks_over_a_table(spark):
    import re

    from quillon.functions import text

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    made = spark.createDataFrame([(-1, "# a\n\n## b\ntext\n### c\n" + "x" * 7000 + "\n## d\nend"), (-2, ""), (-3, None)], "doc_id long, text string")
    for r in d.union(made).select("doc_id", "text", text.chunk_markdown(F.col("text")).alias("c")).collect():
        parts = [x.strip(" ") for x in re.split(r"\n(?=##+\s)", r.text or "")]
        want = []
        for p in (x[k : k + 3000] for x in parts if x for k in range(0, len(x), 3000)):
            if want and len(want[-1]) + 1 + len(p) <= 3000:
                want[-1] += "\n" + p
            else:
                want.append(p)
        assert (r.c or []) == want, r.doc_id


def test_is_json(spark):
    texts = ['{"a": 1}', " [1] ", "1", '"x"', '{"a": 1} x', '{"a": 1}] x [', '{"a": 1}} x {', "1, 2", '1, "b": 2', "", "  ", "null", None, "{", "]"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(parse.is_json(F.col("t")).alias("x")).collect()]
    assert got == [True] * 4 + [False] * 7 + [True] + [False] * 3


def test_keyed_writes_with_nulls_and_double_keys(spark, tmp_path):
    from quillon.operators import tables

    old = spark.createDataFrame([(1, "a", 10), (2, "b", None), (None, "n", 5)], "k long, v string, x long")
    new = spark.createDataFrame([(2, "c", 7), (2, "d", None), (3, None, 1), (None, "m", 6)], "k long, v string, x long")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    want = lambda *r: sorted(r, key=str)
    # of two new rows with key 2 the larger counts; null keys match nothing
    assert rows(tables.upsert(old, new, ["k"])) == want((1, "a", 10), (2, "d", None), (3, None, 1), (None, "m", 6), (None, "n", 5))
    assert rows(tables.upsert_keep(old, new, ["k"])) == want((1, "a", 10), (2, "d", None), (3, None, 1), (None, "m", 6), (None, "n", 5))
    assert rows(tables.insert_ignore(old, new, ["k"])) == want((1, "a", 10), (2, "b", None), (None, "n", 5), (3, None, 1), (None, "m", 6))
    assert rows(tables.update(old, new, ["k"])) == want((1, "a", 10), (2, "d", None), (None, "n", 5))
    assert rows(tables.delete(old, new, ["k"])) == want((1, "a", 10), (None, "n", 5))
    state = tables.save(tables.upsert(old, new, ["k"]), str(tmp_path / "next"))
    assert state.count() == 5 and state.schema == old.schema


def test_registered_queries_take_parameters(spark):
    import __spark_entry__ as entry

    q, sf = entry.queries(), "/root/testdata/sf0.001"
    assert q["top_sort_whitelist"](spark, sf, column="attempts", descending=True, limit=3).count() == 3
    assert q["flt_dynamic"](spark, sf, province=None).count() == q["flt_dynamic"](spark, sf, level="").count() > 0
    assert q["st_fixed_window_limit"](spark, sf, most=10_000).agg(F.sum("refused")).first()[0] == 0
