import json

import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.functions import parse, text
from quillon.operators import learner, tables, vector
from quillon.sources import files
from quillon.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agg_student_perf", "dom_mastery_fold", "win_streak", "agg_percentiles", "dom_sm2", "snk_upsert_keep", "snk_replace", "top_two_phase", "fn_json_repair", "fn_sse_parse", "st_token_bucket", "st_resend_guard", "dom_kp_resolution", "dom_paper", "dom_migration", "dom_graph_build", "src_cypher", "src_jsonl", "src_metadata_json", "snk_file_per_group"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    c = con.execute(registry.oracles()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = sorted([tuple(norm(dict(zip(names, r))[k]) for k in sorted(names)) for r in c.fetchall()], key=str)
    assert sorted([tuple(norm(r[k]) for k in sorted(names)) for r in df.collect()], key=str) == want and want


def test_sm2_trace(spark):
    log = spark.createDataFrame([(1, i, q) for i, q in enumerate([5, 5, 5, 4, 3, 1, 4, 5])], "k long, i long, q int")
    ease = [260, 270, 280, 280, 266, 212, 212, 222]
    days = [1, 6, 17, 48, 128, 1, 6, 13]
    for n in range(1, 9):
        r = learner.sm2(log.where(f"i < {n}"), ["k"], ["i"], "q").first()
        assert (r.ease_hundredths, r.interval_days, r.reviews) == (ease[n - 1], days[n - 1], n)


def test_ripple(spark):
    log = spark.createDataFrame([(1, i, 1, 15) for i in range(6)] + [(1, 6, 2, -20)], "email long, id long, kp long, delta long")
    edges = spark.createDataFrame([(1, 3), (2, 3), (4, 2)], "src long, dst long")
    got = {r.kp: r.mastery_percent for r in learner.ripple_batch(log, edges).collect()}
    assert got == {1: 90, 3: 2, 2: 0, 4: 0}


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id as email", "event_id % 50 as kp", "cast(ts as timestamp) as ts", "event_id as id", "cast(case when event_id % 3 <> 0 then 15 else -20 end as long) as delta").orderBy("ts")
    parts = rows.toPandas()
    for k in range(3):
        part = parts.iloc[len(parts) * k // 3 : len(parts) * (k + 1) // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.mastery(stream).writeStream.outputMode("update").format("memory").queryName("mastery_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {(r.email, r.kp): r.mastery_percent for r in spark.sql("select email, kp, max_by(mastery_percent, attempts) as mastery_percent from mastery_out group by email, kp").collect()}
    want = {}
    for r in parts.sort_values(["ts", "id"]).itertuples():
        want[r.email, r.kp] = min(100, max(0, want.get((r.email, r.kp), 0) + r.delta))
    assert last == want


def test_streaming_limits_equal_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id as email", "cast(ts as timestamp) as ts", "event_id as id", "event_type = 'purchase' as asks", "event_type <> 'error' as good").orderBy("ts")
    parts = rows.toPandas()
    for k in range(3):
        spark.createDataFrame(parts.iloc[len(parts) * k // 3 : len(parts) * (k + 1) // 3], rows.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def replay(name, f):
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    views = registry.queries()
    got = {r.email: (r.g, r.n) for r in replay("bucket_out", lambda s: online.token_bucket(s, 2, 86_400)).groupBy("email").agg(F.expr("count_if(granted)").alias("g"), F.count("*").alias("n")).collect()}
    want = {r.email: (r.granted, r.granted + r.delayed) for r in views["st_token_bucket"](spark, SF).collect()}
    assert got == want and any(g < n for g, n in got.values())

    def outcomes(again, expiry, tries):
        sent, n, out = {}, {}, {}
        for r in parts.sort_values(["ts", "id"]).itertuples():
            at, e = r.ts.timestamp(), r.email
            if r.asks:
                out[r.id] = "refused" if e in sent and at - sent[e] < again else "sent"
                if out[r.id] == "sent":
                    sent[e], n[e] = at, 0
            elif e not in sent or at - sent[e] > expiry or n[e] >= tries:
                out[r.id] = "refused"
                sent.pop(e, None)
            elif r.good:
                out[r.id] = "verified"
                sent.pop(e)
            else:
                out[r.id] = "wrong"
                n[e] += 1
        return out

    got = {r.id: r.outcome for r in replay("guard_out", lambda s: online.resend_guard(s, 6 * 3600, 5 * 86_400, 5)).collect()}
    assert got == outcomes(6 * 3600, 5 * 86_400, 5) and set(got.values()) == {"sent", "verified", "wrong", "refused"}


def test_nearest(spark):
    import numpy as np

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array(e["embedding"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, total = e["vec_id"].to_numpy(), 0, 0
    got = {}
    for r in registry.queries()["top_vector_ann"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s, kind="stable")[:5]].tolist())
        hits, total = hits + len(best & set(got[ids[i]].values())), total + 5
    assert len(got) == len(asked) and hits / total >= 0.9


def test_nearest_cases(spark, monkeypatch):
    monkeypatch.setattr(vector, "CHUNK", 2)  # several chunks on either side of a cell
    kind = "id long, v array<double>"
    odd = [(None, [1.0, 0.0]), (90, None), (91, [0.0, 0.0]), (92, [1.0]), (93, [float("nan"), 1.0]), (94, [None, 1.0])]
    d = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(9)] + [(3, [1.0, 0.3]), (20, [1.0, 0.4])] + odd, kind)
    got = [(r.id, r.rank, r.neighbour) for r in vector.nearest(d, d.where("id in (4, 20, 90, 92)"), 3, 1.0).orderBy("id", "rank").collect()]
    assert got == [(4, 1, 20), (4, 2, 5), (4, 3, 3), (20, 1, 4), (20, 2, 5), (20, 3, 3)]
    assert vector.nearest(d.limit(0), d, 3).count() == 0


def test_text(spark):
    md = "intro\n## A\n" + "a" * 50 + "\n## B\n" + "b" * 130
    df = spark.createDataFrame([(md,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.chunk_markdown(df.t, 100)).collect()]
    assert all(len(c) <= 100 for c in got[0]) and "".join(got[0]).replace("\n", "") == md.replace("\n", "") and got[1] == []
    # the place of a piece is not what is trimmed
    trimmed = spark.createDataFrame([("0 intro 0\n## 1 in 1 ",)], "t string").select(text.chunk_markdown(F.col("t"), 12)).first()[0]
    assert trimmed == ["0 intro 0", "## 1 in 1"]
    assert text.first_balanced_object('a {"x": "}{", "y": {"z": 1}} b') == '{"x": "}{", "y": {"z": 1}}' and text.first_balanced_object("{") is None
    r = spark.createDataFrame([("{'a': [1, 2,],}",), ("{}",), ("no",)], "t string").select(parse.repaired_json(F.col("t")).alias("j")).collect()
    assert [x.j and json.loads(x.j) for x in r] == [{"a": [1, 2]}, {}, None]


def test_sources(spark, tmp_path):
    (tmp_path / "kp.json").write_text(json.dumps([{"id": "M1", "name": "x", "level": None}, {"id": "M2", "level": "b"}]))
    assert [r.level for r in files.knowledge_points(spark, str(tmp_path / "kp.json"), "a").orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("---\nid: 7\nname: 'Sets'\n---\nsee [[B0|b]] and [[C1]] [[B0]]")
    f = files.markdown_folder(spark, str(tmp_path / "n"))
    r = f.select(files.frontmatter(f.text, "name").alias("n"), files.frontmatter(f.text, "none").alias("z"), files.wiki_links(f.text).alias("l")).first()
    assert (r.n, r.z, r.l) == ("Sets", None, ["B0", "C1"])
    none = spark.createDataFrame([], "hash string")
    found = files.registry_scan(spark, str(tmp_path), [".md"], none)
    assert found.count() == 1 and files.registry_scan(spark, str(tmp_path), [".md"], found).count() == 0


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "k int, v string")
    assert sorted(tables.insert_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, None), (3, "c")]
    assert {r.k: r.v for r in tables.upsert_keep(old, new.distinct(), ["k"]).collect()} == {1: "a", 2: "b", 3: "c"}
    assert {r.k for r in tables.violations(old, {"has_v": "v is not null"}).collect()} == {2}
