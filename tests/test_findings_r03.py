"""Faults of findings of round 3: each test failed before its change."""

import shutil

import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.operators import layout, migrate, patterns, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


def rows_of(names, rows):
    norm = lambda v: round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(norm(dict(zip(names, r))[k]) for k in sorted(names)) for r in rows), key=str)


@pytest.mark.parametrize("name", ["src_kp_seed", "dom_graph_export_edges"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    c = con.execute(registry.oracles()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, c.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_edges_of_every_learner_and_of_the_whole_graph(spark):
    rows = registry.queries()["dom_graph_export_edges"](spark, SF)
    learners = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert rows.where("email is null").count() > 0 and rows.select("email").where("email is not null").distinct().count() > learners // 2


def test_rows_of_one_node_count_each_as_in_sql(spark):
    d = spark.createDataFrame([(1, "steel rod", "rod"), (1, "steel rod", "rod"), (2, "bolt", None), (3, None, "rod")], "node long, label string, own string")
    words = spark.createDataFrame([("rod",), ("steel",), ("a rod of brass",)], "word string")
    assert {x.node: x.n for x in patterns.mentions(d, "node", words, F.col("label"), F.col("own")).collect()} == {1: 6, 3: 2}


def test_equal_questions_are_taken_apart_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def of(text):
        calls.add(1)
        return [text] if text else None

    fields = F.udf(of, "array<string>").asNondeterministic()
    rows = spark.range(400).select("id", F.when(F.col("id") % 3 < 2, F.concat(F.lit("ring "), F.col("id") % 3)).alias("data"))
    got = patterns.matched(rows, fields("data"), spark.createDataFrame([("ring",)], "keyword string"), "data")
    assert got.count() == 267 and calls.value <= 3


def test_alignment_needs_no_rows_of_tokens(spark):
    from quillon.llm import alignment
    from quillon.llm.queries import tokenizer_path

    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "né\n\n one")], "doc_id long, text string")
    rows = {}
    for x in alignment.links(docs, a, b).collect():
        rows.setdefault(x.k, []).append((x.end, x.a, x.b, x.ends, x.g))
    both = alignment._Pair(a, b)
    for doc, text in ((1, "one two"), (3, "né\n\n one")):
        assert rows[doc] == list(zip(*[c.tolist() for c in both.links(text)])) and rows[doc][-1][0] == len((" " + text).encode())
    texts, _ = alignment.align(docs, a, b)
    assert {x.doc_id: x.n_links for x in texts.collect()} == {1: len(rows[1]), 2: 0, 3: len(rows[3])} and "pairs" in texts.columns


def test_json_texts_are_parsed_once_and_others_not_at_all(spark):
    texts = ['["a", {"id": "b"}, 7, "", null, "a"]', " \t[\"c\"]", '{"id": "d"}', '"e"', "point 5", "{bad", "[bad", "tru", "true", "-1", "", None, "+1", "NaN", "[]", "[[\"x\"]]"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, data string")
    points = migrate.points_of(d, "id", "data")
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "RLIKE" in plan
    assert {tuple(x) for x in points.collect()} == {(0, "a"), (0, "b"), (1, "c"), (2, "d"), (3, "e")}
    same = d.select((F.try_parse_json("data").isNull() == migrate.parsed(F.col("data")).isNull()).alias("same"))
    assert all(x.same for x in same.collect())


def test_rows_without_orphans_ask_for_no_distinct_ids(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, 7)], "id long, q long")
    known = spark.createDataFrame([(5,), (5,), (None,), (7,)], "k long")
    got = migrate.without_orphans(df, "q", known, "k")
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, None), (4, 7)]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_write_stages_few_files_and_moves_them(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.create(spark.range(4000).selectExpr("id as k", "id as v"), path, ["k"], 8)
    new = spark.range(2000, 6000, 1, 12).selectExpr("id as k", "-id as v")
    assert len(layout.stage(spark, path, new, tables.upsert)) == 8
    staged = {p.parent.name + "/" + p.name for p in (tmp_path / "t" / "_staged").rglob("*.parquet")}
    assert len(staged) == 8
    # a run that ended after it had put one folder in place
    one = next(p for p in (tmp_path / "t" / "_staged").iterdir() if p.name.startswith("_part="))
    shutil.rmtree(tmp_path / "t" / one.name)
    shutil.move(one, tmp_path / "t" / one.name)
    assert layout.finish(spark, path) and not layout.finish(spark, path)
    assert {p.parent.name + "/" + p.name for p in (tmp_path / "t").glob("_part=*/*.parquet")} == staged
    assert sorted(map(tuple, layout.read(spark, path).collect())) == [(i, i if i < 2000 else -i) for i in range(6000)]


def test_upsert_makes_new_keys_one_each_once(spark, tmp_path):
    for name, rows in (("old", [(1, 1), (1, 2), (2, 3), (None, 4)]), ("new", [(1, 7), (1, 9), (3, 8), (None, 5), (None, 6)])):
        spark.createDataFrame(rows, "k long, v long").write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / x)) for x in ("old", "new"))
    got = tables.upsert(old, new, ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, 3), (None, 4), (1, 9), (3, 8), (None, 5), (None, 6)], key=str)
    # one union of the whole keys' rows, the null keys' and what stays of the old
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_parts_of_the_token_store_follow_the_bytes_of_text(spark):
    from quillon.llm import token_store
    from quillon.llm.queries import tokenizer_path

    assert [token_store.parts_of(n << 20, 6) for n in (0, 1, 9, 100, 512, 30 << 10)] == [1, 1, 3, 6, 16, 960]
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(50)], "doc_id long, text string")
    blocks = token_store.write_store(docs, tokenizer_path("word_bpe_49k.json"))
    assert blocks.select("part").distinct().count() == 1 and token_store.read_store(blocks).count() == 50


def test_each_word_of_a_batch_is_looked_up_once(monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    from quillon.llm import token_store
    from quillon.llm.queries import tokenizer_path

    path, asked = tokenizer_path("word_bpe_49k.json"), []

    class Counted(token_store._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setitem(token_store._TOKENIZERS, path, Counted(path))
    monkeypatch.setattr(token_store, "MOST_CACHED", 3)
    whole = Tokenizer.from_file(path)
    texts = ["Ring rod, RING. rod", "", "rod\xa0ring É. É's, 'tis x1 .,", "Ω ring", "a<|endoftext|>b", " ring\n"] * 200
    got = token_store.token_ids(texts, path)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # the parts of the different words, and the cuts of those that have several
    assert len(asked) <= 30
    # what was forgotten comes from the words of before, not from the model
    w = token_store._words(path)
    w.clear()
    w.before = {"ring": b"ab"}
    assert w["ring"] == b"ab" and len(w) == 1
