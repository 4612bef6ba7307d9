import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.operators import graph_index


def brute(ids, x, asked, k, ok=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        if ok is not None:
            s[~ok] = -np.inf
        out[int(ids[i])] = set(ids[np.argsort(-s, kind="stable")[:k]].tolist())
    return out


def recall(rows, want, k):
    got = {}
    for r in rows:
        if r.rank <= k:
            got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(want)
    return sum(len(got[i] & w) for i, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("name, ok", [("top_vector_graph", None), ("dom_vec_search_graph", lambda ids: 1 + ids % 5 <= 4)])
def test_recall_of_the_registered_queries(spark, name, ok):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), np.float64)
    rows = registry.queries()[name](spark, "/root/testdata/sf0.1").collect()
    for k in (5, 10):
        assert recall(rows, brute(ids, x, np.flatnonzero(ids % 50 == 0), k, None if ok is None else ok(ids)), k) >= 0.9


def test_recall_on_clusters_and_rare_rows(spark):
    """Several parts; tight clusters far from each other; a predicate that holds far from where the query lies, one that holds rarely, and one for nothing."""
    r = np.random.default_rng(5)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 6000)] + 0.05 * r.normal(size=(6000, 16))).astype(np.float32)
    ids = np.arange(6000)
    d = spark.createDataFrame([(int(i), [float(a) for a in v], int(c)) for i, v, c in zip(ids, x, np.argmax(x, axis=1))], "id long, v array<float>, kind int")
    index = graph_index.build(d, 2500).cache()
    assert index.select("part").distinct().count() == 3 and index.select("id").distinct().count() == 6000
    asked = np.flatnonzero(ids % 50 == 0)
    kind = np.argmax(x, axis=1)
    for where, ok in ((None, None), ("kind = 3", kind == 3), ("id % 400 = 7", ids % 400 == 7), ("id < 3", ids < 3)):
        got = graph_index.search(index, d.where("id % 50 = 0"), 10, where).collect()
        for k in (5, 10):
            want = brute(ids, x.astype(np.float64), asked, k, ok)
            if where == "id < 3":
                want = {i: w & {0, 1, 2} - {i} for i, w in want.items()}
            assert recall(got, want, k) >= 0.9, where
    assert graph_index.search(index, d.where("id % 50 = 0"), 10, "kind > 99 or cast(null as boolean)").count() == 0
    again = graph_index.build(d.repartition(7, "kind"), 2500)
    assert index.select("id", "part", "node").exceptAll(again.select("id", "part", "node")).isEmpty()
    index.unpersist()


def test_every_vector_can_be_reached():
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(size=(700, 8)), 1e-3 * r.normal(size=(700, 8)) + 5, np.eye(8)]).astype(np.float32)
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    links = graph_index.graph(x)
    assert links.shape == (len(x), 2 * graph_index.LINKS) and all(i not in row and len(set(row[row >= 0])) == (row >= 0).sum() for i, row in enumerate(links))
    seen = edge = set(graph_index.entries_of(links, len(x)).tolist())
    while edge:
        edge = {int(t) for i in edge for t in links[i] if t >= 0} - seen
        seen = seen | edge
    assert len(seen) == len(x)


def test_defined_cases(spark):
    kind = "id long, v array<double>"
    odd = [(None, [1.0, 0.0]), (90, None), (91, [0.0, 0.0]), (92, [1.0]), (93, [float("nan"), 1.0]), (94, [None, 1.0]), (95, [])]
    d = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(9)] + [(3, [1.0, 0.3]), (20, [1e200, 0.4e200])] + odd, kind)
    index = graph_index.build(d, 3)
    assert sorted(r.id for r in index.select("id").collect()) == [*range(9), 20]
    got = [(r.id, r.rank, r.neighbour) for r in graph_index.search(index, d.where("id in (4, 20, 90, 92)"), 3).orderBy("id", "rank").collect()]
    assert got == [(4, 1, 20), (4, 2, 5), (4, 3, 3), (20, 1, 4), (20, 2, 5), (20, 3, 3)]
    assert graph_index.search(graph_index.build(d.limit(0)), d, 3).count() == 0 and graph_index.search(index, d.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="Node"):
        graph_index.build(d.withColumn("Node", F.lit(1)))


def test_one_vector_and_one_id_with_a_third_of_all_rows(spark):
    """Equal vectors: the smallest ids; an id with many vectors counts once, and hides nobody."""
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(1000)] + [(5000, [1.0, 0.9, 0.0, float(a)]) for a in r.normal(size=1000) / 100] + [(i, r.normal(size=4).tolist()) for i in range(1000, 2000)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(4, F.rand(1))
    index = graph_index.build(d, 1000)
    parts = [r["count"] for r in index.groupBy("part").count().collect()]
    assert sum(parts) == 3000 and max(parts) < 1300
    got = graph_index.search(index, d.where("id in (0, 700)"), 4).orderBy("id", "rank").collect()
    assert [(r.id, r.neighbour, r.similarity) for r in got] == [(0, i, 1.0) for i in (1, 2, 3, 4)] + [(700, i, 1.0) for i in (0, 1, 2, 3)]
    got = graph_index.search(index, spark.createDataFrame([(5001, [1.0, 0.9, 0.0, 0.0])], "id long, v array<double>"), 4).orderBy("rank").collect()
    assert got[0].neighbour == 5000 and [r.neighbour for r in got[1:]] == [0, 1, 2]
