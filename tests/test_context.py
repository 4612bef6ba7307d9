"""Context, depth, plan and graph with points that nobody assessed, cycles and points without prerequisites."""

from quillon.operators import context


def test_context(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 4), (5, 6)], "src long, dst long")
    asks = spark.createDataFrame([(7, 1), (7, 1), (7, 9), (8, 2), (8, 5)], "email long, kp long")
    mastery = spark.createDataFrame([(7, 2, 0.2), (7, 3, 0.5), (8, 3, 0.9), (8, 4, 0.59), (9, 6, 0.1)], "email long, kp long, score double")
    c = context.assembled(asks, edges, mastery)
    # 1 -> 2 -> 3 and 4; a cycle of two hops from 2 leads by 3 to 1
    assert sorted((tuple(x) for x in c.collect()), key=str) == sorted([(7, 1, 2, 1, 0.2, True), (7, 1, 3, 2, 0.5, True), (7, 1, 4, 2, None, False), (8, 2, 3, 1, 0.9, False), (8, 2, 4, 1, 0.59, True), (8, 2, 1, 2, None, False), (8, 5, 6, 1, None, False)], key=str)
    assert sorted(tuple(x) for x in context.depth(asks, c).collect()) == [(7, 1, "review_only", False), (7, 9, "full_solution", True), (8, 2, "guided_review", False), (8, 5, "full_solution", True)]
    assert sorted(tuple(x) for x in context.path_plan(asks, c).collect()) == [(7, 1, 1, "review", 2), (7, 1, 2, "review", 3), (7, 1, 3, "solve", 1), (7, 9, 1, "solve", 9), (8, 2, 1, "review", 4), (8, 2, 2, "solve", 2), (8, 5, 1, "solve", 5)]
    cycle = context.prerequisites(spark.createDataFrame([(1,)], "kp long"), spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "src long, dst long"))
    assert sorted(tuple(x) for x in cycle.collect()) == [(1, 1, 1), (1, 2, 1)]
    assert context.assembled(asks.where("false"), edges, mastery).count() == 0


def test_graph(spark):
    points = spark.createDataFrame([(1, "a", "s", 2), (2, "", None, 0), (None, "x", "y", 1)], "id long, name string, subject string, difficulty int")
    mastery = spark.createDataFrame([(7, 1, 0.8), (8, 2, 0.1), (9, 1, 0.1)], "email int, kp long, score double")
    shown = context.nodes(points, mastery, (7, 8))
    assert sorted((tuple(x) for x in shown.collect()), key=str) == [(7, 1, "a", "s", 2, 0.8), (7, 2, "2", "unknown", 3, None), (8, 1, "a", "s", 2, None), (8, 2, "2", "unknown", 3, 0.1)]
    edges = context.shown_edges(points, spark.createDataFrame([(1, 2), (2, 1), (1, 3), (None, 1)], "src long, dst long"))
    assert sorted(tuple(x) for x in edges.collect()) == [(1, 2), (2, 1)]
    assert sorted(tuple(x) for x in context.graph_stats(shown, edges).collect()) == [(7, 2, 2, 1, 0), (8, 2, 2, 0, 1)]
