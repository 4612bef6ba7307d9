"""What a tutor knows of a question: prerequisites over two hops, the learner's mastery of them, how deep the answer goes, and the graph with mastery.

Prerequisites are a matter of points, so they are expanded once for each distinct point that is asked about, duplicates go before the second hop, and the smallest hop is an aggregate; learners
meet them afterwards. Points that a learner was never assessed in stay, with a null score, and aren't weak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEAK, VERY_WEAK = 0.6, 0.3


def prerequisites(points: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """points(kp), edges(src, dst) -> (kp, prerequisite, hop): what each point depends on within ``hops`` steps, by the fewest; the point itself where a cycle leads back."""
    e = edges.select("src", "dst").distinct()
    front = points.select("kp").where("kp is not null").distinct().join(e, F.col("kp") == F.col("src")).select("kp", F.col("dst").alias("prerequisite"))
    every = front.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        front = front.join(e, F.col("prerequisite") == F.col("src")).select("kp", F.col("dst").alias("prerequisite")).distinct()
        every = every.union(front.withColumn("hop", F.lit(hop)))
    return every.groupBy("kp", "prerequisite").agg(F.min("hop").alias("hop"))


def assembled(asks: DataFrame, edges: DataFrame, mastery: DataFrame) -> DataFrame:
    """asks(email, kp), mastery(email, kp, score) -> (email, kp, prerequisite, hop, score, is_weak): a row for each prerequisite of what a learner asks about."""
    pairs = asks.select("email", "kp").distinct().join(prerequisites(asks, edges), "kp")
    known = mastery.select("email", F.col("kp").alias("prerequisite"), "score")
    out = pairs.join(known, ["email", "prerequisite"], "left")
    return out.select("email", "kp", "prerequisite", "hop", "score", F.coalesce(F.col("score") < WEAK, F.lit(False)).alias("is_weak"))


def depth(asks: DataFrame, context: DataFrame) -> DataFrame:
    """(email, kp, depth, skip_allowed) of every ask, those without prerequisites too."""
    least = context.where("is_weak").groupBy("email", "kp").agg(F.min("score").alias("least"))
    level = F.when(F.col("least") < VERY_WEAK, "review_only").when(F.col("least").isNotNull(), "guided_review").otherwise("full_solution")
    return asks.select("email", "kp").distinct().join(least, ["email", "kp"], "left").select("email", "kp", level.alias("depth"), F.col("least").isNull().alias("skip_allowed"))


def path_plan(asks: DataFrame, context: DataFrame) -> DataFrame:
    """(email, kp, step, kind, target): weak prerequisites, weakest first, then the point itself."""
    weak = context.where("is_weak").groupBy("email", "kp").agg(F.array_sort(F.collect_list(F.struct("score", "prerequisite"))).alias("w"))  # of one point
    d = asks.select("email", "kp").distinct().join(weak, ["email", "kp"], "left")
    review = F.transform(F.coalesce("w", F.expr("cast(array() as array<struct<score: double, prerequisite: bigint>>)")), lambda x: F.struct(F.lit("review").alias("kind"), x["prerequisite"].cast("long").alias("target")))
    steps = F.concat(review, F.array(F.struct(F.lit("solve").alias("kind"), F.col("kp").cast("long").alias("target"))))
    return d.select("email", "kp", F.posexplode(steps).alias("i", "x")).select("email", "kp", (F.col("i") + 1).cast("long").alias("step"), "x.kind", "x.target")


def nodes(points: DataFrame, mastery: DataFrame, learners: tuple) -> DataFrame:
    """points(id, name, subject, difficulty) -> (email, id, name, subject, difficulty, mastery) of every point for each of ``learners``; names and subjects have defaults."""
    or_else = lambda c, x: F.coalesce(F.nullif(F.col(c), F.lit("")), x).alias(c)
    d = points.where("id is not null").select(F.explode(F.array(*[F.lit(x) for x in learners])).alias("email"), "id", or_else("name", F.col("id").cast("string")), or_else("subject", F.lit("unknown")), F.coalesce(F.nullif("difficulty", F.lit(0)), F.lit(3)).alias("difficulty"))
    known = mastery.where(F.col("email").isin(*learners)).select("email", F.col("kp").alias("id"), F.col("score").alias("mastery"))
    return d.join(known, ["email", "id"], "left").select("email", "id", "name", "subject", "difficulty", "mastery")


def shown_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are points."""
    ids = points.select("id").where("id is not null").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def held_edges(mastery: DataFrame, edges: DataFrame) -> DataFrame:
    """mastery(email, kp), edges(src, dst) -> (email, src, dst): edges of which a learner has both ends."""
    m = mastery.select("email", "kp")
    return m.withColumnRenamed("kp", "src").join(edges, "src").join(m.withColumnRenamed("kp", "dst"), ["email", "dst"], "left_semi").select("email", "src", "dst")


def graph_stats(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """(email, total_nodes, total_edges, mastered, weak) of ``nodes`` and ``shown_edges``."""
    total = edges.agg(F.count(F.lit(1)).alias("total_edges"))  # one row
    n = shown.groupBy("email").agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("mastery") >= 0.7).alias("mastered"), F.count_if(F.col("mastery") < 0.4).alias("weak"))
    return n.join(F.broadcast(total)).select("email", "total_nodes", "total_edges", "mastered", "weak")
