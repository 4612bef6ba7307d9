"""Filters, pages and sorts whose parts are parameters; a part that isn't given isn't in the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(x: float, lo: float, hi: float) -> float:
    return min(max(x, lo), hi)


def matching(df: DataFrame, equals: dict[str, object]) -> DataFrame:
    """Rows equal in every column whose value is given (None and empty text: any)."""
    given = [F.col(c) == x for c, x in equals.items() if x is not None and x != ""]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def between(df: DataFrame, column: str, least: object = None, most: object = None) -> DataFrame:
    d = df if least is None else df.where(F.col(column) >= least)
    return d if most is None else d.where(F.col(column) <= most)


def any_of(df: DataFrame, column: str, values: tuple | None) -> DataFrame:
    """Rows with one of the values; without values all rows."""
    return df.where(F.col(column).isin(*values)) if values else df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of at most 100 rows; ``order`` must end in a key."""
    size = int(clamp(size, 1, 100))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_meta(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: page, page_size, total, pages, has_next, has_prev."""
    t = df.agg(F.count(F.lit(1)).alias("total"))
    return t.select(F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total", F.ceil(F.col("total") / size).alias("pages"), (F.col("total") > number * size).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def sorted_by(df: DataFrame, column: str, allowed: list[str], descending: bool, limit: int, most: int, key: list[str]) -> DataFrame:
    """The first rows by an allowed column (the first allowed one in place of any other), ties by ``key``; 1 to ``most`` rows."""
    c = F.col(column if column in allowed else allowed[0])
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *key).limit(int(clamp(limit, 1, most)))


def numbered(df: DataFrame, order: list[str], name: str, path: str) -> DataFrame:
    """``df`` with the position (from 0) of each row in an order that ends in a key.

    Rows are cut into ranges of the order and numbered inside them; a range's offset is a sum over ranges, of which there are as many as
    partitions. Ranges are cut at a sample, so the cut rows are written to ``path`` once and read from there."""
    spark = df.sparkSession
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    d.select("*", F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id").write.parquet(path)
    d = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(group, lo, hi, and by name the value at rank ceil(share * n)) of whole numbers, exactly.

    Values are counted by bucket first, at most ``buckets`` a group; only the buckets that hold a wanted rank are counted by value, so no task
    orders a group."""
    d = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    ends = d.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumn("width", F.floor((F.col("hi") - F.col("lo")) / buckets) + 1)
    on = F.col("g").eqNullSafe(F.col(group))
    d = d.join(F.broadcast(ends.withColumnRenamed(group, "g")), on).drop("g")  # a row for each group
    d = d.withColumn("b", F.floor((F.col("v") - F.col("lo")) / F.col("width")))
    ordered = lambda by: Window.partitionBy(group).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = d.groupBy(group, "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).withColumn("upto", F.sum("c").over(ordered(["b"])))
    ranks = {k: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) for k, p in shares.items()}
    holds = reduce(lambda x, y: x | y, [(F.col("upto") >= r) & (F.col("upto") - F.col("c") < r) for r in ranks.values()])
    some = b.where(holds).select(F.col(group).alias("g"), F.col("b").alias("bb"), (F.col("upto") - F.col("c")).alias("before"))
    v = d.join(F.broadcast(some), on & (F.col("b") == F.col("bb"))).groupBy(group, "b", "v").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("before").alias("before"))
    inside = Window.partitionBy(group, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("upto", F.col("before") + F.sum("c").over(inside))
    found = v.groupBy(group).agg(*[F.min(F.when(F.col("upto") >= r, F.col("v"))).alias(k) for k, r in ranks.items()])
    e = ends.select(F.col(group).alias("g"), "lo", "hi")
    return found.join(F.broadcast(e), on).select(group, "lo", "hi", *shares)
