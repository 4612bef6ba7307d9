"""Keyed writes that rewrite only the partitions of the keys they change.

A table is a folder dealt by a hash of its key into ``parts`` partitions; choose as many as give partitions of the size wanted. A write

1. writes the changes once, so that nothing is computed twice with two results,
2. reads the partitions of their keys (the scan prunes all others) and applies an operator of ``tables`` to them,
3. stages the whole new content of these partitions in the folder ``_staged``,
4. puts the staged folders in place of the old ones, one after the other, and removes ``_staged``.

A run broken before ``_staged`` is complete changes nothing; one broken later is ended by the next ``write`` or ``finish``, which goes on with the folders that
are still staged. So upsert, upsert_keep, update, delete, replace and insert_ignore can be repeated; insert adds its rows again.
One writer at a time; readers see whole partitions of before or after, and all of the write once it returns.

Defined cases: rows whose key has a null match nothing and lie by the hash of the whole row, so they don't pile up in one partition; a partition whose last
row goes keeps a row that isn't live, as the overwrite leaves partitions alone that get no rows; no changes rewrite nothing; tables with columns named
``_part`` or ``_live`` raise ValueError. Large partitions are several files: Spark rebalances them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART, LIVE = "_part", "_live"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def part_of(columns: list[str], key: list[str], parts: int) -> Column:
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return F.pmod(F.when(whole, F.xxhash64(*key)).otherwise(F.xxhash64(*columns)), F.lit(parts)).cast("int")


def create(df: DataFrame, path: str, key: list[str], parts: int) -> None:
    """Write a table for the first time."""
    if {PART, LIVE} & set(df.columns):
        raise ValueError(f"columns {PART} and {LIVE} are the layout's own")
    d = df.withColumns({LIVE: F.lit(True), PART: part_of(df.columns, key, parts)})
    d.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(path)
    df.sparkSession.createDataFrame([(parts, key, df.schema.json())], "parts int, key array<string>, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")


def _layout(spark: SparkSession, path: str) -> tuple[int, list[str], StructType]:
    parts, key, schema = spark.read.schema("parts int, key array<string>, schema string").parquet(f"{path}/_layout").first()
    return parts, list(key), StructType.fromJson(json.loads(schema))


def _all(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType(list(schema)).add(LIVE, "boolean").add(PART, "integer")).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    _, _, schema = _layout(spark, path)
    return _all(spark, path, schema).where(LIVE).drop(LIVE, PART)


def finish(spark: SparkSession, path: str) -> bool:
    """Put a complete staged write in place; whether there was one."""
    staged = f"{path}/_staged"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        return False
    fs, folder = _fs(spark, staged)
    # at most ``parts`` folders
    for x in fs.listStatus(folder):
        name = x.getPath().getName()
        if name.startswith(f"{PART}="):
            _remove(spark, f"{path}/{name}")
            if not fs.rename(x.getPath(), _fs(spark, f"{path}/{name}")[1]):
                raise OSError(f"{name} can't be put in place")
    _remove(spark, staged)
    return True


def stage(spark: SparkSession, path: str, changes: DataFrame, operator: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
    """Write the new content of the partitions that ``changes`` touch, and return these; ``finish`` puts it in place."""
    parts, key, schema = _layout(spark, path)
    columns = schema.fieldNames()
    kept = f"{path}/_changes"
    changes.write.mode("overwrite").parquet(kept)
    mine = [c for c in columns if c in changes.columns]
    # in the table's types, as a key's hash depends on its type
    new = spark.read.schema(changes.schema).parquet(kept).select(*[F.col(c).cast(schema[c].dataType) for c in mine])
    # a set of at most ``parts`` numbers
    touched = sorted(x[0] for x in new.select(part_of(mine, key, parts).alias(PART)).distinct().collect())
    if touched:
        old = _all(spark, path, schema).where(F.col(PART).isin(touched) & F.col(LIVE)).drop(LIVE, PART)
        after = operator(old, new, key).select(*columns).withColumns({LIVE: F.lit(True), PART: part_of(columns, key, parts)})
        gone = spark.createDataFrame([(x,) for x in touched], f"{PART} int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(False).alias(LIVE), PART)
        after.unionByName(gone).hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/_staged")
    return touched


def write(spark: SparkSession, path: str, changes: DataFrame, operator: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
    """Apply an operator of ``tables`` by the layout's key; the numbers of the partitions that were rewritten."""
    finish(spark, path)
    touched = stage(spark, path, changes, operator)
    finish(spark, path)
    return touched
