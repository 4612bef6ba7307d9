"""Keyed writes as DataFrame operators: each returns the new state of a table, which ``save`` writes as its next version.

Parquet can't change rows in place, so a write never touches the version it reads and a run can be repeated. Keys that are null match nothing: such
rows are always added and never replaced or deleted. Of new rows with the same key, upsert, upsert_keep, update and insert_ignore take one, the largest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(state: DataFrame, path: str) -> DataFrame:
    """The state as written to a new folder."""
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def _one_each(new: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key; rows whose key has a null all stay."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in new.columns if c not in key]
    if not rest:
        return new.where(whole).distinct().unionByName(new.where(~whole))
    one = new.where(whole).groupBy(*key).agg(F.max(F.struct(*rest)).alias("_x")).select(*key, "_x.*").select(*new.columns)
    return one.unionByName(new.where(~whole))


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    # which rows go depends on all new keys, so these needn't be one each
    return _one_each(new.select(*old.columns), key).unionByName(old.join(new.select(*key), key, "left_anti").select(*old.columns))


def upsert_keep(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """As upsert, but a null in a new row keeps the old value."""
    o, n = old.alias("o"), _one_each(new.select(*old.columns), key).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Only new keys are added, one row each."""
    return old.unionByName(_one_each(new.select(*old.columns), key).join(old.select(*key), key, "left_anti").select(*old.columns))


def replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows of a key that new rows have go."""
    return insert(old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns), new)


def update(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Columns of ``changes`` replace those of the rows that have its key, where not null."""
    extra = {c: f"_new_{c}" for c in changes.columns if c not in key}
    c = _one_each(changes, key).select(*key, *[F.col(a).alias(b) for a, b in extra.items()])
    return old.join(c, key, "left").select(*[F.coalesce(extra[x], x).alias(x) if x in extra else F.col(x) for x in old.columns])


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key), key, "left_anti").select(*old.columns)


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule (name -> SQL condition), with the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("violations", broken).where(F.size("violations") > 0)
