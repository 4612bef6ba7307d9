"""As-of join: to each row the last earlier row of the same key, without a key's rows in one task.

Both sides are one stream of rows in time. Inside a slice of time of a key the last value so far is a window; what stood before a slice is one row for each key and slice, and carried
on by a second window over these. A key with half of all rows is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: dict[str, str], seconds: int = 86_400, tie: list[str] | None = None) -> DataFrame:
    """``left`` with ``values`` (right's column -> new name) of the right row of the same key with the greatest ``at`` not after its own; of several at the same time, the one with the
    greatest ``tie`` (else the greatest values). ``at`` is a timestamp, slices are ``seconds`` long. Rows of the left side with a null key or time, or nothing before, get nulls; right rows
    with such are left out. Repeated rows stay. Names beginning with _q_ are this operator's own."""
    if any(c.startswith("_q_") for c in left.columns + right.columns) or set(values.values()) & set(left.columns):
        raise ValueError("columns that begin with _q_, or have a new name already")
    part = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    held = F.struct(*[F.col(c).alias(new) for c, new in values.items()])
    r = right.dropna(subset=[*keys, at]).select(*keys, F.col(at), part.alias("_q_part"), F.struct(*(tie or []), *values).alias("_q_tie"), held.alias("_q_held"))
    mine = left.withColumns({"_q_part": part, "_q_kind": F.lit(1)})
    rows = mine.unionByName(r.withColumn("_q_kind", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_q_part").orderBy(at, "_q_kind", "_q_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_q_in", F.last("_q_held", ignorenulls=True).over(inside)).where("_q_kind = 1")
    # a row for each key and slice that either side has; the last value of the slices before
    last = r.groupBy(*keys, "_q_part").agg(F.max_by("_q_held", F.struct(at, "_q_tie")).alias("_q_last"))
    parts = mine.dropna(subset=[*keys, at]).select(*keys, "_q_part").distinct().join(last, [*keys, "_q_part"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_q_before", F.last("_q_last", ignorenulls=True).over(before)).where("_q_before is not null").select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("_q_part").alias("_q_slice"), "_q_before")
    out = found.join(carried, [F.col(k) == F.col(f"_q_{k}") for k in keys] + [F.col("_q_part") == F.col("_q_slice")], "left").withColumn("_q_value", F.coalesce("_q_in", "_q_before"))
    sound = F.col(at).isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    return out.select(*left.columns, *[F.when(sound, F.col("_q_value")[new]).alias(new) for new in values.values()])
