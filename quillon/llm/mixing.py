"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality`` with ``u`` from the MD5 of its id, so reruns agree and
better documents tend to come first. A source's target is ``share`` of all words split by the source weights; targets
stop at ``most`` times the source's size and the excess goes to the others by weight. Complete epochs come first; what
is left of the target is filled by documents in key order while at least half of a document still fits.

A source is never ordered in one task. The logarithm of a key is a Gumbel variable shifted by the quality's, whose density is at most 1/e whatever
the qualities are: pieces of it of one width hold at most ``ROWS_PER_PIECE`` rows each on average.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of its own and comes last;
a null doc_id is hashed as such; repeated rows each count; an empty table gives an empty result. Columns of the table whose names begin
with ``_q_`` are not allowed in ``mix`` and ``stage``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed_prefix_sum, stash, text_or_empty, unit_hash, word_count

#: Rows of one source that are ordered in one task, at most, on average.
ROWS_PER_PIECE = 2_000
#: Sources whose targets are broadcast, a row each; with more they are joined by shuffle.
MOST_SOURCES = 100_000


def default_quality(text: Column) -> Column:
    """Share of letters and blanks, plus a floor: a cheap stand-in where no quality column is given."""
    n = F.length(text)
    return F.lit(0.05) + F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / n).otherwise(F.lit(0.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(_q_source, _q_n, _q_total) -> with _q_target, by filling all sources to one level of words per weight.

    Repeatedly resharing the excess by weight ends where every source has ``min(most * size, level * weight)``;
    sorted by ``most * size / weight`` the level follows from prefix sums. One row per source, so one task is enough.
    """
    named = Window.orderBy(F.col("_q_source").asc_nulls_last())
    s = sizes.withColumn("_q_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_q_cap", F.lit(float(most)) * F.col("_q_total")).withColumn("_q_ratio", F.col("_q_cap") / F.col("_q_w"))
    by = Window.orderBy("_q_ratio", F.col("_q_source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("_q_all", F.lit(float(share)) * F.sum("_q_total").over(every))
        .withColumn("_q_level", (F.col("_q_all") - F.coalesce(F.sum("_q_cap").over(before), F.lit(0.0))) / (F.sum("_q_w").over(every) - F.coalesce(F.sum("_q_w").over(before), F.lit(0.0))))
        .withColumn("_q_open", F.when(F.col("_q_level") < F.col("_q_ratio"), F.col("_q_level")))
    )
    # the first source in this order that its cap doesn't stop sets the level for all after it
    level = F.first("_q_open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("_q_target", F.least("_q_cap", F.coalesce(level * F.col("_q_w"), F.col("_q_cap")))).select("_q_source", "_q_n", "_q_total", "_q_target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, quality: Column | None = None) -> DataFrame:
    """``docs`` with _q_size, _q_source_size, _q_target and _q_copies (times the mix takes the document)."""
    if any(c.startswith("_q_") for c in docs.columns):
        raise ValueError("columns that begin with _q_ are this operator's own")
    d = _measured(docs, quality)
    narrow = stash(d.select("doc_id", "source", "_q_size", "_q_quality"), "sizes")
    return _taken(d, narrow, weights, share, most)


def _measured(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    text = text_or_empty()
    return docs.withColumn("_q_size", word_count(text)).withColumn("_q_quality", quality if quality is not None else default_quality(text))


def _taken(d: DataFrame, narrow: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``mix`` for rows that have _q_size and _q_quality; ``narrow`` is a written table of these with doc_id and source."""
    stats = narrow.groupBy(F.col("source").alias("_q_source")).agg(F.count(F.lit(1)).alias("_q_n"), F.sum("_q_size").alias("_q_total"))
    t = stash(targets(stats, weights, share, most), "targets")
    if t.count() <= MOST_SOURCES:
        t = F.broadcast(t)

    def aimed(d: DataFrame) -> DataFrame:
        d = d.join(t, d["source"].eqNullSafe(t["_q_source"])).withColumn("_q_key", -F.log(unit_hash(F.col("doc_id"))) / F.col("_q_quality"))
        return d.withColumns({"_q_named": F.coalesce("_q_source", F.lit("")), "_q_null": F.col("_q_source").isNull()})

    piece = F.floor(F.log("_q_key") * F.col("_q_n") / (ROWS_PER_PIECE * math.e))
    order = [F.col("_q_key"), F.col("doc_id").asc_nulls_first(), F.col("_q_size")]
    d = bucketed_prefix_sum(aimed(d), ["_q_named", "_q_null"], piece, order, "_q_size", "_q_before_words", aimed(narrow))
    epochs = F.when(F.col("_q_total") > 0, F.floor(F.col("_q_target") / F.col("_q_total"))).otherwise(F.lit(0))
    left = F.col("_q_target") - epochs * F.col("_q_total")
    extra = (F.col("_q_before_words") + F.col("_q_size") / 2 <= left) & (epochs < most)
    return (
        d.withColumn("_q_copies", F.when(F.col("_q_size") > 0, epochs + extra.cast("int")).otherwise(0).cast("long"))
        .withColumnRenamed("_q_total", "_q_source_size")
        .drop("_q_source", "_q_named", "_q_null", "_q_n", "_q_quality", "_q_key", "_q_before_words")
    )


def digest(docs: DataFrame) -> DataFrame:
    """What the mix takes of each row; the text is read once, for its size and quality."""
    narrow = stash(_measured(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    m = _taken(narrow, narrow)
    return m.select("doc_id", F.col("_q_size").alias("size"), F.col("_q_source_size").alias("source_size"), F.col("_q_target").alias("target"), (F.col("_q_size") * F.col("_q_copies")).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns as they came."""
    names = docs.columns
    m = mix(docs)
    return m.where("_q_copies > 0").withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
with d as (select doc_id, source, coalesce(text,'') as t from documents),
s as (select doc_id, source, cast(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
  0.05 + case when length(t) > 0 then length(regexp_replace(t, '[^\\p{L} ]', '', 'g')) / length(t) else 0.0 end as q,
  -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar),'~')),1,8) as bigint) + 1)::double / 4294967297.0) as e from d),
g as (select source, cast(sum(size) as bigint) as total, row_number() over (order by source nulls last) as i from s group by source),
c as (select *, 2.0 * total as cap, case (i - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end as w from g),
l as (select *, cap / w as r, 1.5 * sum(total) over () as goal,
  coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
  sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as wleft from c),
v as (select min_by((goal - capped) / wleft, (r, source)) as level from l where (goal - capped) / wleft < r),
t as (select source, total, cast(least(cap, coalesce(level * w, cap)) as double) as target from l, v),
o as (select s.*, t.total, t.target, case when t.total > 0 then floor(t.target / t.total) else 0 end as epochs,
  coalesce(sum(size) over (partition by s.source order by e / q, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before
  from s join t on s.source is not distinct from t.source)
select doc_id, size, total as source_size, target,
  cast(size * (epochs + case when before + size / 2.0 <= target - epochs * total and epochs < 2 then 1 else 0 end) as bigint) as taken from o
"""
