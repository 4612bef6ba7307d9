"""Line dedup by winnowing over line hashes.

Every document is the sequence of its non-blank lines (blanks at both ends of a line are ignored). A run of consecutive lines is a repeat if the same
lines stand in a row earlier (by doc_id, nulls first, then position) and there are ``run`` of them or they have ``words`` words together: so one line of ``words``
words counts by itself. A line goes exactly if it lies in a repeat.

1. Fingerprints: in each window of ``run`` lines the position of the smallest line hash (the rightmost, where it repeats), and every line of half of ``words``
   words. Every repeat, and its earlier copy, has one at the same place of it. Positions whose fingerprint occurs once are done with.
2. From each other position the match is extended both ways as far as a shortest repeat reaches: over ``run`` lines in all ways that hold the position, and
   over fewer where these have ``words`` words. Positions are not extended in pairs, as a common line would make all pairs of its places: those whose extended
   lines agree meet by a hash of these (128 bits), whose first place is found by pre-aggregated minima.
3. What isn't first is a repeat. Overlapping repeats are one longer run, and the later run is deleted.

Fingerprints and extensions that hold a large share of all rows are joined by broadcast: there are at most ``common.HOT`` of them. The others are few each.

Defined cases: null text stays null; blank lines stay where they are; repeated rows (same doc_id and text) count as one document and share its result;
other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import WORD, join_counted, release, stash, text_or_empty, unstash

RUN, WORDS = 3, 50


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_removed", IntegerType())]))
def _without(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """Text without the lines of runs, each the index of its first non-blank line times 8 plus its length."""
    out, gone = [], []
    for t, found in zip(text, runs):
        if t is None or found is None or not len(found):
            out.append(t)
            gone.append(0)
            continue
        lines = t.split("\n")
        solid = np.array([i for i, x in enumerate(lines) if x.strip(" ")])
        edge = np.zeros(len(solid) + 1, np.int64)
        np.add.at(edge, np.asarray(found) >> 3, 1)
        np.add.at(edge, (np.asarray(found) >> 3) + (np.asarray(found) & 7), -1)
        drop = set(solid[np.cumsum(edge[:-1]) > 0].tolist())
        out.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
        gone.append(len(drop))
    release()
    return pd.DataFrame({"text": out, "n_removed": gone})


def fingerprints(docs: DataFrame, run: int, words: int) -> DataFrame:
    """(_q_id, _q_h, f, ext): a row for each selected position with its line's hash and its extensions: where each starts and how long it is, and two hashes."""
    if not 1 <= run <= 7:
        raise ValueError("run is from 1 to 7")
    text = text_or_empty()
    lines = F.expr("filter(transform(split(text, '\\n', -1), l -> trim(l)), l -> l <> '')")
    d = docs.select(F.col("doc_id").alias("_q_id"), F.xxhash64(text).alias("_q_h"), text.alias("text")).withColumn("l", lines).where("size(l) > 0")
    d = d.select("_q_id", "_q_h", F.transform("l", lambda x: F.xxhash64(x)).alias("a"), F.transform("l", lambda x: F.xxhash64(F.lit(7), x)).alias("b"), F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD))).alias("n"))
    # the rightmost smallest of each window
    least = "s"
    for i in range(1, run):
        least = f"if(get(a, s + {i}) <= get(a, {least}), s + {i}, {least})"
    minima = F.expr(f"if(size(a) >= {run}, transform(sequence(0, size(a) - {run}), s -> {least}), array())")
    long = F.expr(f"filter(sequence(0, size(a) - 1), i -> 2 * get(n, i) >= {words})")
    d = d.withColumn("p", F.explode(F.array_distinct(F.concat(minima, long))))

    def item(start: str, size: int) -> str:
        hashes = [f"xxhash64({size}, " + ", ".join(f"get({x}, {start} + {i})" for i in range(size)) + ")" for x in "ab"]
        return f"named_struct('at', cast(({start}) * 8 + {size} as int), 'k', {hashes[0]}, 'm', {hashes[1]})"

    ways = []
    for size in range(1, run + 1):
        for back in range(size):
            start = f"p - {back}"
            enough = "true" if size == run else " + ".join(f"get(n, {start} + {i})" for i in range(size)) + f" >= {words}"
            ways.append(f"if({start} >= 0 and {start} + {size} <= size(a) and {enough}, {item(start, size)}, null)")
    return d.select("_q_id", "_q_h", F.expr("get(a, p)").alias("f"), F.expr(f"filter(array({', '.join(ways)}), x -> x is not null)").alias("ext")).where("size(ext) > 0")


def repeats(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(_q_id, _q_h, _q_runs): per document its repeats."""
    marks = stash(fingerprints(docs, run, words), "fingerprints")
    shared = stash(marks.groupBy(F.col("f").alias("_q_f")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    near = join_counted(marks, shared, {"f": "_q_f"}, "n").select("_q_id", "_q_h", F.explode("ext").alias("x")).select("_q_id", "_q_h", "x.at", "x.k", "x.m")

    def here(at: Column) -> Column:
        return F.struct(F.col("_q_id").isNotNull().alias("a"), F.col("_q_id").alias("b"), F.col("_q_h").alias("c"), at.alias("d"))

    # two positions of one run may have the same extension, so places are counted, not rows
    first = near.groupBy(F.col("k").alias("_q_k"), F.col("m").alias("_q_m")).agg(F.min(here(F.col("at"))).alias("first"), F.max(here(F.col("at"))).alias("last"), F.count(F.lit(1)).alias("n"))
    first = stash(first.where("first <> last").drop("last"), "first")
    later = join_counted(near, first, {"k": "_q_k", "m": "_q_m"}, "n").where(here(F.col("at")) > F.col("first"))
    found = stash(later.groupBy("_q_id", "_q_h").agg(F.collect_set("at").alias("_q_runs")), "repeats")
    for x in (marks, shared, first):
        unstash(x)
    return found


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeats cut from text, and _q_removed lines."""
    gone = repeats(docs, run, words)
    d = docs.withColumn("_q_h0", F.xxhash64(text_or_empty()))
    d = d.join(gone.hint("merge"), d["doc_id"].eqNullSafe(gone["_q_id"]) & (d["_q_h0"] == gone["_q_h"]), "left")
    d = d.withColumn("_q_out", _without("text", "_q_runs"))
    return d.withColumn("text", F.col("_q_out.text")).withColumn("_q_removed", F.col("_q_out.n_removed")).drop("_q_h0", "_q_id", "_q_h", "_q_runs", "_q_out")


def digest(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    d = docs.select("doc_id", "text", F.size(F.expr("filter(split(coalesce(text, ''), '\\n', -1), l -> trim(l) <> '')")).cast("long").alias("_q_n"))
    out = dedup(d, run, words)
    return out.select("doc_id", F.col("_q_n").alias("n_lines"), F.col("_q_removed").cast("long").alias("n_removed"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


def stage(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Documents without repeats; one that had lines and lost them all is dropped."""
    names = docs.columns
    out = dedup(docs, run, words).where((F.col("_q_removed") == 0) | F.col("text").rlike(r"[^\n ]"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_q_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in names])


ORACLE = r"""
with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) as line, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) as pos from documents),
b as (select doc_id, pos, trim(line, ' ') as x, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n, row_number() over (partition by doc_id order by pos) as i from l where trim(line, ' ') <> ''),
w as (select doc_id, i, x, lead(x, 1) over d as y, lead(x, 2) over d as z, n, n + lead(n, 1) over d as n2 from b window d as (partition by doc_id order by i)),
f as (select doc_id, i, 3 as size, row_number() over (partition by x, y, z order by doc_id, i) as k from w where z is not null
  union all select doc_id, i, 2, row_number() over (partition by x, y order by doc_id, i) from w where n2 >= 50
  union all select doc_id, i, 1, row_number() over (partition by x order by doc_id, i) from w where n >= 50),
g as (select distinct doc_id, i + o as i from f, (values (0), (1), (2)) v(o) where k > 1 and o < size),
r as (select b.doc_id, b.pos from b join g using (doc_id, i))
select l.doc_id, count(*) filter (where trim(line, ' ') <> '') as n_lines, count(r.pos) as n_removed,
  sha256(coalesce(string_agg(case when r.pos is null then line end, chr(10) order by l.pos), '')) as kept_sha256
from l left join r on l.doc_id = r.doc_id and l.pos = r.pos group by l.doc_id
"""
