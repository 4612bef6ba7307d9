"""Which of many words each text holds, by an inverted index of grams: no bound on the number of words, no comparison of all texts with all words.

1. Every word is filed under one of its grams (three characters; the whole word where it is shorter): the one that the fewest texts hold. A word with a gram that no text holds
   is done with.
2. Texts are cut into their distinct grams, and those that some word is filed under meet its words. While the index is small (``MOST_INDEXED`` words, by a count) it is
   broadcast and texts stay where they are; else narrow rows of grams are shuffled, with the grams that most texts hold joined by broadcast of their own
   index, and texts meet their candidates afterwards.
3. Candidates are verified with ``contains``.

So the cost follows the texts' lengths and the hits of rare grams, not words times texts. Comparison is of characters as they are; fold case before.
Null and empty words match nothing, null and empty texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import tables

GRAM = 3
#: Indexed words that are broadcast.
MOST_INDEXED = 200_000
#: Of a gram that more texts hold than one in HOT of all rows, the rows aren't shuffled to one task; there are few such grams.
HOT = 1_000


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of the given sizes, in time that grows with the text's length: characters are taken apart once."""

    def of(c: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
        return F.when(F.size(c) >= n, cut).otherwise(F.array().cast("array<string>"))

    # an array of one binds the characters, so that they are not taken apart for each gram
    characters = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.transform(characters, lambda c: F.array_distinct(F.concat(*[of(c, n) for n in sizes])))[0]


def indexed(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, list[int]]:
    """texts(text), words(word) -> (gram, word): each word under the gram that the fewest texts hold, and the sizes of grams there are."""
    w = words.select("word").where("word <> ''").distinct()
    # at most GRAM rows
    sizes = sorted(r["n"] for r in w.select(F.least(F.length("word"), F.lit(GRAM)).alias("n")).distinct().collect())
    if not sizes:
        return w.select(F.col("word").alias("gram"), "word"), []
    held = texts.select(F.explode(_grams(F.col("text"), sizes)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.explode(F.when(F.length("word") < GRAM, F.array("word")).otherwise(_grams(F.col("word"), [GRAM])))
    each = w.select("word", own.alias("gram")).join(held, "gram", "left")
    best = each.groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return best.where("n > 0").select("gram", "word", "n"), sizes


def held_words(texts: DataFrame, words: DataFrame, shuffled: bool | None = None) -> DataFrame:
    """texts(text), words(word) -> (text, word): every distinct text with every distinct word that it contains. ``shuffled`` overrides the choice by count."""
    t = texts.select("text").where("text <> ''").distinct()
    index, sizes = indexed(t, words)
    if not sizes:
        return t.join(index.select("word"), F.col("text") == F.col("word")).select("text", "word").where("false")
    if shuffled is None:
        shuffled = index.limit(MOST_INDEXED + 1).count() > MOST_INDEXED
    grams = t.select("text", F.explode(_grams(F.col("text"), sizes)).alias("g"))
    if not shuffled:
        found = grams.join(F.broadcast(index), F.col("g") == F.col("gram"))
        return found.where(F.expr("contains(text, word)")).select("text", "word")
    narrow = grams.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("k"), "g")
    often = F.col("n") > F.lit(max(1, t.count() // HOT))
    # a text holds few grams that one in HOT of all texts holds and that are some word's rarest
    few = narrow.join(F.broadcast(index.where(often).limit(MOST_INDEXED)), F.col("g") == F.col("gram"))
    many = narrow.join(index.where(~often).hint("shuffle_hash"), F.col("g") == F.col("gram"))
    if index.where(often).count() > MOST_INDEXED:
        few, many = few.where("false"), narrow.join(index.hint("merge"), F.col("g") == F.col("gram"))
    met = few.union(many).select("h", "k", "word")
    keyed = t.select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("k"))
    return met.join(keyed.hint("merge"), ["h", "k"]).where(F.expr("contains(text, word)")).select("text", "word")


def matched(rows: DataFrame, fields: Column, keywords: DataFrame, of: str | None = None) -> DataFrame:
    """``rows`` with hits, the sorted keywords of keywords(keyword) that one of ``fields`` (lower-case texts) holds whatever its case; rows without any go.

    Where ``fields`` depends on one column alone (``of``), each of its values is taken apart once; a null has no fields. Values with the same fields are
    matched once. Both are written, as they are read several times."""
    spark, d, key = rows.sparkSession, rows, of
    if key is None:
        d, key, fields = rows.withColumn("_key", F.array_distinct(fields)), "_key", F.col("_key")
    # only what was written is filtered: a condition on the fields would be moved before ``distinct`` and take every row's value apart
    values = tables.save(d.select(key).distinct().withColumn("_fields", F.array_distinct(fields)), files.scratch(spark, "fields"))
    values = values.where(F.col(key).isNotNull() & (F.size("_fields") > 0))
    sets = tables.save(values.select("_fields").distinct(), files.scratch(spark, "field-sets"))
    each = sets.select("_fields", F.explode("_fields").alias("text"))
    words = keywords.select(F.lower("keyword").alias("word"), "keyword").distinct()
    found = each.join(held_words(each, words), "text").join(words, "word")
    hits = found.groupBy("_fields").agg(F.array_sort(F.collect_set("keyword")).alias("hits"))  # of one question: its keywords
    return d.join(values.join(hits, "_fields").select(key, "hits"), key).select(*rows.columns, "hits")


def mentions(rows: DataFrame, key: str, words: DataFrame, label: Column, own: Column, weight: str | None = None) -> DataFrame:
    """(key, n): how many distinct words(word) each row's ``label`` contains or contain its ``own`` text, or the sum of their ``weight``; rows without any go.

    Words are counted once for each pair of texts, and rows meet the counts: no pair of a row and a word is made. Rows with the same key are summed up."""
    d = rows.select(F.col(key), label.alias("_label"), own.alias("_own"))
    texts = d.select("_label", "_own").distinct()
    w = words.where("word is not null").groupBy("word").agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("_weight"))
    if not weight:
        w = w.withColumn("_weight", F.lit(1).cast("long"))
    down = texts.join(held_words(texts.select(F.col("_label").alias("text")), w), F.col("_label") == F.col("text")).select("_label", "_own", "word")
    up = held_words(w.select(F.col("word").alias("text")), texts.select(F.col("_own").alias("word"))).select(F.col("text").alias("_w"), F.col("word").alias("_o"))
    both = down.union(texts.join(up, F.col("_own") == F.col("_o")).select("_label", "_own", F.col("_w").alias("word"))).distinct()
    counts = both.join(w, "word").groupBy("_label", "_own").agg(F.sum("_weight").alias("n")).select(F.col("_label").alias("_l"), F.col("_own").alias("_o"), "n")
    return d.join(counts, F.col("_label").eqNullSafe(F.col("_l")) & F.col("_own").eqNullSafe(F.col("_o"))).groupBy(key).agg(F.sum("n").alias("n"))
