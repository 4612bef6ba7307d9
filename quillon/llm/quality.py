"""Quality classifier by importance resampling.

Two bag-of-hashed-n-gram models (word unigrams and bigrams in ``BUCKETS`` buckets, smoothed by the raw frequencies): one of the target
text (documents labelled good and not toxic) and one of all raw text. A document's log importance weight is the mean of
``log p_target / p_raw`` over its n-grams, shrunk for few words and scaled as if every document had ``LENGTH`` words, so that length by
itself doesn't decide. Gumbel noise from the document's id is added and the top k documents are kept: k documents sampled
without replacement in proportion to their weights. k is the number of documents above the weight that best parts good from bad
labelled rows, where losing a good one counts ``LOSS`` times as much as keeping a bad one; a toxic row is a bad one.

A few words make a text toxic, and a mean hides them: a third model holds in how many toxic and clean labelled rows each word (hashed to
``TOXIC_BUCKETS``) stands. A document's toxicity is the sum of its ``STRONGEST`` largest positive log ratios toxic to clean of words in ``LEAST_TOXIC``
toxic rows or more. The bound that best parts toxic from clean rows, each scored without its own counts, is taken from the labels, by ``LOSS`` again;
a document's weight falls by ``LENGTH`` times what its toxicity is above the bound.

Raw counts cover every document. The target and toxic models are fitted on at most ``MOST_LABELS`` labelled rows (those whose doc_id hashes lowest), the only bound.

Defined cases: null or blank text has weight 0; documents without labels are fine; with no good or no bad labels everything is kept; documents tied
at the last place all stay; repeated rows are judged alike; null ids share one noise value; an empty table stays empty; of labelled texts with the same
id one counts. Columns of the table whose names begin with ``_q_`` are not allowed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_words, mix64, release, runs_of, slices, stash, text_or_empty, tidy, unit_hash, unstash

BUCKETS = 10_000
SMOOTH = 1.0
LENGTH, SHRINK, LOSS = 100.0, 10.0, 20.0
MOST_LABELS = 20_000
TOXIC_BUCKETS, STRONGEST, LEAST_TOXIC = 1 << 18, 3, 3
#: What a labelled row is: of the target (good, clean), toxic, or clean but bad.
TARGET, TOXIC, BAD = 1, 2, 3
#: Doubles that may be collected at the end of a rank search.
MOST_COLLECTED, SLICES = 10_000, 4_096


def ngram_buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's unigrams and bigrams (a row per word: its own bucket, and that of it and its successor or -1)."""
    h, at = batch_words(texts, lower=False)
    out = np.full((len(h), 2), -1, np.int64)
    out[:, 0] = h % np.uint64(BUCKETS)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            out[:-1, 1] = mix64(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(BUCKETS)
    last = at[1:][at[1:] > at[:-1]] - 1
    out[last, 1] = -1
    return out, at


def toxic_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each text's distinct words, ordered."""
    h, at = batch_words(texts, lower=True)
    both = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * TOXIC_BUCKETS + (h % np.uint64(TOXIC_BUCKETS)).astype(np.int64))
    return both // TOXIC_BUCKETS, both % TOXIC_BUCKETS


def toxicity(texts: list, ratio: np.ndarray) -> np.ndarray:
    """Each text's sum of the largest positive log ratios of its words."""
    doc, word = toxic_words(texts)
    x = ratio[word]
    doc, x = doc[x > 0], x[x > 0]
    order = np.lexsort((-x, doc))
    doc, x = doc[order], x[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return np.bincount(doc, weights=np.where(rank < STRONGEST, x, 0.0), minlength=len(texts))


@tidy
def _counts(batches):
    """Raw and target counts by n-gram bucket; after them clean and toxic rows by word bucket; last how many clean and toxic rows there are."""
    raw, target = (np.zeros(BUCKETS + TOXIC_BUCKETS + 1, np.int64) for _ in range(2))
    for whole in batches:
        for b in slices(whole, column=0):
            texts, kind = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.int64)
            grams, at = ngram_buckets(texts)
            chosen = np.repeat(kind == TARGET, np.diff(at))
            flat = grams.ravel()
            raw[:BUCKETS] += np.bincount(flat[flat >= 0], minlength=BUCKETS)
            flat = grams[chosen].ravel()
            target[:BUCKETS] += np.bincount(flat[flat >= 0], minlength=BUCKETS)
            for counts, mine in ((raw, (kind == TARGET) | (kind == BAD)), (target, kind == TOXIC)):
                _, word = toxic_words([texts[i] for i in np.flatnonzero(mine)])
                counts[BUCKETS:-1] += np.bincount(word, minlength=TOXIC_BUCKETS)
                counts[-1] += mine.sum()
    some = np.flatnonzero(raw + target)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def toxic_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """The log ratio of each word; 0 for those in too few toxic rows."""
    r = np.log((np.maximum(toxic, 0) + 0.5) / (max(n_toxic, 0) + 1)) - np.log((np.maximum(clean, 0) + 0.5) / (max(n_clean, 0) + 1))
    return np.where(toxic >= LEAST_TOXIC, r, 0.0)


def toxic_bound(rows: DataFrame, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> float:
    """The toxicity that best parts labelled rows(doc_id, text, kind); each is scored without its own counts."""
    without = {True: toxic_ratio(toxic - 1, clean, n_toxic - 1, n_clean), False: toxic_ratio(toxic, clean - 1, n_toxic, n_clean - 1)}

    @F.pandas_udf("double")
    def score(text: pd.Series, kind: pd.Series) -> pd.Series:
        out, values, is_toxic = np.zeros(len(text)), text.tolist(), kind.to_numpy() == TOXIC
        for i, j in runs_of(values):
            for side, ratio in without.items():
                at = i + np.flatnonzero(is_toxic[i:j] == side)
                out[at] = toxicity([values[k] for k in at], ratio)
        return pd.Series(out)

    # a row for each labelled id, MOST_LABELS at most; of texts with the same id the most toxic counts
    found = rows.select("doc_id", score("text", "kind").alias("s"), "kind").groupBy("doc_id", "kind").agg(F.max("s").alias("s")).orderBy("s").toPandas()
    s, bad = found["s"].to_numpy(), found["kind"].to_numpy() == TOXIC
    good = found["kind"].to_numpy() == TARGET
    # cost of a bound above the i-th smallest toxicity, where equal ones lie on one side
    cost = np.append(0, np.cumsum(bad)) + LOSS * np.append(np.cumsum(good[::-1])[::-1], 0)
    cost[1:-1][s[1:] == s[:-1]] = np.inf
    i = len(s) - int(np.argmin(cost[::-1]))
    # a text without toxic words never loses weight
    return math.inf if i == len(s) else (s[i - 1] + s[i]) / 2 if i else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
    """The log ratio of each bucket, that of each word toxic to clean, the bound on toxicity and the labelled sample (MOST_LABELS rows at most)."""
    sample = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    kinds = sample.select(F.col("doc_id").alias("_q_l"), F.when(F.col("toxic") != 0, TOXIC).when(F.col("good") == 1, TARGET).otherwise(BAD).alias("kind"))
    d = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(kinds), F.col("doc_id") == F.col("_q_l"), "left")  # MOST_LABELS ids at most
    d = d.select("doc_id", text_or_empty().alias("text"), F.coalesce("kind", F.lit(0)).alias("kind"))
    total = d.select("text", "kind").mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # words in too few toxic rows have no ratio; BUCKETS + TOXIC_BUCKETS + 1 rows at most
    total = total.where((F.col("bucket") < BUCKETS) | (F.col("target") >= LEAST_TOXIC) | (F.col("bucket") == BUCKETS + TOXIC_BUCKETS)).collect()
    raw, target = np.zeros(BUCKETS + TOXIC_BUCKETS + 1), np.zeros(BUCKETS + TOXIC_BUCKETS + 1)
    for b, r, t in total:
        raw[b], target[b] = r, t
    clean, toxic, n_clean, n_toxic = raw[BUCKETS:-1], target[BUCKETS:-1], raw[-1], target[-1]
    raw, target = raw[:BUCKETS], target[:BUCKETS]
    tox_ratio, bound = toxic_ratio(toxic, clean, n_toxic, n_clean), math.inf
    if n_clean and (tox_ratio > 0).any():
        bound = toxic_bound(d.where("kind > 0"), toxic, clean, n_toxic, n_clean)
    if not target.sum():
        return np.zeros(BUCKETS), tox_ratio, bound, sample
    # the raw text's own frequencies smooth the target's, so that a bucket the target sample never saw isn't evidence by itself
    prior = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    ratio = np.log((target + SMOOTH * BUCKETS * prior) / (target.sum() + SMOOTH * BUCKETS)) - np.log(prior)
    return ratio, tox_ratio, bound, sample


def log_weight(ratio: np.ndarray, tox_ratio: np.ndarray, bound: float) -> Column:
    @F.pandas_udf("struct<w:double,n:long>")
    def weigh(text: pd.Series) -> pd.DataFrame:
        out, n = np.zeros(len(text)), np.zeros(len(text), np.int64)
        values = text.tolist()
        over = np.zeros(len(text))
        for i, j in runs_of(values):
            grams, at = ngram_buckets(values[i:j])
            each = np.append(np.where(grams >= 0, ratio[grams], 0.0).sum(axis=1), 0.0)
            some = np.flatnonzero(np.diff(at))
            if len(some):
                out[i + some] = np.add.reduceat(each[:-1], at[:-1][some])
            n[i:j] = np.diff(at)
            if bound < math.inf:
                over[i:j] = np.maximum(toxicity(values[i:j], tox_ratio) - bound, 0.0)
        out = LENGTH * (out / (np.maximum(2 * n - 1, 0) + SHRINK) - over)
        release()
        return pd.DataFrame({"w": out, "n": n})

    return weigh(text_or_empty())


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest of finite numbers: the range that holds it is cut into SLICES, until few values are left or all in it are equal."""
    df = df.select(F.col(col).alias("x"))
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return -math.inf
    k, above = min(max(k, 1), n), 0
    while n > MOST_COLLECTED and lo < hi:
        width = (hi - lo) / SLICES
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(SLICES - 1)) if width > 0 else (F.col("x") > lo).cast("long")
        # SLICES rows at most
        for _, c, low, high in df.where(F.col("x").between(lo, hi)).groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).orderBy(F.desc("at")).collect():
            if above + c >= k:
                n, lo, hi = c, low, high
                break
            above += c
    if lo == hi:
        return lo
    left = sorted((r[0] for r in df.where(F.col("x").between(lo, hi)).collect()), reverse=True)  # MOST_COLLECTED values at most
    return left[k - above - 1]


def weighed(docs: DataFrame, *model) -> DataFrame:
    """``docs`` with _q_w (log weight and words) and _q_key (Gumbel noise added)."""
    if any(c.startswith("_q_") for c in docs.columns):
        raise ValueError("columns that begin with _q_ are this operator's own")
    noise = -F.log(-F.log(unit_hash(F.lit("gumbel"), F.col("doc_id"))))
    return docs.withColumn("_q_w", log_weight(*model)).withColumn("_q_key", F.col("_q_w.w") + noise)


def wanted(scored: DataFrame, sample: DataFrame) -> int | None:
    """How many documents to keep, from the labelled rows' weights; None: all."""
    s = sample.select(F.col("doc_id").alias("_q_l"), F.when(F.col("toxic") != 0, 0).otherwise(F.col("good")).alias("good"))
    # a row for each labelled id, MOST_LABELS at most; of texts with the same id the one with the least weight counts
    rows = scored.join(F.broadcast(s), F.col("doc_id") == F.col("_q_l")).groupBy("doc_id", "good").agg(F.min("_q_s").alias("_q_s")).orderBy("_q_s").toPandas()
    good = rows["good"].fillna(0).to_numpy() == 1
    if good.all() or not good.any():
        return None
    w = rows["_q_s"].to_numpy()
    # cost of a cut below the i-th smallest weight
    cost = LOSS * np.append(0, np.cumsum(good)) + np.append(np.cumsum(~good[::-1])[::-1], 0)
    i = int(np.argmin(cost))
    cut = -math.inf if i == 0 else (w[i - 1] + w[i]) / 2 if i < len(w) else w[-1]
    return scored.where(F.col("_q_s") >= cut).count()


def threshold(scored: DataFrame, sample: DataFrame) -> float:
    """The key of the last document kept."""
    k = wanted(scored, sample)
    return -math.inf if k is None else kth_largest(scored, "_q_key", k)


def _scored(docs: DataFrame, *model) -> DataFrame:
    w = weighed(docs.select("doc_id", "text"), *model)
    return stash(w.select("doc_id", F.col("_q_w.n").alias("_q_n"), F.col("_q_w.w").alias("_q_s"), "_q_key"), "quality")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    *model, sample = fit(docs, labels)
    w = _scored(docs, *model)
    bar = threshold(w, sample)
    return w.select("doc_id", F.col("_q_n").alias("n_words"), F.col("_q_s").alias("log_weight"), (F.col("_q_key") >= bar).alias("keep"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    *model, sample = fit(docs, labels)
    scored = _scored(docs, *model)
    bar = threshold(scored, sample)
    unstash(scored)
    return weighed(docs, *model).where(F.col("_q_key") >= bar).select(*[F.col(f"`{c}`") for c in docs.columns])
