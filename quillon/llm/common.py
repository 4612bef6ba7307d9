"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that ``join_counted`` may broadcast.
HOT = 1_000
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20
#: Words everywhere in this package: maximal runs without these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has set another bound than Spark's default of 64 MB: long texts would else make them large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where a session on one machine (tests) names none, it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def unstash(df: DataFrame) -> None:
    """Remove a stashed table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_quillon_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_counted(rows: DataFrame, counted: DataFrame, on: dict[str, str], n: str) -> DataFrame:
    """rows joined to a stashed table with one row a key, by rows' columns -> its columns; ``n`` is how many rows have the key.

    Keys that more than one in HOT of all these rows have would each land in one task: these, HOT at most, are joined by broadcast, the others by shuffle."""
    total = counted.agg(F.sum(n)).first()[0]
    if total is None:
        total = 0
    hot = F.col(n) > max(1, total // HOT)
    cond = [F.col(a) == F.col(b) for a, b in on.items()]
    few = rows.join(F.broadcast(counted.where(hot)), cond)
    # rows of hot keys find nothing on the other way, and don't travel: they are left out before the shuffle
    keys = counted.where(hot).select(*[F.col(b).alias(f"_q_hot{i}") for i, b in enumerate(on.values())])
    cold = rows.join(F.broadcast(keys), [F.col(a) == F.col(f"_q_hot{i}") for i, a in enumerate(on)], "left_anti")
    # both sides grow with the corpus, so this is never a broadcast
    return few.unionByName(cold.join(counted.where(~hot).hint("merge"), cond))


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, k, h, text), with k and h that only rows of equal id and text share; the lowest bit of h says that doc_id is null."""
    text = text_or_empty()
    h = F.xxhash64(text).bitwiseAND(F.lit(-2)) + F.col("doc_id").isNull().cast("long")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), h.alias("h"), text.alias("text"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the values' MD5."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])), 1, 8), 16, 10)
    return (h.cast("double") + 1) / F.lit(4294967297.0)


def bucketed_prefix_sum(df: DataFrame, group: list[str], piece: Column, order: list[Column], size: str, out: str, counted: DataFrame) -> DataFrame:
    """Sum of ``size`` over the rows that precede each row of its group, without putting a group in one task.

    ``piece`` is a whole number that never falls in ``order``. Pieces are summed first, from ``counted`` (the rows without what makes them wide), their
    offsets are a window over pieces, and rows are only ordered within a piece. Groups must not be null: then the wide rows are shuffled once, as the
    window and the join want them by the same keys.
    """
    from pyspark.sql import Window

    keys = [*group, "_q_piece"]
    df, counted = (d.withColumn("_q_piece", piece.cast("long")) for d in (df, counted))
    before = Window.partitionBy(*group).orderBy("_q_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counted.groupBy(*keys).agg(F.sum(size).alias("_q_sum")).select(*keys, F.coalesce(F.sum("_q_sum").over(before), F.lit(0)).alias("_q_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_q_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    # the table of pieces grows with the corpus, so it is never a broadcast
    return df.join(pieces.hint("merge"), keys).withColumn(out, F.col("_q_before") + F.col("_q_in")).drop("_q_before", "_q_in", "_q_piece")


# --- byte-level tokenising of whole Arrow batches with NumPy -------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so invertible modulo 2**64
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_TABLE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers that a worker keeps; longer runs of them, for very long texts, are made when needed.
_KEPT = 1 << 21
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if n <= _KEPT:
            _POWERS[key] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, all ranges at once, from one running polynomial sum."""
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(len(data), _BASE, "up"), out=run[1:])
        h = (run[ends] - run[starts]) * _powers(len(data) + 1, _BASE_INV, "down")[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * _MIX)


def batch_words(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, in order, and the offset of each text's first word (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8) if raw else np.zeros(0, np.uint8)
    if lower:
        data = _LOWER[data]
    solid = ~_IS_BLANK[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) if raw else np.zeros(1, int)
    return range_hashes(data, starts, ends), np.searchsorted(starts, begin)


def shingle_sets(texts: list, words: int):
    """For each text the sorted distinct hashes of its ``words``-word shingles; fewer words make one shingle, none make none."""
    h, at = batch_words(texts)
    with np.errstate(over="ignore"):
        whole = h.copy()
        for k in range(1, words):
            whole[: len(h) - k] = mix64(whole[: len(h) - k] * np.uint64(0x2545F4914F6CDD1D) + h[k:] + np.uint64(k))
        for i in range(len(texts)):
            a, b = at[i], at[i + 1]
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                x = h[a : a + 1].copy()
                for k in range(1, b - a):
                    x = mix64(x * np.uint64(0x2545F4914F6CDD1D) + h[a + k : a + k + 1] + np.uint64(k))
                yield mix64(x + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def slices(batch, most_bytes: int = 1 << 20, column: int = 1):
    """Cut an Arrow batch where its texts pass ``most_bytes``, so that a task's memory doesn't follow the batch size."""
    if not batch.num_rows:
        return
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        done = end[i - 1] if i else 0
        k = max(i + 1, int(np.searchsorted(end, done + most_bytes, "right")))
        yield batch.slice(i, k - i)
        i = k


def runs_of(values, most_chars: int = 1 << 20):
    """(start, end) of runs of texts of about ``most_chars``."""
    i = 0
    while i < len(values):
        j, size = i, 0
        while j < len(values) and (j == i or size + len(values[j]) <= most_chars):
            size += len(values[j])
            j += 1
        yield i, j
        i = j


def release() -> None:
    """Give freed memory back to the machine: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """For ``mapInArrow``: the worker gives memory back when the task's batches end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
