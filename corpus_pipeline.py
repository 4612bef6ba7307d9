"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, line_dedup, mixing, near_dedup, quality
from quillon.llm.common import bounded, stash, table, unstash
from quillon.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stood earlier."""
    bounded(spark)
    return line_dedup.stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    bounded(spark)
    return near_dedup.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded(spark)
    return mixing.stage(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids; text is what the ids decode to."""
    import public_tokenizers

    bounded(spark)
    return bpe.stage(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("line_dedup", cut_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", tokenise)]

#: A classifier fitted on hashed n-grams and MinHash components can't be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            written = stash(docs, f"stage-{name}")
            if before is not None:
                unstash(before)
            docs = before = written
    return docs
