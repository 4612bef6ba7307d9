"""Readers of the learning domain's files: every schema is given, nothing is inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KNOWLEDGE_POINT = StructType([StructField(n, t) for n, t in (("id", StringType()), ("subject", StringType()), ("name", StringType()), ("subtopics", ArrayType(StringType())), ("difficulty", IntegerType()), ("frequency", StringType()), ("level", StringType()))])


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array, as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def knowledge_points(spark: SparkSession, path: str, default_level: str) -> DataFrame:
    return json_array(spark, path, KNOWLEDGE_POINT).withColumn("level", F.coalesce("level", F.lit(default_level)))


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every .md file below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def registry_scan(spark: SparkSession, path: str, extensions: list[str], known: DataFrame) -> DataFrame:
    """New files of supported kinds: path, size and content hash, without those whose hash is in known(hash)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = f.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(extensions)).select("path", "length", F.sha2("content", 256).alias("hash"))
    return f.join(known.select("hash"), "hash", "left_anti")


def graph_script(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, name) and edges (src, rel, dst) of a MERGE script, by pattern."""
    lines = spark.read.text(path)
    node = r"MERGE \(\w*:(\w+) *\{[^}]*?\bid: *['\"]([^'\"]+)['\"]"
    nodes = lines.where(F.col("value").rlike(node)).select(*[F.regexp_extract("value", node, i).alias(n) for i, n in ((1, "label"), (2, "id"))], F.regexp_extract("value", r"\bname: *['\"]([^'\"]+)['\"]", 1).alias("name"))
    edge = r"\{id: *['\"]([^'\"]+)['\"]\}\).*\{id: *['\"]([^'\"]+)['\"]\}\).*\[:(\w+)\]"
    edges = lines.where(F.col("value").rlike(edge)).select(F.regexp_extract("value", edge, 1).alias("src"), F.regexp_extract("value", edge, 3).alias("rel"), F.regexp_extract("value", edge, 2).alias("dst"))
    return nodes.dropDuplicates(["label", "id"]), edges.distinct()


def frontmatter(text: Column, key: str) -> Column:
    """The value of a flat key in a leading ``---`` block, or null."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    value = F.trim(F.regexp_extract(block, rf"(?m)^{key}: *(.*)$", 1))
    return F.when(value != "", F.regexp_replace(value, r"""^["']|["']$""", ""))


def wiki_links(text: Column) -> Column:
    """Names in [[name|alias]], distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; a temporary one only where a session on one machine (tests) names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{where.rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def rename_suffix(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the files of one folder another suffix; for a small folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(old):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[: -len(old)] + new))


def write_by_group(df: DataFrame, path: str, group: str, line: str) -> None:
    """A folder of text for each group, its lines in order over numbered files; a large group spans several tasks."""
    d = df.select(group, line).repartitionByRange(F.col(group), F.col(line)).sortWithinPartitions(group, line)
    d.write.partitionBy(group).text(path)


def note_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (src, link, dst) of notes(text) with front matter and links; dst is null where no note has the name."""
    n = notes.select(frontmatter(F.col("text"), "id").alias("id"), frontmatter(F.col("text"), "name").alias("name"), wiki_links(F.col("text")).alias("links"))
    nodes = n.select("id", "name")
    first = nodes.groupBy(F.col("name").alias("link")).agg(F.min("id").alias("dst"))
    edges = n.select(F.col("id").alias("src"), F.explode("links").alias("link")).join(first, "link", "left")
    return nodes, edges.select("src", "link", "dst")
