"""Queries over DataFrame operators that SQL text doesn't show: folds, files, vectors, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import parse, text
from ..operators import learner, tables, vector
from ..registry import query
from ..sources import files
from .dialect import Duck, Spark, with_views

def _practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(with_views(Spark(sf_dir), "practice") + "select * from practice")


@query("dom_sm2", with_views(Duck(), "practice") + """, r as (select email, kp, case when not is_correct and time_ms > 30000 then 2 when not is_correct then 1 when time_ms < 10000 then 5 when time_ms < 30000 then 4 when time_ms < 60000 then 3 else 2 end as q,
    row_number() over (partition by email, kp order by ts, id) as i from practice), f as (select email, kp, list(q order by i) as qs from r group by email, kp),
    s as (select email, kp, list_reduce(list_prepend({'ease': cast(2.5 as double), 'days': cast(0 as bigint), 'q': 0}, list_transform(qs, lambda z: {'ease': cast(0 as double), 'days': cast(0 as bigint), 'q': z})),
      lambda a, x: {'ease': round(greatest(cast(1.3 as double), a.ease + cast(0.1 as double) - (5 - x.q) * (cast(0.08 as double) + (5 - x.q) * cast(0.02 as double))), 2),
        'days': cast(least(365, case when x.q < 3 then 1 when a.days = 0 then 1 when a.days = 1 then 6 else floor(a.days * greatest(cast(1.3 as double), a.ease + cast(0.1 as double) - (5 - x.q) * (cast(0.08 as double) + (5 - x.q) * cast(0.02 as double))) + 0.5) end) as bigint), 'q': 0}) as t, len(qs) as n from f)
    select email, kp, cast(round(t.ease * 100) as bigint) as ease_hundredths, t.days as interval_days, n as reviews from s""")
def dom_sm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _practice(spark, sf_dir).withColumn("q", learner.quality(F.col("is_correct"), F.col("time_ms")))
    return learner.sm2(log, ["email", "kp"], ["ts", "id"], "q")


@query("dom_batch")
def dom_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _practice(spark, sf_dir).withColumn("delta", F.expr("case when is_correct and hint then 5 when is_correct then 15 else -20 end"))
    edges = spark.sql(with_views(Spark(sf_dir), "edges") + "select src, dst from edges")
    return learner.ripple_batch(log.select("email", "id", "kp", "delta"), edges)


@query("fn_chunk_markdown")
def fn_chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(text.chunk_markdown(F.col("text"))).alias("chunk", "text"))


@query("fn_balanced_json", "select conv_id, turn, '{\"a\": {\"b\": \"}\"}}' as object from conversations")
def fn_balanced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    wrapped = F.concat(F.lit("x "), F.lit('{"a": {"b": "}"}} {'), F.col("role"))
    return c.select("conv_id", "turn", text.balanced_json(wrapped).alias("object"))


@query("fn_json_repair", "select event_id, json_extract_string(props, '$.k') as k from events")
def fn_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    broken = F.regexp_replace(F.regexp_replace("props", "\\}$", ",}"), '"', "'")
    return e.select("event_id", F.get_json_object(parse.repaired_json(broken), "$.k").alias("k"))


@query("fn_sse_parse", "select conv_id, turn, role as event, 'x' || cast(turn as varchar) as data from conversations")
def fn_sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stream = F.concat(F.lit("event: "), F.col("role"), F.lit("\ndata: x"), F.col("turn").cast("string"), F.lit("\n\n"))
    return c.select("conv_id", "turn", F.inline(text.sse_events(stream)))


@query("dom_graph_build", """select a.src, 'part-' || cast(a.l as varchar) as link, b.p_partkey as dst from
    (select distinct p_partkey as src, unnest([p_partkey // 2, p_partkey * 3]) as l from part) a left join part b on b.p_partkey = a.l""")
def dom_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    notes = p.selectExpr(r"concat('---\nid: ', p_partkey, '\nname: part-', p_partkey, '\n---\nsee [[part-', p_partkey div 2, ']] and [[part-', p_partkey * 3, '|another]]') as text")
    edges = files.note_graph(notes)[1]
    return edges.select(F.col("src").cast("long").alias("src"), "link", F.col("dst").cast("long").alias("dst"))


@query("src_cypher", "select 'Point' as label, cast(p_partkey as varchar) as id, 'name ' || cast(p_size as varchar) as name from part")
def src_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "script")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    p.select(F.format_string("MERGE (n:Point {id: '%s', name: 'name %s'})", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))).write.text(path)
    return files.graph_script(spark, path)[0]


@query("src_jsonl", "select p_partkey, p_name, p_size from part")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "jsonl")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    p.write.json(path)
    return files.jsonl(spark, path, p.schema)


@query("snk_file_per_group", "select p_type as subject, p_name as line from part")
def snk_file_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "groups")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("subject"), F.col("p_name").alias("line"))
    files.write_by_group(p, path, "subject", "line")
    return spark.read.schema("value string, subject string").text(path).select("subject", F.col("value").alias("line"))


@query("top_vector_ann")
def top_vector_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vector.nearest(e, e.where("id % 50 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query("src_metadata_json", "select p_partkey as question, 'point ' || cast(p_size as varchar) as point from part")
def src_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "metadata")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    # a file is one array, of at most 1,000 annotations
    arrays = p.groupBy(F.expr("p_partkey div 1000")).agg(F.to_json(F.collect_list(F.expr("named_struct('question', p_partkey, 'points', array(concat('point ', p_size)))"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = files.json_array(spark, path, StructType([StructField("question", LongType()), StructField("points", ArrayType(StringType()))]))
    return found.select("question", F.explode("points").alias("point"))


@query("src_json_seed", "select n_nationkey as code, n_name as name, n_regionkey as region from nation")
def src_json_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "seed")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = F.collect_list(F.struct(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    n.agg(F.to_json(rows, {"pretty": "true"}).alias("value")).write.text(path)  # a seed file is one array
    return files.json_array(spark, path, "code int, name string, region int")


@query("src_kp_seed", """select cast(p_partkey as varchar) as id, p_type as subject, p_name as name, case when p_partkey % 3 = 0 then 'zhongkao' else 'gaokao' end as level from part where p_partkey < 100
    union all select 'old-' || cast(p_partkey as varchar), p_type, 'kept', 'other' from part where p_partkey between 50 and 60""")
def src_kp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from a seed file, with a default level, in place of all rows of the table that have a level of the file."""
    path = files.scratch(spark, "points")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    seed = p.where("p_partkey < 100").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("subject"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "zhongkao").alias("level"))
    seed.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    named = lambda d, i, level: d.select(F.concat(F.lit(i), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("subject"), F.lit("kept" if level == "other" else "gone").alias("name"), F.lit(level).alias("level"))
    old = named(p.where("p_partkey between 50 and 60"), "old-", "other").union(named(p.where("p_partkey between 10 and 90"), "gone-", "gaokao"))
    new = files.knowledge_points(spark, path, "gaokao").select("id", "subject", "name", "level")
    return tables.save(tables.replace(old, new, ["level"]), files.scratch(spark, "points-table"))


def _notes_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Markdown files, one for each region, and one of another kind."""
    path = files.scratch(spark, "notes")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    body = F.concat(F.lit("---\nid: r"), F.col("r_regionkey").cast("string"), F.lit("\nname: "), F.col("r_name"), F.lit("\n---\nsee [[REGION_0]]"))
    r.select(F.explode(F.array(F.struct(F.lit("md").alias("kind"), body.alias("value")), F.struct(F.lit("txt").alias("kind"), F.lit("other").alias("value")))).alias("x")).select("x.*").where("kind = 'md' or value = 'other'").repartition(1).write.option("maxRecordsPerFile", 1).partitionBy("kind").text(path)
    files.rename_suffix(spark, f"{path}/kind=md", ".txt", ".md")
    return path


@query("src_markdown_dir", "select 'r' || cast(r_regionkey as varchar) as id, r_name as name, 'REGION_0' as links from region")
def src_markdown_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files.markdown_folder(spark, _notes_folder(spark, sf_dir))
    return d.select(files.frontmatter(F.col("text"), "id").alias("id"), files.frontmatter(F.col("text"), "name").alias("name"), F.array_join(files.wiki_links(F.col("text")), ",").alias("links"))


@query("src_registry_scan", """select sha256('---' || chr(10) || 'id: r' || r_regionkey || chr(10) || 'name: ' || r_name || chr(10) || '---' || chr(10) || 'see [[REGION_0]]' || chr(10)) as hash from region where r_regionkey <> 0""")
def src_registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of Markdown files that aren't known yet; the first region's is."""
    path = _notes_folder(spark, sf_dir)
    known = files.registry_scan(spark, path, [".md"], spark.createDataFrame([], "hash string"))
    first = files.markdown_folder(spark, path).where("text like '%id: r0%'").select(F.sha2("text", 256).alias("hash"))
    return known.select("hash").join(first, "hash", "left_anti")
