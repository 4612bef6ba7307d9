"""Keyed writes over all orders, migrations, JSON columns and named document indexes. The JSON texts are made of each row's own columns, so that the oracles
can say from these what parsing must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, migrate, relational, tables
from ..registry import query
from ..sources import files
from ..streaming import timers
from .domain_queries import NOW, Views, ask

OLD = "select o_orderkey as code, o_orderpriority as name, o_custkey as region from {orders}"
# what came in over the last days, some of it for orders that don't exist yet
NEW = """select o_orderkey + 20 as code, lower(o_orderpriority) as name, case when o_orderstatus <> 'P' then o_custkey end as region from {orders}
    where o_orderdate >= (select max(o_orderdate) from {orders}) - interval 2 day"""


def _keyed(name: str, f, key: list[str], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str, parts: int = 64) -> DataFrame:
        orders, path = spark.read.parquet(f"{sf_dir}/orders.parquet"), files.scratch(spark, name)
        layout.create(spark.sql(OLD, orders=orders), path, key, parts)
        layout.write(spark, path, spark.sql(NEW, orders=orders), f)
        return layout.read(spark, path)

    query(name, f"with o as ({OLD.format(orders='orders')}), n as ({NEW.format(orders='orders')}) {oracle}")(run)


_keyed("snk_insert", lambda o, n, key: tables.insert(o, n), ["code"], "select * from o union all select * from n")
_keyed("snk_upsert", tables.upsert, ["code"], "select * from n union all select * from o where code not in (select code from n)")
_keyed("snk_upsert_keep", tables.upsert_keep, ["code"], "select coalesce(n.code, o.code) as code, coalesce(n.name, o.name) as name, coalesce(n.region, o.region) as region from o full join n on o.code = n.code")
_keyed("snk_insert_ignore", tables.insert_ignore, ["code"], "select * from o union all select * from n where code not in (select code from o)")
_keyed("snk_replace", tables.replace, ["region"], "select * from o where not exists (select 1 from n where n.region = o.region) union all select * from n")
_keyed("snk_update", tables.update, ["code"], "select o.code, coalesce(n.name, o.name) as name, coalesce(n.region, o.region) as region from o left join n on o.code = n.code")
_keyed("snk_delete", tables.delete, ["code"], "select * from o where code not in (select code from n)")


@query("snk_batch_insert", f"with o as ({OLD.format(orders='orders')}), n as ({NEW.format(orders='orders')}), a as (select * from o union all select * from n) select region, count(*) as n, max(name) as last_name from a group by region")
def snk_batch_insert(spark: SparkSession, sf_dir: str, parts: int = 64) -> DataFrame:
    """Rows are inserted priority by priority, five writes; then the aggregate is refreshed."""
    orders, path = spark.read.parquet(f"{sf_dir}/orders.parquet"), files.scratch(spark, "snk_batch_insert")
    layout.create(spark.sql(OLD, orders=orders), path, ["code"], parts)
    new = spark.sql(NEW, orders=orders)
    for first in "12345":
        layout.write(spark, path, new.where(F.col("name").startswith(first)), lambda o, n, key: tables.insert(o, n))
    return layout.read(spark, path).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last_name"))


# --- JSON columns and migrations --------------------------------------------------------------------------------------------
def _sources(v: Views) -> migrate.Tables:
    """The learning tables as they were before any migration."""
    k = F.get_json_object("data", "$.k")
    name = F.create_map(*[F.lit(x) for x in ("click", "数学", "view", "物理", "purchase", "chemistry")])
    point = F.when(F.col("subject") == "view", F.format_string('"knowledge_point_id": "K%d"', "kp")).otherwise(F.format_string('"knowledge_points": ["P%d", "X"]', "kp"))
    session = F.when(F.col("subject") == "signup", F.lit("gone")).otherwise(F.format_string("s%d", "email"))
    whole = F.concat(F.lit('{"subject": "'), F.coalesce(F.try_element_at(name, F.col("subject")), "subject"), F.lit('", '), point, F.lit(', "difficulty": " '), k, F.lit(' of 5", "question_id": '), (k.cast("long") * 1000 + 1).cast("string"), F.lit(', "session_id": "'), session, F.lit('"}'))
    wrong = v.wrong.select("id", "email", F.when(F.col("subject") == "error", F.concat(F.lit("no object "), k)).otherwise(whole).alias("data"))
    kp = F.col("kp").cast("string")
    points = F.when(F.col("qtype") == "N", F.concat(F.lit('["'), kp, F.lit('", {"id": "Q'), kp, F.lit('"}, "'), kp, F.lit('"]'))).when(F.col("qtype") == "A", F.concat(F.lit('"'), kp, F.lit('"'))).otherwise(F.concat(F.lit("point "), kp))
    questions = v.questions.select((F.col("paper_id") * 1000 + F.col("seq")).alias("id"), "paper_id", "question_number", points.alias("knowledge_points"))
    sessions = v.practice.groupBy("email").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("subject"))
    sessions = sessions.select(F.format_string("s%d", "email").alias("id"), "email", "subject", F.when(F.col("n") % 2 == 0, "completed").otherwise("open").alias("status"))
    return {"wrong": wrong, "questions": questions, "papers": v.papers.select("id", "province", "yr", "subject"), "sessions": sessions}


TYPED = """, w as (select id, email, subject as s, kp, cast(json_extract_string(data, '$.k') as bigint) as k from wrong),
  typed as (select id, email, s, kp, k, case s when 'click' then 'math' when 'view' then 'physics' when 'purchase' then 'chemistry' end as subject_code, case when s = 'error' then null when s = 'view' then 'K' || kp else 'P' || kp end as knowledge_point_id,
    case when s <> 'error' then cast(greatest(1, least(5, k)) as int) end as difficulty, case when s <> 'error' then k * 1000 + 1 end as question_id, case when s = 'signup' then 'gone' when s <> 'error' then 's' || email end as session_id from w)
"""


@ask("fn_backfill", "practice wrong", TYPED + "select id, subject_code, knowledge_point_id, difficulty, question_id, session_id from typed")
def fn_backfill(v: Views) -> DataFrame:
    return migrate.typed(_sources(v)["wrong"]).select("id", "subject_code", "knowledge_point_id", "difficulty", "question_id", "session_id")


@ask("fn_subject_map", "practice", """select id, case subject when 'click' then 'math' when 'view' then 'physics' when 'purchase' then 'chemistry' else subject end as key, case subject when 'click' then '数学' when 'view' then '物理' when 'purchase' then '化学' else subject end as name from practice""")
def fn_subject_map(v: Views) -> DataFrame:
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("click", "数学", "view", "physics", "purchase", "化学")]), F.col("subject")), "subject")
    return v.practice.select("id", migrate.subject_key(said).alias("key"), migrate.subject_name(said).alias("name"))


@ask("dom_migration", "practice wrong questions papers", TYPED + """, sessions as (select 's' || email as id, email, min(subject) as subject, case when count(*) % 2 = 0 then 'completed' else 'open' end as status from practice group by email),
  q as (select paper_id * 1000 + seq as id, paper_id, question_number, qtype, kp from questions), kept as (select paper_id, question_number, min(id) as id from q group by all),
  once as (select t.* from typed t join (select min(id) as id from typed group by email, s = 'error', k, case when s <> 'error' then s end, case when s <> 'error' then kp end) f on f.id = t.id)
  select 'wrong' as part, id, subject_code, knowledge_point_id, difficulty, question_id from once where (question_id is null or question_id in (select id from kept)) and (session_id is null or session_id in (select id from sessions))
  union all select 'practice', t.id, s.subject, t.knowledge_point_id, t.difficulty, t.question_id from typed t join sessions s on s.id = t.session_id and s.email = t.email where s.status = 'completed'
  union all select 'questions', k.id, p.subject, cast(p.province as varchar), p.yr, k.paper_id from kept k left join papers p on p.id = k.paper_id
  union all select distinct 'points', id, null, case when i = 1 then '' || kp else 'Q' || kp end, null, null from q, (values (1), (2)) v(i) where qtype = 'N' or qtype = 'A' and i = 1""")
def dom_migration(v: Views, folder: str | None = None) -> DataFrame:
    """All tables after all steps, one below the other; with a ``folder``, a broken run goes on there."""
    t = migrate.migrate(v.spark, folder or files.scratch(v.spark, "dom_migration"), migrate.STEPS, _sources(v))
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        t["wrong"].select(F.lit("wrong").alias("part"), "id", "subject_code", "knowledge_point_id", "difficulty", "question_id"),
        t["practice"].select(F.lit("practice"), "wrong_id", "subject_code", "knowledge_point_id", "difficulty", "question_id"),
        t["questions"].select(F.lit("questions"), "id", "subject_code", F.col("province_code").cast("string"), "year", "paper_id"),
        t["question_points"].select(F.lit("points"), "question_id", none("string"), "knowledge_point_id", none("int"), none("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# --- statistics -----------------------------------------------------------------------------------------------------------------
def _kp_stats(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(province, yr, subject, kp, frequency, avg_difficulty, total_score): each point of a question's JSON list counts as often as it is there."""
    p = papers.select(F.col("id").alias("paper_id"), "province", "yr", "subject")
    # lists are taken apart after the join, so those of other papers aren't
    d = questions.join(p, "paper_id").withColumn("kp", F.explode(F.from_json("knowledge_points", "array<string>")))
    return d.groupBy("province", "yr", "subject", "kp").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("difficulty"), 2).alias("avg_difficulty"), F.sum("score").alias("total_score"))


@ask("agg_kp_stats_build", "questions papers", """, x as (select p.province, p.yr, p.subject, q.kp, q.difficulty, q.score from questions q join papers p on p.id = q.paper_id), last as (select max(yr) - 1 as y from papers),
  old as (select province, yr, subject, '' || kp as kp, count(*) as frequency, round(avg(difficulty), 2) as avg_difficulty, cast(sum(score) as bigint) as total_score from x group by all),
  new as (select province, yr, subject, kp, count(*) as frequency, round(avg(difficulty), 2) as avg_difficulty, cast(sum(score) as bigint) as total_score from (select province, yr, subject, '' || kp as kp, difficulty, score from x union all select province, yr, subject, 'Q' || kp, difficulty, score from x) a where yr >= (select y from last) group by all)
  select * from new union all select o.* from old o where not exists (select 1 from new n where n.province = o.province and n.yr = o.yr and n.subject = o.subject and n.kp = o.kp)""")
def agg_kp_stats_build(v: Views, parts: int = 64) -> DataFrame:
    """The statistics had one point a question; those of the last two years are built anew with all points and written over them."""
    path, kp = files.scratch(v.spark, "kp_stats"), F.col("kp").cast("string")
    listed = lambda *x: v.questions.withColumn("knowledge_points", F.to_json(F.array(*x)))
    layout.create(_kp_stats(listed(kp), v.papers), path, ["province", "yr", "subject", "kp"], parts)
    last = v.papers.agg((F.max("yr") - 1).alias("_last"))
    recent = v.papers.join(F.broadcast(last), F.col("yr") >= F.col("_last")).drop("_last")
    layout.write(v.spark, path, _kp_stats(listed(kp, F.concat(F.lit("Q"), kp)), recent), tables.upsert)
    return layout.read(v.spark, path)


@ask("agg_annotation_quality", "questions papers edges", """select p.subject, count(*) as questions, count(*) filter (where e.n > 0) as matched, round(100.0 * count(*) filter (where e.n > 0) / count(*), 2) as rate, round(avg(e.n), 2) as avg_related
  from questions x join papers p on p.id = x.paper_id left join (select src, count(*) as n from edges group by src) e on e.src = x.kp group by p.subject""")
def agg_annotation_quality(v: Views) -> DataFrame:
    """Questions, those with related points, their share and how many they have, by subject."""
    related = v.edges.groupBy(F.col("src").alias("kp")).agg(F.collect_list("dst").alias("related"))
    d = v.questions.join(related, "kp", "left").join(v.papers.select(F.col("id").alias("paper_id"), "subject"), "paper_id")
    matched = F.size("related") > 0
    return d.groupBy("subject").agg(F.count(F.lit(1)).alias("questions"), F.count_if(matched).alias("matched"), F.round(100.0 * F.count_if(matched) / F.count(F.lit(1)), 2).alias("rate"), F.round(F.avg(F.when(matched, F.size("related"))), 2).alias("avg_related"))


@ask("flt_relative_year", "papers", "select yr, count(*) as n from papers where yr >= 1996 group by yr")
def flt_relative_year(v: Views, as_of: str = "1999-06-30", years: int = 3) -> DataFrame:
    return v.papers.where(F.col("yr") >= F.year(F.lit(as_of).cast("date")) - years).groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@ask("dom_trend_client", "questions papers", """, y as (select x.kp, p.yr, count(*) as n, sum(x.score) as score from questions x join papers p on p.id = x.paper_id group by all), t as (select kp, cast(sum(n) as bigint) as total, cast(sum(score) as bigint) as total_score from y group by kp),
  r as (select *, row_number() over (order by total desc, kp) as place from t), s as (select kp, string_agg(yr || ':' || n, ',' order by yr) as series from y group by kp)
  select r.kp, r.place, r.total, r.total_score, case when r.place <= 8 then s.series end as series from r join s on s.kp = r.kp where r.place <= 20""")
def dom_trend_client(v: Views, most: int = 20, drawn: int = 8) -> DataFrame:
    """The most frequent points of all years with their scores, and the yearly series of the first of them."""
    y = v.questions.join(v.papers.select(F.col("id").alias("paper_id"), "yr"), "paper_id").groupBy("kp", "yr").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    t = y.groupBy("kp").agg(F.sum("n").alias("total"), F.sum("score").alias("total_score"), F.array_sort(F.collect_list(F.struct("yr", "n"))).alias("_s"))
    top = t.orderBy(F.desc("total"), "kp").limit(most)
    # at most ``most`` rows are ranked
    top = top.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("o"), "kp", "total", "total_score", "_s"))).alias("a")).select(F.posexplode("a").alias("i", "x"))
    series = F.when(F.col("i") < drawn, F.array_join(F.transform("x._s", lambda s: F.concat_ws(":", s["yr"].cast("string"), s["n"].cast("string"))), ","))
    return top.select("x.kp", (F.col("i") + 1).cast("long").alias("place"), "x.total", "x.total_score", series.alias("series"))


# --- documents ------------------------------------------------------------------------------------------------------------------
# fixed values: subjects by what a file's name holds, the first that fits; and the named indexes
FILE_RULES = (("math", "数学"), ("chinese", "语文"), ("english", "英语|英文"), ("physics", "物理"), ("chemistry", "化学"), ("politics", "政治|思想政治"))
INDEXES = {
    "gaokao_all": "exam_type = '高考'",
    "zhongkao_beijing": "exam_type = '中考' and province = '北京'",
    "highschool_knowledge": "doc_kind = '知识点'",
    "subject_math": "subject = '数学'",
    "subject_chinese": "subject = '语文'",
    "province_beijing": "province = '北京' and exam_type = '高考'",
}


def classify_file(name):
    """The subject of a file by its name, or null."""
    out = F.lit(None).cast("string")
    for subject, pattern in reversed(FILE_RULES):
        out = F.when(name.rlike(pattern), F.lit(subject)).otherwise(out)
    return out


DOCS = """, d as (select doc_id, case when lang in ('en', 'fr') then '高考' else '中考' end as exam_type, case when source in ('src1', 'src2') then '北京' else source end as province, case lang when 'en' then '数学' when 'fr' then '英文' when 'de' then '语文' else lang end as subject,
    case when n_chars > 2000 then '知识点' else '试卷' end as doc_kind, case when n_chars > 100 then 'converted' else 'pending' end as status from documents)
"""


def _docs(v: Views) -> DataFrame:
    return v.spark.sql("with _none as (select 1)" + DOCS.replace("from documents", "from {documents}") + "select * from d", documents=v.documents)


@ask("fn_classify_file", "", DOCS + "select doc_id, case when subject = '数学' or exam_type = '中考' and doc_kind = '知识点' then 'math' when subject = '语文' then 'chinese' when subject = '英文' then 'english' end as subject from d")
def fn_classify_file(v: Views) -> DataFrame:
    """Names like those of scanned papers: a subject, a kind, and for some two subjects, of which the first rule's counts."""
    name = F.concat("subject", F.lit("_"), "province", F.lit("_"), F.when((F.col("exam_type") == "中考") & (F.col("doc_kind") == "知识点"), "含数学").otherwise(F.lit("卷")), F.lit(".pdf"))
    return _docs(v).select("doc_id", classify_file(name).alias("subject"))


@ask("fn_index_filter", "", DOCS + " union all ".join(f"select '{n}' as index_name, doc_id from d where {c}" for n, c in INDEXES.items()))
def fn_index_filter(v: Views) -> DataFrame:
    """Every named index's documents, in one read of the table."""
    names = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in INDEXES.items()]), lambda x: x.isNotNull())
    return _docs(v).select(F.explode(names).alias("index_name"), "doc_id")


@ask("dom_retrieve_docs", "", DOCS + "select doc_id, subject, province from d where status = 'converted' and province = '北京' and exam_type = '高考'")
def dom_retrieve_docs(v: Views, index: str = "province_beijing", limit: int | None = None) -> DataFrame:
    """Converted documents of an index by id; an unknown name is no restriction."""
    d = _docs(v).where("status = 'converted'").where(INDEXES.get(index, "true")).select("doc_id", "subject", "province").orderBy("doc_id")
    return d if limit is None else d.limit(relational.clamp(limit, 0, 2**31 - 1))


@ask("st_stale_log", "practice", f"""select * from (select task, stale_since, due as recovered_at from (select email as task, ts as stale_since, make_timestamp((cast(ceil(epoch_us(ts) / 1000) as bigint) + 1800000) * 1000) as due, hint, lead(ts) over (partition by email order by ts, id) as next from practice where ts <= {NOW}) a
  where not hint and case when next is null then due <= {NOW} else due < next end) b""")
def st_stale_log(v: Views, patience_s: int = 1800) -> DataFrame:
    """Tasks that stayed in work for half an hour, over the log that the stream with timers reads."""
    log = v.practice.select(F.col("email").alias("task"), "id", F.when(F.col("hint"), "completed").otherwise(timers.WORKING).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return timers.recovered_table(log, F.expr(NOW), patience_s).select("task", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("stale_since", "recovered_at")])
