"""Migrations: numbered steps that turn tables into new ones, each written before the next begins, with a ledger that says which are done.

A run that was broken at any step goes on after the last finished one: a step's tables are written first (over what a broken try left), its line in the ledger
last, so a step without a line is done again from the tables before it. The steps here are those of the learning tables: typed columns out of JSON, a table of
question and point, practice records, columns of the paper, repeated rows, rows that refer to nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
LEDGER = "version int, name string, tables array<string>"


class Step(NamedTuple):
    version: int
    name: str
    run: Callable[[Tables], Tables]


def ledger(spark: SparkSession, folder: str) -> list:
    """The lines of finished steps, in order; one for each step, so they fit the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(spark.read.schema(LEDGER).parquet(f"{folder}/ledger").collect())


def migrate(spark: SparkSession, folder: str, steps: list[Step], tables: Tables) -> Tables:
    """The tables after all steps. Versions must be distinct, and a finished step keeps its name; else ValueError."""
    if len({s.version for s in steps}) < len(steps):
        raise ValueError("two steps have one version")
    done, now = {x.version: x for x in ledger(spark, folder)}, dict(tables)
    for s in sorted(steps, key=lambda s: s.version):
        at = f"{folder}/{s.version:04d}"
        if s.version in done and done[s.version].name != s.name:
            raise ValueError(f"step {s.version} was done as {done[s.version].name}")
        if s.version in done:
            names = done[s.version].tables
        else:
            made = s.run(dict(now))
            for name, df in made.items():
                df.write.mode("overwrite").parquet(f"{at}/{name}")
            names = sorted(made)
            spark.createDataFrame([(s.version, s.name, names)], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        now |= {name: spark.read.parquet(f"{at}/{name}") for name in names}
    return now


#: How JSON texts begin.
_ANY, _OBJECT, _LIST = r'^\s*[\[{"\-0-9tfn]', r"^\s*\{", r"^\s*\["


def parsed(text: Column, begins: str = _ANY) -> Column:
    """The value of a JSON text; null for what isn't JSON or begins otherwise. Such texts aren't tried, as the parser is slow where it fails."""
    return F.when(text.rlike(begins), F.try_parse_json(text))


def parse_int(text: Column) -> Column:
    """The integer that a text begins with, after blanks; null where it begins with none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1).try_cast("long")


# fixed values: names of the subjects in both languages
SUBJECTS = {"数学": "math", "语文": "chinese", "英语": "english", "物理": "physics", "化学": "chemistry", "政治": "politics", "生物": "biology", "历史": "history", "地理": "geography"}


def subject_key(name: Column) -> Column:
    """The key of a subject's name; a key or an unknown name stays."""
    known = F.create_map(*[F.lit(x) for p in SUBJECTS.items() for x in p])
    return F.coalesce(F.try_element_at(known, name), name)


def subject_name(key: Column) -> Column:
    """The name of a subject's key; a name or an unknown key stays."""
    known = F.create_map(*[F.lit(x) for k, v in SUBJECTS.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(known, key), key)


def _add(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that the table lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def typed(df: DataFrame, data: str = "data") -> DataFrame:
    """Fill subject_code, knowledge_point_id, difficulty, question_id, session_id, user_answer and correct_answer from a column of JSON objects.

    What isn't a JSON object, and each value that is missing, leaves a column as it was. A subject counts if it is known in either language, a point if it is a
    text (the point itself, else the first of a list); difficulty is the integer it begins with or 0, kept from 1 to 5; answers that aren't texts stay JSON."""
    df = _add(df, subject_code="string", knowledge_point_id="string", difficulty="int", question_id="long", session_id="string", user_answer="string", correct_answer="string")
    paths = ["subject", "knowledge_point_id", "knowledge_points[0]", "difficulty", "question_id", "session_id", "user_answer", "correct_answer"]
    # each value is looked up once, and is a column of its own before its kind and text are asked for
    parts = {f"_v_{p}": F.try_variant_get("_v", f"$.{p}", "variant") for p in paths}
    part = lambda path: F.col(f"`_v_{path}`")
    text = lambda path: F.try_variant_get(part(path), "$", "string")
    kind = lambda path: F.schema_of_variant(part(path))
    truthy = lambda path: F.when(part(path).isNotNull() & ~kind(path).isin("VOID") & ~F.coalesce(text(path), F.lit("x")).isin("", "0", "false"), True)
    keys = [F.lit(x) for x in SUBJECTS.values()]
    subject = subject_key(text("subject"))
    point, first = (F.when(truthy(p) & (kind(p) == "STRING"), text(p)) for p in ("knowledge_point_id", "knowledge_points[0]"))
    return df.withColumn("_v", parsed(F.col(data), _OBJECT)).withColumns(parts).withColumns({
        "subject_code": F.coalesce(F.when(subject.isin(*keys), subject), "subject_code"),
        "knowledge_point_id": F.coalesce(F.when(truthy("knowledge_point_id"), point).otherwise(first), "knowledge_point_id"),
        "difficulty": F.coalesce(F.when(part("difficulty").isNotNull() & (kind("difficulty") != "VOID"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(parse_int(text("difficulty")), F.lit(0)))).cast("int")), "difficulty"),
        "question_id": F.coalesce(F.when(truthy("question_id"), parse_int(text("question_id"))), "question_id"),
        **{c: F.coalesce(F.when(truthy(c), text(c)), c) for c in ("session_id", "user_answer", "correct_answer")},
    }).drop("_v", *parts)


def points_of(questions: DataFrame, key: str, data: str) -> DataFrame:
    """(question_id, knowledge_point_id), each pair once: the texts, or the ids of the objects, of a JSON list or of a single one; what isn't JSON has none."""
    d = questions.select(F.col(key).alias("question_id"), parsed(F.col(data)).alias("_v"), F.col(data).rlike(_LIST).alias("_list"))
    items = F.when(F.col("_list"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    name = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.id", "string"))
    # inside the list, as conditions on exploded rows would move below and parse every text again
    return d.select("question_id", F.explode(F.filter(F.transform(items, name), lambda x: x != "")).alias("knowledge_point_id")).distinct()


def first_of_each(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """The row with the smallest key of each group, nulls being one group; the rest goes. A semi-join, so that no row is sorted whole."""
    return df.join(df.groupBy(*by).agg(F.min(key).alias(key)).select(key), key, "left_semi").select(*df.columns)


def without_orphans(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is null or known."""
    return df.sparkSession.sql(f"select d.* from {{df}} d where d.`{column}` is null or exists (select 1 from {{known}} k where k.`{key}` = d.`{column}`)", df=df, known=known)


def _practice(t: Tables) -> Tables:
    done = t["sessions"].where("status = 'completed'").select(F.col("id").alias("session_id"), "email", F.col("subject").alias("_subject"))
    d = t["wrong"].join(done, ["session_id", "email"])
    return {"practice": d.select(F.col("id").alias("wrong_id"), "email", "question_id", F.col("_subject").alias("subject_code"), "knowledge_point_id", "difficulty", F.lit(0).alias("is_correct"), "user_answer", "correct_answer", "session_id")}


def _of_paper(t: Tables) -> Tables:
    q = _add(t["questions"], subject_code="string", province_code="long", year="int")
    p = t["papers"].select(F.col("id").alias("paper_id"), F.col("subject").alias("_s"), F.col("province").alias("_p"), F.col("yr").alias("_y")).where("paper_id is not null")
    new = F.col("subject_code").isNull() & F.col("_s").isNotNull()
    j = q.join(p, "paper_id", "left").withColumns({"province_code": F.when(new, F.col("_p")).otherwise(F.col("province_code")), "year": F.when(new, F.col("_y")).otherwise(F.col("year")), "subject_code": F.coalesce("subject_code", "_s")})
    return {"questions": j.select(*q.columns)}


#: wrong(id, email, data), questions(id, paper_id, question_number, knowledge_points), papers(id, province, yr, subject), sessions(id, email, subject, status)
STEPS = [
    Step(2, "typed_wrong", lambda t: {"wrong": typed(t["wrong"])}),
    Step(4, "points_of_questions", lambda t: {"question_points": points_of(t["questions"], "id", "knowledge_points")}),
    Step(5, "practice_records", _practice),
    Step(7, "columns_of_paper", _of_paper),
    Step(9, "once_each", lambda t: {"wrong": first_of_each(t["wrong"], ["email", "data"], "id"), "questions": first_of_each(t["questions"], ["paper_id", "question_number"], "id")}),
    Step(10, "no_orphans", lambda t: {"wrong": without_orphans(without_orphans(t["wrong"], "question_id", t["questions"], "id"), "session_id", t["sessions"], "id")}),
]
