"""The tutor's operators over the driver's tables. Each oracle is DuckDB SQL written by hand, not derived from the function it checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as documents
from ..operators import asof, context, folds, graph_index, learner, patterns, relational, study, vector
from ..registry import query
from ..sources import files
from ..streaming import online
from .dialect import Duck, Spark, VIEWS, with_views

NOW = "timestamp '2024-01-31 00:00:00'"


class Views:
    """The domain views of one folder as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.d = spark, sf_dir, Spark(sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            need = {"questions": "questions", "sessions": "sessions"}.get(name, name)
            return self.spark.sql(with_views(self.d, need) + f"select * from {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def ask(name: str, views: str, oracle: str | None):
    """Register f(views, **parameters) with its defaults; the oracle may use the domain views it names."""

    def wrap(f):
        text = None if oracle is None else (with_views(Duck(), views) if views else "with _none as (select 1)\n") + oracle
        if text and "walk" in text:
            text = text.replace("with ", "with recursive ", 1)
        query(name, text)(lambda spark, sf_dir, **params: f(Views(spark, sf_dir), **params))
        return f

    return wrap


# --- parameters: filters, pages, sorts -----------------------------------------------------------------------------------
@ask("flt_dynamic", "papers", "select id, province, yr, subject from papers where subject = '1-URGENT' and level = 'O' and province = 3")
def flt_dynamic(v: Views, **equals) -> DataFrame:
    return relational.matching(v.papers, equals or {"subject": "1-URGENT", "level": "O", "province": 3, "yr": None}).select("id", "province", "yr", "subject")


@ask("flt_optional_or", "practice wrong", "select id, subject from wrong where subject in ('click', 'view')")
def flt_optional_or(v: Views, subject: tuple[str, ...] | None = ("click", "view")) -> DataFrame:
    return relational.any_of(v.wrong, "subject", subject).select("id", "subject")


@ask("prj_clamp_param", "rag", "select id from rag order by id limit 50")
def prj_clamp_param(v: Views, limit: int = 500) -> DataFrame:
    return v.rag.select("id").orderBy("id").limit(relational.clamp(limit, 1, 50))


@ask("top_page_meta", "papers", """select 4 as page, 20 as page_size, count(*) as total, (count(*) + 19) // 20 as pages, count(*) > 80 as has_next, true as has_prev from papers""")
def top_page_meta(v: Views, page: int = 4, size: int = 20) -> DataFrame:
    return relational.page_meta(v.papers, page, size)


@ask("top_sort_whitelist", "practice mastery", "select email, kp, score, attempts from mastery order by score asc, email, kp limit 500")
def top_sort_whitelist(v: Views, column: str = "score", descending: bool = False, limit: int = 5000) -> DataFrame:
    return relational.sorted_by(v.mastery.select("email", "kp", "score", "attempts"), column, ["score", "attempts"], descending, limit, 500, ["email", "kp"])


# --- joins ------------------------------------------------------------------------------------------------------------------
@ask("jn_membership", "questions papers sessions", "select s.id as session, x.seq from sessions s join papers p on p.id = s.id and p.subject = s.subject join questions x on x.paper_id = p.id where x.difficulty >= 4")
def jn_membership(v: Views) -> DataFrame:
    answers = v.questions.where("difficulty >= 4").select(F.col("paper_id").alias("session"), "seq")
    allowed = v.papers.select(F.col("id").alias("session"), "subject").join(v.sessions.select(F.col("id").alias("session"), "subject"), ["session", "subject"], "left_semi")
    return answers.join(allowed, "session", "left_semi")


WRONG_TEXT = """, tagged as (select w.id, w.email, w.ts, a.p_name as analysis, split_part(b.p_name, ' ', 1) as word, case when w.id % 5 = 0 then 'Nothing here' else a.p_name end as question
    from wrong w join part a on a.p_partkey = 1 + w.id % 97 join part b on b.p_partkey = 1 + (w.id * 7) % 89),
  points as (select min(p_partkey) as kp, p_name as name, 1 + min(p_partkey) % 5 as difficulty, ['low', 'medium', 'high'][1 + min(p_partkey) % 3] as frequency from part group by p_name),
  words as (select kp, split_part(name, ' ', 1) as keyword, 1 as points from points union all select kp, split_part(name, ' ', 2), 2 from points)
"""


def _notes(v: Views) -> DataFrame:
    """Wrong answers with the question as JSON; every fifth text is no JSON."""
    p = v.part
    a, b = p.select(F.col("p_partkey").alias("_a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("_b"), F.split("p_name", " ")[0].alias("y"))
    w = v.wrong.join(a, 1 + F.col("id") % 97 == F.col("_a")).join(b, 1 + (F.col("id") * 7) % 89 == F.col("_b"))
    data = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Nothing here {"), F.lit("x"))).otherwise(F.to_json(F.struct(F.upper("x").alias("analysis"), F.struct(F.array("y").alias("keywords")).alias("metadata"))))
    return w.select("id", "email", "ts", data.alias("data"), F.when(F.col("id") % 5 == 0, "Nothing here").otherwise(F.col("x")).alias("content"))


def _points(v: Views) -> tuple[DataFrame, DataFrame]:
    k = v.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("kp"))
    k = k.select("kp", "name", (1 + F.col("kp") % 5).alias("difficulty"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (1 + F.col("kp") % 3).cast("int")).alias("frequency"))
    return k, k.select("kp", F.posexplode(F.split("name", " ")).alias("i", "keyword")).select("kp", "keyword", (F.col("i") == 1).alias("core"))


def _weak(v: Views) -> DataFrame:
    k, words = _points(v)
    return study.weak_points(patterns.matched(_notes(v), parse.search_fields(F.col("data")), words, "data"), k, words)


HITS = WRONG_TEXT + """, hits as (select t.email, t.id, t.ts, t.question, w.kp, w.keyword, w.points from tagged t join words w on t.id % 5 <> 0 and (contains(t.analysis, w.keyword) or contains(t.word, w.keyword))),
  each as (select email, id, ts, question, kp, sum(points) as score, count(*) as n from hits group by all),
  weak as (select e.email, e.kp, k.name, k.difficulty, count(*) as errors, cast(sum(e.score) as bigint) as score, avg(e.n / 2.0) as confidence,
    sum(e.score) * (k.difficulty / 3.0) * case k.frequency when 'high' then 1.5 when 'medium' then 1.0 else 0.7 end as weakness from each e join points k on k.kp = e.kp group by e.email, e.kp, k.name, k.difficulty, k.frequency),
  found as (select email, kp, string_agg(distinct keyword, ',' order by keyword) as keywords from hits group by all)
"""


@ask("jn_cross_keyword", "practice wrong", HITS + "select kp, keyword, count(*) as n from hits group by all")
def jn_cross_keyword(v: Views) -> DataFrame:
    _, words = _points(v)
    found = patterns.matched(_notes(v), parse.search_fields(F.col("data")), words, "data")
    return found.select(F.explode("hits").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).join(words.select("kp", "keyword"), "keyword").select("kp", "keyword", "n")


@ask("dom_weak_kp", "practice wrong", HITS + "select w.email, w.kp, errors, score, round(confidence, 6) as confidence, keywords, round(weakness, 6) as weakness from weak w join found f on f.email = w.email and f.kp = w.kp")
def dom_weak_kp(v: Views) -> DataFrame:
    return _weak(v).select("email", "kp", "errors", "score", F.round("confidence", 6).alias("confidence"), F.array_join("keywords", ",").alias("keywords"), F.round("weakness", 6).alias("weakness"))


@ask("dom_weak_report", "practice wrong", HITS + """, newest as (select email, kp, id, question, row_number() over (partition by email, kp order by ts desc, id desc) as r from each),
  samples as (select email, kp, string_agg(id || ':' || question, '|' order by r) as samples from newest where r <= 3 group by all)
  select w.email, w.kp, w.name, errors, floor(confidence * 100 + 0.5) / 100 as avg_confidence, floor(round(weakness * 10, 6) + 0.5) / 10 as weakness_index, s.samples from weak w join samples s on s.email = w.email and s.kp = w.kp""")
def dom_weak_report(v: Views) -> DataFrame:
    s = F.array_join(F.transform("samples", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["content"])), "|")
    return _weak(v).select("email", "kp", "name", "errors", (F.floor(F.col("confidence") * 100 + 0.5) / 100).alias("avg_confidence"), (F.floor(F.round(F.col("weakness") * 10, 6) + 0.5) / 10).alias("weakness_index"), s.alias("samples"))


@ask("jn_fuzzy_bidir", "", """, labels as (select p_partkey as node, p_type || ' ' || p_name as label from part), words as (select distinct lower(p_type) as word from part union select distinct p_name from part union select 'big small ring of everything')
  select node, count(*) as n from labels join words on contains(lower(label), word) or contains(word, lower(split_part(label, ' ', 2))) group by node""")
def jn_fuzzy_bidir(v: Views) -> DataFrame:
    """Nodes with keywords that hold the node's own word, or are held by its label."""
    p = v.part
    words = p.select(F.lower("p_type").alias("word")).union(p.select("p_name")).union(v.spark.range(0, 1, 1, 1).select(F.lit("big small ring of everything"))).distinct()
    nodes = p.select(F.col("p_partkey").alias("node"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("label"), F.split("p_name", " ")[0].alias("own"))
    return patterns.mentions(nodes, "node", words, F.col("label"), F.col("own"))


@ask("dom_node_questions", "questions", """, nodes as (select min(p_partkey) as node, p_name as label from part group by p_name), asked as (select x.paper_id, x.seq, split_part(p.p_name, ' ', 2) as word from questions x join part p on p.p_partkey = x.kp)
  select n.node, count(*) as questions from nodes n join asked a on contains(n.label, a.word) or contains(a.word, n.label) group by n.node""")
def dom_node_questions(v: Views) -> DataFrame:
    """Questions whose keyword a node's label holds, or that holds the label; distinct keywords are counted before they meet the nodes."""
    p = v.part
    nodes = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("node"))
    word = v.questions.join(p.select(F.col("p_partkey").alias("kp"), F.split("p_name", " ")[1].alias("word")), "kp").groupBy("word").agg(F.count(F.lit(1)).alias("weight"))
    return patterns.mentions(nodes, "node", word, F.col("label"), F.col("label"), "weight").select("node", F.col("n").alias("questions"))


# --- learners -----------------------------------------------------------------------------------------------------------------
@ask("dom_ability", "users sessions", """, r as (select email, correct_count / question_count * (0.5 + 0.5 * avg_difficulty / 5) as p, row_number() over (partition by email order by started_at desc, id desc) - 1 as i from sessions),
  s as (select email, sum(p / (1 + 0.3 * i)) / sum(1 / (1 + 0.3 * i)) as n from r where i < 10 group by email)
  select u.email, coalesce(cast(floor(round(n * 4 + 1, 9) + 0.5) as double), cast(3.0 as double)) as ability from users u left join s on s.email = u.email""")
def dom_ability(v: Views, recent: int = 10) -> DataFrame:
    return study.ability(v.users, v.sessions, recent)


@ask("dom_adaptive", "users practice mastery", """, m as (select email, 1.0 * count(*) filter (where score < 0.6) / count(*) as ratio, 1 + 0.5 * (email % 10) as able from mastery group by email),
  a as (select *, case when ratio > 0.6 then greatest(1.5, able - 0.5) when ratio < 0.2 then least(4.5, able + 0.5) else able end as x from m),
  b as (select *, case when x < 2 then 1.5 + (x - 1) * 0.5 when x > 4 then 4 + (x - 4) * 0.5 else x end as y from a)
  select email, cast(floor(round(cast(least(greatest(y, 1.5), 4.5) as double) * 10, 9) + 0.5) / 10 as double) as difficulty from b""")
def dom_adaptive(v: Views) -> DataFrame:
    m = v.mastery.groupBy("email").agg((F.count_if(F.col("score") < 0.6) / F.count(F.lit(1))).alias("ratio"))
    return m.select("email", study.adaptive_difficulty(1 + 0.5 * (F.col("email") % 10), F.col("ratio")).alias("difficulty"))


@ask("dom_distribution", "users", """, g as (select email, case email % 4 when 0 then 2.0 when 1 then 3.0 when 2 then 3.5 else 5.0 end as d, [60, 90, 120, 150, 180][1 + email % 5] as t from users),
  b as (select *, case when d <= 2 then 12 when d <= 3 then 8 when d <= 4 then 5 else 3 end as e, case when d <= 2 then 6 when d <= 4 then 8 else 6 end as m, case when d <= 2 then 2 when d <= 3 then 4 when d <= 4 then 7 else 11 end as h from g),
  c as (select email, case when t < 96 then greatest(4, e * 7 // 10) when t > 144 then e * 12 // 10 else e end as e, case when t < 96 then greatest(3, m * 7 // 10) when t > 144 then m * 12 // 10 else m end as m, case when t < 96 then greatest(1, h * 7 // 10) else h end as h from b)
  select email, greatest(e, 2) as easy, greatest(m, 2) as medium, greatest(h, 1) as hard, e + m + h + 7 as total from c""")
def dom_distribution(v: Views) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in (2.0, 3.0, 3.5, 5.0)]), (1 + F.col("email") % 4).cast("int"))
    minutes = F.element_at(F.array(*[F.lit(x) for x in (60, 90, 120, 150, 180)]), (1 + F.col("email") % 5).cast("int"))
    return v.users.select("email", study.distribution(level, minutes).alias("x")).select("email", "x.*")


def _ripple(v: Views, up: bool) -> DataFrame:
    """Points answered in the last week of the log, with the score they have now."""
    m = v.mastery.select("email", "kp", F.floor(F.col("score") * 100 + 0.5).alias("score"), "last_at")
    return study.ripple(m, m.where("last_at >= timestamp '2024-01-24 00:00:00'"), v.edges, up)


RIPPLE = ", m as (select email, kp, cast(floor(score * 100 + 0.5) as bigint) as score, last_at >= timestamp '2024-01-24 00:00:00' as fresh from mastery)"


@ask("dom_ripple_up", "practice mastery edges", RIPPLE + """, moved as (select m.email, e.dst as kp, 2 * count(*) as plus from m join edges e on e.src = m.kp where m.fresh and m.score >= 80 group by m.email, e.dst)
  select v.email, v.kp, m.score as old, least(100, coalesce(m.score, 0) + v.plus) as new from moved v left join m on m.email = v.email and m.kp = v.kp""")
def dom_ripple_up(v: Views) -> DataFrame:
    return _ripple(v, True)


@ask("dom_ripple_down", "practice mastery edges", RIPPLE + """, moved as (select m.email, e.src as kp, 5 * count(*) as minus from m join edges e on e.dst = m.kp where m.fresh and m.score <= 40 group by m.email, e.src)
  select v.email, v.kp, m.score as old, greatest(0, coalesce(m.score, 0) - v.minus) as new from moved v left join m on m.email = v.email and m.kp = v.kp""")
def dom_ripple_down(v: Views) -> DataFrame:
    return _ripple(v, False)


@ask("dom_srs_complete", "practice", """, state as (select email, kp, cast(floor(100.0 * count(*) filter (where is_correct) / count(*) + 0.5) as bigint) as score, cast(2.5 as double) as ease, cast(count(*) % 3 as bigint) as days from practice where ts < timestamp '2024-01-15 00:00:00' group by email, kp),
  r as (select email, kp, id, ts, case when not is_correct then case when time_ms > 30000 then 2 else 1 end when time_ms < 10000 then 5 when time_ms < 30000 then 4 when time_ms < 60000 then 3 else 2 end as q,
    case when not is_correct then -15 when time_ms > 60000 then 5 else 12 end as gain, row_number() over (partition by email, kp order by ts, id) as i from practice where ts >= timestamp '2024-01-15 00:00:00'),
  walk as (select email, kp, cast(0 as bigint) as i, cast(null as bigint) as id, cast(null as date) as d, 0 as q, score as om, score as nm, days as od, days as nd, ease as oe, ease as ne from state union all
    select w.email, w.kp, r.i, r.id, cast(r.ts as date), r.q, w.nm, greatest(0, least(100, w.nm + r.gain)), w.nd,
      cast(least(365, case when r.q < 3 or w.nd = 0 then 1 when w.nd = 1 then 6 else floor(w.nd * greatest(cast(1.3 as double), w.ne + cast(0.1 as double) - (5 - r.q) * (cast(0.08 as double) + (5 - r.q) * cast(0.02 as double))) + 0.5) end) as bigint),
      w.ne, round(greatest(cast(1.3 as double), w.ne + cast(0.1 as double) - (5 - r.q) * (cast(0.08 as double) + (5 - r.q) * cast(0.02 as double))), 2) from walk w join r on r.email = w.email and r.kp = w.kp and r.i = w.i + 1)
  select email, kp, id, q as quality, om as old_mastery, nm as new_mastery, od as old_interval, nd as new_interval, cast(round(oe * 100) as bigint) as old_ease, cast(round(ne * 100) as bigint) as new_ease, cast(d + cast(nd as int) as date) as next_review from walk where i > 0""")
def dom_srs_complete(v: Views) -> DataFrame:
    before = v.practice.where("ts < timestamp '2024-01-15 00:00:00'").groupBy("email", "kp").agg(F.floor(100 * F.count_if("is_correct") / F.count(F.lit(1)) + 0.5).alias("score"), (F.count(F.lit(1)) % 3).alias("days"))
    return study.complete_reviews(before.withColumn("ease", F.lit(2.5)), v.practice.where("ts >= timestamp '2024-01-15 00:00:00'"))


@ask("dom_phases", "users practice wrong", HITS + """, top as (select email, kp, name, difficulty, row_number() over (partition by email order by weakness desc, kp) as r from weak),
  picked as (select email, 1 as week, 'easy' as level, name, r, row_number() over (partition by email order by r) as i, 3 as most from top where difficulty <= 3 union all
    select email, 2, 'medium', name, r, row_number() over (partition by email order by r), 3 from top where difficulty between 3 and 4 union all select email, 3, 'hard', name, r, row_number() over (partition by email order by r), 2 from top where difficulty >= 4),
  lists as (select email, week, level, string_agg(name, ',' order by i) as topics from picked where i <= most group by all),
  planned as (select email, week, level, topics, row_number() over (partition by email order by week) as phase from lists),
  final as (select email, max(phase) + 1 as week, 'comprehensive' as level, max(phase) + 1 as phase from planned group by email)
  select email, phase, week, level, topics from planned union all select f.email, f.phase, f.week, f.level, t.topics from final f join (select email, string_agg(name, ',' order by r) as topics from top where r <= 5 group by email) t on t.email = f.email
  union all select email, g.week, g.week, g.level, '' from users cross join (values (1, 'medium'), (2, 'hard')) g(week, level) where email not in (select email from top)""")
def dom_phases(v: Views) -> DataFrame:
    return study.phases(v.users, _weak(v)).withColumn("topics", F.array_join("topics", ","))


DASH = """, shares as (select email, subject, count(*) as n, floor(1000.0 * count(*) / sum(count(*)) over (partition by email) + 0.5) / 10 as share from wrong group by email, subject),
  days as (select email, cast(ts as date) as day, count(*) as n, avg(case when is_correct then cast(1 as double) else 0 end) as accuracy, row_number() over (partition by email order by cast(ts as date) desc) as r from practice group by email, cast(ts as date)),
  points as (select distinct kp from practice), grid as (select email, kp from users, points),
  w as (select email, kp, count(*) as n from wrong group by email, kp), p as (select email, kp, count(*) as n, avg(case when is_correct then cast(1 as double) else 0 end) as acc from practice group by email, kp),
  listed as (select g.email, g.kp, coalesce(w.n, 0) as wrong_count, coalesce(p.n, 0) as practice_count, coalesce(p.acc, 0) as accuracy, row_number() over (partition by g.email order by w.n desc nulls first, p.acc asc nulls last, g.kp) as position
    from grid g left join w on w.email = g.email and w.kp = g.kp left join p on p.email = g.email and p.kp = g.kp),
  weak as (select *, case when wrong_count >= 5 then 'critical' when wrong_count >= 3 then 'high' when wrong_count >= 1 then 'medium' when accuracy > 0 and accuracy < 0.6 then 'warning' else 'normal' end as level from listed where position <= 10)
"""


SAID = """, f as (select u.email, (select count(*) from weak k where k.email = u.email and level = 'critical') as c, (select share from shares s where s.email = u.email and share > 30 order by subject limit 1) as s,
    (select count(*) from weak k where k.email = u.email and practice_count >= 3 and accuracy > 0 and floor(accuracy * 1000 + 0.5) < 700) as l from users u),
  said as (select email, 1 as o, 'critical' as type, cast(c as double) as n from f where c > 0 union all select email, 2, 'warning', cast(s as double) from f where s is not null union all select email, 3, 'info', cast(l as double) from f where l > 0 union all
    select email, 4, 'success', cast(0 as double) from f where c = 0 and s is null and l = 0)
"""


def _dashboard(v: Views, kp_column: str = "kp") -> dict[str, DataFrame]:
    return study.dashboard(v.users, v.wrong, v.practice, v.practice.select("kp").distinct())


@ask("dom_dashboard", "users practice wrong", DASH + SAID + """select u.email, coalesce(w.n, 0) as wrong_questions, coalesce(d.n, 0) as practised, coalesce(d.days, 0) as days, round(coalesce(d.acc, 0), 6) as accuracy, s.subjects, m.months, y.daily, k.weak_points, g.suggestions from users u
  left join (select email, count(*) as n from wrong group by email) w on w.email = u.email left join (select email, cast(sum(n) as bigint) as n, count(*) as days, avg(accuracy) as acc from days where r <= 7 group by email) d on d.email = u.email
  left join (select email, string_agg(subject || ':' || n, ',' order by subject) as subjects from shares group by email) s on s.email = u.email
  left join (select email, string_agg(month || ':' || c || '/' || n, ',' order by month) as months from (select email, strftime(ts, '%Y-%m') as month, count(*) filter (where is_correct) as c, count(*) as n from practice group by all) group by email) m on m.email = u.email
  left join (select email, string_agg(day || ':' || n || ':' || cast(floor(accuracy * 1000 + 0.5) as bigint), ',' order by day) as daily from days where r <= 7 group by email) y on y.email = u.email
  left join (select email, string_agg(kp || ':' || level, ',' order by position) as weak_points from weak group by email) k on k.email = u.email
  left join (select email, string_agg(type || ':' || cast(floor(n * 10 + 0.5) as bigint), ',' order by o) as suggestions from said group by email) g on g.email = u.email""")
def dom_dashboard(v: Views) -> DataFrame:
    """All parts of every learner's dashboard in a row each; shares in tenths, accuracies of a day in thousandths. One grouping gathers the lists, each bounded for a
    learner (subjects, months, seven days, ten points), and the figures that suggestions follow from, so the weakest points are found once."""
    d = _dashboard(v)
    lists = {
        "subjects": (d["subjects"], F.lit(0), "subject", ("subject", "n"), {"share": F.when(F.col("share") > 30, F.col("share"))}), "months": (d["monthly"], F.lit(0), "month", ("month", F.concat("correct", F.lit("/"), "n")), {}),
        "daily": (d["daily"], F.lit(0), "day", ("day", "n", F.floor(F.col("accuracy") * 1000 + 0.5)), {}), "weak_points": (d["weak_points"], F.col("position"), "kp", ("kp", "level"), {"critical": study.critical(), "low": study.low()}),
    }
    rows = [f.select("email", F.lit(name).alias("list"), F.struct(place.cast("long").alias("place"), F.col(by).cast("string").alias("by"), F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in item]).alias("t")).alias("x"), *[c.alias(n) for n, c in more.items()])
            for name, (f, place, by, item, more) in lists.items()]
    items = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.col("x")))), lambda x: x["t"])
    gathered = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("email").agg(
        *[F.nullif(F.array_join(items(name), ","), F.lit("")).alias(name) for name in lists], F.count_if("critical").alias("critical"), F.count_if("low").alias("low"), F.min_by("share", F.when(F.col("share").isNotNull(), F.col("x.by"))).alias("share"))
    told = F.array_join(F.transform(study.said("critical", "share", "low"), lambda x: F.concat_ws(":", x["type"], F.floor(x["n"] * 10 + 0.5).cast("string"))), ",")
    return d["overview"].withColumn("accuracy", F.round("accuracy", 6)).join(gathered, "email", "left").withColumn("suggestions", told).drop("critical", "low", "share")


@ask("dom_weak_level", "users practice wrong", DASH + "select email, kp, level from weak")
def dom_weak_level(v: Views) -> DataFrame:
    return _dashboard(v)["weak_points"].select("email", "kp", "level")


@ask("dom_suggestions", "users practice wrong", DASH + SAID + "select email, row_number() over (partition by email order by o) as position, type, n from said")
def dom_suggestions(v: Views) -> DataFrame:
    return _dashboard(v)["suggestions"]


def _stats(v: Views) -> DataFrame:
    gap = F.datediff("d", F.lag("d").over(_by_day())) == 1
    runs = v.checkins.withColumn("gap", F.coalesce(gap, F.lit(False))).withColumn("streak", F.when(F.col("gap"), 1 + F.sum(F.col("gap").cast("int")).over(_by_day())).otherwise(1))
    c = runs.groupBy("email").agg(F.count(F.lit(1)).alias("login_days"), F.max("streak").alias("streak_days"))
    w = v.wrong.groupBy("email").agg(F.count(F.lit(1)).alias("total_errors"))
    s = v.sessions.where("question_count > 0").groupBy("email").agg(F.count(F.lit(1)).alias("total_exams"), F.max(F.floor(1000 * F.col("correct_count") / F.col("question_count") + 0.5) / 10).alias("best_accuracy"), F.countDistinct("subject").alias("subject_count"))
    p = v.practice.groupBy("email").agg(F.sum(F.when(F.col("is_correct"), 10).otherwise(2)).alias("total_points"))
    out = v.users.select("email")
    for part in (c, w, s, p):
        out = out.join(part, "email", "left")
    return out


def _by_day():
    from pyspark.sql import Window

    return Window.partitionBy("email").orderBy("d")


@ask("dom_badges", "users practice wrong sessions checkins", """, k as (select email, d, coalesce(d - lag(d) over (partition by email order by d) = 1, false) as gap from checkins),
  c as (select email, count(*) as login_days, max(streak) as streak_days from (select email, case when gap then 1 + sum(case when gap then 1 else 0 end) over (partition by email order by d) else 1 end as streak from k) group by email),
  w as (select email, count(*) as total_errors from wrong group by email), s as (select email, count(*) as total_exams, max(floor(1000.0 * correct_count / question_count + 0.5) / 10) as best_accuracy, count(distinct subject) as subject_count from sessions group by email),
  p as (select email, sum(case when is_correct then 10 else 2 end) as total_points from practice group by email),
  u as (select u.email, c.login_days, c.streak_days, w.total_errors, s.total_exams, s.best_accuracy, s.subject_count, p.total_points from users u left join c on c.email = u.email left join w on w.email = u.email left join s on s.email = u.email left join p on p.email = u.email),
  b as (select email, badge, cast(coalesce(current, 0) as double) as current, cast(target as double) as target from (
    select email, 'first_login' as badge, login_days as current, 1 as target from u union all select email, 'week_streak', streak_days, 7 from u union all select email, 'month_streak', streak_days, 30 from u union all
    select email, 'first_error', total_errors, 1 from u union all select email, 'error_50', total_errors, 50 from u union all select email, 'error_200', total_errors, 200 from u union all select email, 'exam_1', total_exams, 1 from u union all
    select email, 'exam_10', total_exams, 10 from u union all select email, 'exam_50', total_exams, 50 from u union all select email, 'accuracy_80', best_accuracy, 80 from u union all select email, 'accuracy_95', best_accuracy, 95 from u union all
    select email, 'points_100', total_points, 100 from u union all select email, 'points_1000', total_points, 1000 from u union all select email, 'all_subjects', subject_count, 6 from u))
  select email, badge, current, target, cast(least(100, floor(current / target * 100)) as int) as percent, current >= target as earned from b""")
def dom_badges(v: Views) -> DataFrame:
    return study.badges(_stats(v))


@ask("dom_trend_summary", "papers questions", """, x as (select p.province, p.yr, q.kp, q.qtype, q.difficulty from questions q join papers p on p.id = q.paper_id),
  t as (select province, string_agg(cast(kp as varchar), ',' order by r) as top_points from (select province, kp, row_number() over (partition by province order by count(*) desc, kp) as r from x group by province, kp) where r <= 3 group by province),
  k as (select province, qtype, n from (select province, qtype, count(*) as n, row_number() over (partition by province order by count(*) desc, qtype desc) as r from x group by province, qtype) where r = 1),
  y as (select province, avg(d) as d from (select province, yr, avg(difficulty) as d from x group by province, yr) group by province)
  select p.province, count(distinct p.yr) as years, count(*) as papers, any_value(t.top_points) as top_points, any_value(k.qtype) as main_type, any_value(k.n) as main_count, round(any_value(y.d), 4) as avg_difficulty,
    case when any_value(y.d) < 2.5 then 'easy' when any_value(y.d) < 3.5 then 'medium' when any_value(y.d) is not null then 'hard' end as label
  from papers p left join t on t.province = p.province left join k on k.province = p.province left join y on y.province = p.province group by p.province""")
def dom_trend_summary(v: Views) -> DataFrame:
    return study.trend_summary(v.papers, v.questions)


def _tasks(v: Views) -> DataFrame:
    return v.practice.select("id", F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (1 + F.col("id") % 4).cast("int")).alias("status"), (F.col("id") % 3).alias("retry_count"), F.col("ts").alias("updated_at"))


@ask("dom_task_transition", "practice", f"""select id, case when id % 4 <> 1 or id % 5 = 0 then ['pending', 'processing', 'completed', 'failed'][1 + id % 4] when is_correct then 'completed' when id % 3 < 2 then 'pending' else 'failed' end as status,
  case when id % 4 = 1 and id % 5 <> 0 and not is_correct and id % 3 < 2 then id % 3 + 1 else id % 3 end as retry_count, case when id % 4 = 1 and id % 5 <> 0 then {NOW} else ts end as updated_at from practice""")
def dom_task_transition(v: Views) -> DataFrame:
    return study.finish_tasks(_tasks(v), v.practice.where("id % 5 <> 0").select("id", F.col("is_correct").alias("ok")), F.expr(NOW))


@ask("st_stale", "practice", "select id, case when id % 4 = 1 and ts < timestamp '2024-01-20 11:55:00' then 'pending' else ['pending', 'processing', 'completed', 'failed'][1 + id % 4] end as status from practice")
def st_stale(v: Views, minutes: int = 5) -> DataFrame:
    return study.recover_stale(_tasks(v), F.expr("timestamp '2024-01-20 12:00:00'"), minutes).select("id", "status")


@ask("dom_job_status", "practice", """, c as (select email as job, ts, id, case when subject = 'view' then 'running' when subject in ('click', 'error') then 'completed' when subject = 'signup' then 'failed' else 'pending' end as status,
    case when id % 2 = 0 then time_ms end as processed, case when id % 3 = 0 then kp end as failed, case when subject = 'signup' then 'error ' || id end as error from practice)
  select job, arg_max(status, ts) as status, max(ts) as updated_at, arg_max(processed, ts) filter (where processed is not null) as processed, arg_max(failed, ts) filter (where failed is not null) as failed, arg_max(error, ts) filter (where error is not null) as error,
    max(ts) filter (where status = 'running') as started_at, max(ts) filter (where status in ('completed', 'failed')) as completed_at from c group by job""")
def dom_job_status(v: Views) -> DataFrame:
    s = F.col("subject")
    status = F.when(s == "view", "running").when(s.isin("click", "error"), "completed").when(s == "signup", "failed").otherwise("pending")
    return study.job_states(v.practice.select(F.col("email").alias("job"), "ts", "id", status.alias("status"), F.when(F.col("id") % 2 == 0, F.col("time_ms")).alias("processed"), F.when(F.col("id") % 3 == 0, F.col("kp")).alias("failed"), F.when(s == "signup", F.concat(F.lit("error "), F.col("id").cast("string"))).alias("error")))


EXAM = """, a as (select x.paper_id as session, p.owner as email, x.seq as question, x.score, case when x.seq % 4 = 0 then null else x.score end as worth, case when x.qtype = 'N' then ' ' || lower(x.qtype) when x.qtype = 'A' then '' else 'wrong' end as answer, x.qtype as right_answer
    from questions x join papers p on p.id = x.paper_id where x.difficulty <> 5),
  g as (select *, lower(trim(answer)) = lower(trim(right_answer)) and trim(answer) <> '' as ok, coalesce(worth, 5) as points from a)
"""


def _exam(v: Views) -> dict[str, DataFrame]:
    q = v.questions
    questions = q.select(F.concat_ws("-", "paper_id", "seq").alias("question"), "paper_id", F.when(F.col("difficulty") == 5, "other").otherwise("own").alias("subject"), F.col("qtype").alias("answer"), F.when(F.col("seq") % 4 != 0, F.col("score")).alias("score"))
    answers = q.select(F.col("paper_id").alias("session"), F.concat_ws("-", "paper_id", "seq").alias("question"), F.when(F.col("qtype") == "N", F.concat(F.lit(" "), F.lower("qtype"))).when(F.col("qtype") == "A", "").otherwise("wrong").alias("answer"))
    sessions = v.papers.select(F.col("id").alias("session"), F.col("owner").alias("email"), F.lit("own").alias("subject"))
    known = q.where("seq = 1").join(v.papers.select(F.col("id").alias("paper_id"), F.col("owner").alias("email")), "paper_id").select("email", F.concat_ws("-", "paper_id", "seq").alias("question"))
    return study.grade_exam(sessions, answers, questions, known)


@ask("dom_exam_grade", "papers questions", EXAM + "select session, email, count(*) as questions, count(*) filter (where ok) as correct, cast(coalesce(sum(points) filter (where ok), 0) as bigint) as earned, cast(sum(points) as bigint) as total, floor(1000.0 * coalesce(sum(points) filter (where ok), 0) / sum(points) + 0.5) / 10 as accuracy, cast(floor(coalesce(sum(points) filter (where ok), 0) / 5) + 10 as bigint) as points from g group by session, email")
def dom_exam_grade(v: Views) -> DataFrame:
    return _exam(v)["sessions"]


@ask("dom_exam_wrong", "papers questions", EXAM + "select distinct email, session || '-' || question as question, session from g where not ok and question <> 1")
def dom_exam_wrong(v: Views) -> DataFrame:
    return _exam(v)["wrong"]


CONTEXT = """, asks as (select distinct email, kp from practice), h1 as (select distinct src as kp, dst as prerequisite from edges), h2 as (select distinct a.kp, b.dst as prerequisite from h1 a join edges b on b.src = a.prerequisite),
  hops as (select kp, prerequisite, min(hop) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) group by kp, prerequisite),
  c as (select a.email, a.kp, h.prerequisite, h.hop, m.score, coalesce(m.score < 0.6, false) as is_weak from asks a join hops h on h.kp = a.kp left join mastery m on m.email = a.email and m.kp = h.prerequisite)
"""


def _context(v: Views) -> tuple[DataFrame, DataFrame]:
    """Every learner asks about every point that is in their log."""
    asks = v.practice.select("email", "kp")
    return asks, context.assembled(asks, v.edges, v.mastery)


@ask("dom_context", "practice mastery edges", CONTEXT + "select * from c")
def dom_context(v: Views) -> DataFrame:
    return _context(v)[1]


@ask("dom_depth", "practice mastery edges", CONTEXT + """select a.email, a.kp, case when count(*) filter (where is_weak and score < 0.3) > 0 then 'review_only' when count(*) filter (where is_weak) > 0 then 'guided_review' else 'full_solution' end as depth,
  count(*) filter (where is_weak) = 0 as skip_allowed from asks a left join c on c.email = a.email and c.kp = a.kp group by a.email, a.kp""")
def dom_depth(v: Views) -> DataFrame:
    return context.depth(*_context(v))


@ask("dom_path_plan", "practice mastery edges", CONTEXT + """, w as (select *, row_number() over (partition by email, kp order by score, prerequisite) as r from c where is_weak)
  select email, kp, r as step, 'review' as kind, prerequisite as target from w union all select a.email, a.kp, 1 + (select count(*) from w where w.email = a.email and w.kp = a.kp), 'solve', a.kp from asks a""")
def dom_path_plan(v: Views) -> DataFrame:
    return context.path_plan(*_context(v))


GRAPH = ", asked as (select unnest([1, 2, 3]) as email)"


@ask("dom_graph_export", "practice mastery kps", GRAPH + """select cast(a.email as int) as email, k.id, coalesce(nullif(k.name, ''), cast(k.id as varchar)) as name, coalesce(nullif(k.subject, ''), 'unknown') as subject, k.difficulty, m.score as mastery
  from asked a cross join kps k left join mastery m on m.email = a.email and m.kp = k.id""")
def dom_graph_export(v: Views, learners: tuple = (1, 2, 3)) -> DataFrame:
    """All nodes with the mastery of the learners asked for, null where there is none."""
    return context.nodes(v.kps, v.mastery, learners)


@ask("dom_graph_export_edges", "practice mastery edges kps", """select m.email, e.src, e.dst from edges e join mastery m on m.kp = e.src join mastery n on n.kp = e.dst and n.email = m.email
  union all select null, e.src, e.dst from edges e where e.src in (select id from kps) and e.dst in (select id from kps)""")
def dom_graph_export_edges(v: Views) -> DataFrame:
    """Edges of which a learner's graph has both ends, for every learner, and with a null email those of the whole graph, which all learners are shown."""
    whole = context.shown_edges(v.kps, v.edges).select(F.lit(None).cast("long").alias("email"), "src", "dst")
    return context.held_edges(v.mastery, v.edges).unionByName(whole)


@ask("dom_graph_export_stats", "practice mastery kps edges", GRAPH + """select cast(a.email as int) as email, count(*) as total_nodes, (select count(*) from edges e where e.src in (select id from kps) and e.dst in (select id from kps)) as total_edges,
  count(*) filter (where m.score >= 0.7) as mastered, count(*) filter (where m.score < 0.4) as weak from asked a cross join kps k left join mastery m on m.email = a.email and m.kp = k.id group by a.email""")
def dom_graph_export_stats(v: Views, learners: tuple = (1, 2, 3)) -> DataFrame:
    return context.graph_stats(context.nodes(v.kps, v.mastery, learners), context.shown_edges(v.kps, v.edges))


@ask("dom_ingest_rules", "", ", d as (select doc_id, doc_id % 7 as difficulty, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as n from documents) select doc_id, n >= 10 as long_enough, difficulty between 1 and 5 as difficulty_ok, n >= 10 and difficulty between 1 and 5 as accepted from d")
def dom_ingest_rules(v: Views, least: int = 10) -> DataFrame:
    d = v.documents.select("doc_id", (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")) >= least).alias("long_enough"), (F.col("doc_id") % 7).between(1, 5).alias("difficulty_ok"))
    return d.withColumn("accepted", F.col("long_enough") & F.col("difficulty_ok"))


# --- text ---------------------------------------------------------------------------------------------------------------------
def _case(*values: str) -> Column:
    """One of the values, by doc_id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "][doc_id % " + str(len(values)) + " + 1]"


CASES: dict[str, tuple[dict[str, object], object]] = {}


def cases(name: str, wanted: dict[str, object], f) -> None:
    """What f must give for odd inputs; a test goes through them, the query of this name (in ``text_queries``) goes through a table."""
    CASES[name] = (wanted, f)


def by_cases(name: str, wanted: dict[str, object], f, column: str = "y"):
    """A query over documents where row doc_id gets case doc_id % n, and an oracle that holds what each case must give."""
    cases(name, wanted, f)
    given = list(wanted)
    lit = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    want = ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(wanted.values()))
    query(name, f"select doc_id, w.y as {column} from documents join (values {want}) w(i, y) on w.i = doc_id % {len(given)}")(
        lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", f(_case(*given)).alias(column)))


_join = lambda a: F.array_join(a, "|")
cases("fn_json_array_elems", {'["a","b"]': "a|b", '[{"id":"k1"},"x",{"name":"n"},7]': "k1|x", '"solo"': "solo", '{"id":"obj"}': "obj", "not json": "", "[]": "", " [\"é\", \"\"]": "é", "5": ""}, lambda c: _join(parse.json_array_elements(c)))
cases("fn_search_fields", {'{"clue":"C","analysis":"Ab","other":"z"}': "ab|c", "Plain TEXT": "plain text", '{"metadata":{"keywords":["K1","k2"]},"subject":"S"}': '{"keywords":["k1","k2"]}|s|k1 k2', '{"question":"","solution":"X"}': "x"}, lambda c: _join(parse.search_fields(c)))
_KW, _CORE = ["函数", "导数", "单调性", "极值", "切线", "零点", "切线斜率", "极限"], {"导数"}
by_cases("fn_keyword_match", {
    '{"analysis":"本题考查导数和函数单调性","subject":"数学"}': "4/0.375", '{"analysis":"本题考查光合作用"}': "0/0.0", '{"analysis":"导数单调性极值"}': "4/0.375", '{"analysis":"切线斜率零点"}': "3/0.375",
    "这道题考查导数和函数单调性": "4/0.375", '{"metadata":{"keywords":["导数","函数"]}}': "3/0.25", '{"analysis":"导数单调性极值切线零点"}': "6/0.625"},
    lambda c: F.array_join(F.transform(F.array(parse.keyword_match(parse.search_fields(c), _KW, _CORE)), lambda m: F.concat_ws("/", m["score"].cast("string"), m["confidence"].cast("string"))), ""))
cases("fn_strip_think", {"<think>a <b>c</b> d</think> out ": "out", "x<think>\n1\n</think>y<think>2</think>z": "xyz", "<think>never ends": "<think>never ends", "plain": "plain", "<think>a</think": "<think>a</think"}, parse.strip_think)
cases("fn_strip_code", {"```json\n{\"a\":1}\n```": '{"a":1}', "```JSON {}```": "{}", "a ``` b": "a b", "none": "none"}, parse.strip_code)
cases("fn_json_repair2", {'<think>no</think>```json\n{"a":1}\n```': '{"a":1}', 'Sure: {"a":[1,2,],}': '{"a":[1,2]}', '[1,2]': "[1,2]", "nothing {": None, 'x {"k":"v"} y': '{"k":"v"}', "": None}, parse.lenient_json)
cases("fn_json_repair_cjk", {"得 {“a”：“b”，“c”：1}": '{"a":"b","c":1}', '{"a":1}': '{"a":1}', "none": None, "{‘a’：1}": None}, parse.cjk_json)
cases("fn_unescape", {"a\\nb": "a\nb", "c\\\\d": "c\\d", 'say \\"x\\"': 'say "x"', "\\\\n": "\\\n", "plain": "plain"}, parse.unescape)
cases("fn_citations", {"a[^2^] b [^10^][^2^]": "10|2", "[^x^] [^1]": "", "[^7^]": "7"}, lambda c: _join(parse.citations(c)))
cases("fn_entities", {"**b** and **a** and **b**": "a|b", "no * stars": "", "** x ** **" + "** **".join(f"n{i:02}" for i in range(25)) + "**": "|".join([" x "] + [f"n{i:02}" for i in range(19)])}, lambda c: _join(parse.entities(c)))
by_cases("fn_detect_xss", {"<script>x</script>": True, "JavaScript:alert(1)": True, "<a onclick = 'x'>": True, "data:text/html,x": True, "vbscript:x": True, "expression (x)": True, "plain text": False, "script on the table": False, "": False}, parse.suspicious)
by_cases("fn_detect_province", {"2021年北京卷数学.pdf": "beijing", "陕西语文": "shaanxi", "2023全国甲卷": "national_a", "黑龙江卷": "heilongjiang", "none": None, "内蒙古卷理综": "neimenggu"}, parse.detect_province)
by_cases("fn_detect_subject", {"2021年北京卷数学.pdf": "math", "陕西语文": "chinese", "理综": "comprehensive_science", "生物与化学": "chemistry", "none": None}, parse.detect_subject)
cases("fn_detect_year", {"2021年北京卷": 2021, "x1999": None, "20x 2008": 2008, "none": None, "12020": 2020}, parse.detect_year)
by_cases("fn_path_metadata", {
    "高考/北京/2021年数学真题解析.pdf": "高中,高考,解析版,北京,数学,2021", "zhongkao/上海/语文(空白).doc": "初中,中考,原卷,上海,语文,0", "知识点/高中/物理/1998.md": "高中,未知,知识点,未知,物理,1998", "misc/readme.txt": "未知,未知,真题,未知,未知,0",
    "中考/道德与法治2020答案.pdf": "初中,中考,解析版,未知,政治,2020", "GaoKao/河北/x.pdf": "高中,高考,真题,河北,未知,0"},
    lambda c: F.array_join(F.array(*[parse.path_metadata(c)[k].cast("string") for k in ("stage", "exam_type", "doc_kind", "province", "subject", "year")]), ","))
by_cases("fn_subject_combo", {"physics-chem-bio": "chinese,math,english,physics,chemistry,biology", "geo-hist-pol-2": "chinese,math,english,geography,history,politics", "liberal": "chinese,math,english,politics,history,geography", "nothing": None}, lambda c: F.array_join(parse.subjects_of(c), ","))
by_cases("fn_exam_model", {"jiangsu": "3+1+2", "hainan": "3+3", "xinjiang": "traditional", "beijing": "3+3"}, parse.exam_model)
by_cases("fn_essay_scores", {
    '{"metadata":{"scores":{"content":15,"language":16,"structure":14,"development":10,"total":55}}}': "55 true", '{"metadata":{"scores":{"content":21,"language":0,"structure":0,"development":0,"total":21}}}': "21 false",
    '{"metadata":{"scores":{"content":1,"language":1,"structure":1,"development":1,"total":5}}}': "5 false", '{"metadata":{"scores":{"content":1.5,"language":1.5,"structure":1,"development":1,"total":5}}}': "5 false", "{}": "null false"},
    lambda c: F.concat_ws(" ", F.coalesce(parse.essay_scores(c)["total"].cast("string"), F.lit("null")), parse.essay_scores(c)["valid"].cast("string")))
cases("st_sse", {
    'event: metadata\ndata: {"a":1}\n\nevent: content\ndata: {"content":"He"}\n\nevent: content\ndata: llo\n\nevent: done\ndata: {}\n\n': '{"a":1}/Hello/done', "event: content\ndata: x\n\nevent: error\ndata: no\n\n": "null/x/error", "event: content\ndata: half": "null/half/open", "": "null//open"},
    lambda c: F.concat_ws("/", F.coalesce(parse.tutor_stream(c)["metadata"], F.lit("null")), parse.tutor_stream(c)["content"], parse.tutor_stream(c)["state"]))
cases("fn_vision_content", {"f1,f2": "text\n\n【公式】\nf1\nf2", "": "text"}, lambda c: parse.vision_content(F.lit(" text"), F.when(c != "", F.split(c, ","))))
_IMG = "struct<clue:string,solution:string,analysis:string,metadata:struct<difficulty:int,keywords:array<string>>>"
by_cases("fn_quality_image", {
    '{"clue":"look at the first part","solution":"solve the equation","analysis":"it is about functions","metadata":{"difficulty":3,"keywords":["k"]}}': 100, '{"clue":"请仔细观察题目条件","solution":"x","analysis":""}': 20, "{}": 0,
    '{"clue":"short one","solution":"solve the equation","analysis":"it is about functions","metadata":{"difficulty":9,"keywords":[]}}': 80},
    lambda c: (lambda x: parse.image_quality(x["clue"], x["solution"], x["analysis"], x["metadata"].isNotNull(), x["metadata"]["keywords"], x["metadata"]["difficulty"]))(F.from_json(c, _IMG)))
_EXP = "struct<explanation:string,keyPoints:array<string>,variantProblems:array<string>,similarProblems:array<string>>"
by_cases("fn_quality_explain", {
    '{"explanation":"步骤1 first do this, then the rest of it","keyPoints":["a"],"variantProblems":["b"],"similarProblems":["c"]}': 100, '{"explanation":"步骤1：代入","keyPoints":["a"]}': 45, '{"explanation":"代入","keyPoints":["a"]}': 35, "{}": 0},
    lambda c: (lambda x: parse.explanation_quality(x["explanation"], x["keyPoints"], x["variantProblems"], x["similarProblems"]))(F.from_json(c, _EXP)))
by_cases("fn_select_index", {"数学,北京,中考": "zhongkao_beijing", "数学,上海,高考": "subject_math", "语文,北京,高考": "subject_chinese", "物理,北京,高考": "province_beijing", "物理,河北,中考": "zhongkao_beijing", "物理,河北,高考": "gaokao_all"}, lambda c: parse.select_index(*[F.split(c, ",")[i] for i in range(3)]))


@ask("fn_validate", "", """select doc_id, list_aggregate(list_filter([case when doc_id % 6 in (0, 4) then 'difficulty' end, case when doc_id % 3 <> 0 then 'email' end, case when doc_id % 8 < 6 or doc_id % 8 > 129 then 'password' end, case when length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) = 0 or length(text) > 5000 then 'question' end,
    case when doc_id % 200 > 150 then 'score' end, case when doc_id % 2 = 1 then 'subject' end, case when 1990 + doc_id % 40 not between 2000 and 2025 then 'year' end], lambda x: x is not null), 'string_agg', ',') as broken from documents""")
def fn_validate(v: Views, year_now: int = 2024) -> DataFrame:
    i = F.col("doc_id")
    values = {
        "email": _case("a@b.co", "a b@c.d", "none"), "password": F.repeat(F.lit("x"), (i % 8).cast("int")), "question": F.coalesce("text", F.lit("")), "subject": _case("数学", "maths"), "difficulty": F.element_at(F.array(*map(F.lit, (0, 1, 3, 5, 6, 2))), (i % 6 + 1).cast("int")),
        "score": i % 200, "year": 1990 + i % 40,
    }
    return v.documents.select("doc_id", F.nullif(F.array_join(parse.broken_rules(values, year_now, tuple(values)), ","), F.lit("")).alias("broken"))


@ask("fn_sanitize_html", "", "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as text, regexp_replace(url, '<[^>]*>', '', 'g') as url, 'x' as first_tag, 'bold' as inner_text from pages")
def fn_sanitize_html(v: Views) -> DataFrame:
    p = v.pages.select("page_id", F.col("html").alias("text"), "url", F.array(F.lit("<i>x</i>"), F.col("url")).alias("tags"), F.struct(F.struct(F.lit("<b class='y'>bold</b>").alias("t")).alias("s")).alias("deep"))
    return parse.without_tags(p).select("page_id", "text", "url", F.col("tags")[0].alias("first_tag"), F.col("deep.s.t").alias("inner_text"))


@ask("fn_vec_literal", "rag", "select id, len(embedding) as n, true as same, round(cast(embedding[1] as double), 5) as first from rag")
def fn_vec_literal(v: Views) -> DataFrame:
    e = v.rag.withColumn("t", parse.vector_text(F.col("embedding"))).withColumn("back", parse.vector_of(F.col("t")))
    return e.select("id", F.size("back").cast("long").alias("n"), (F.col("back").cast("array<float>") == F.col("embedding").cast("array<float>")).alias("same"), F.round(F.col("back")[0], 5).alias("first"))


# --- state ----------------------------------------------------------------------------------------------------------------------
LIMIT = """, r as (select email, epoch_us(ts) as t, row_number() over (partition by email order by ts, id) as i from practice),
  walk as (select email, i, t as start, 1 as n, 1 as ok from r where i = 1 union all
    select w.email, r.i, case when r.t - w.start > {us} then r.t else w.start end, case when r.t - w.start > {us} then 1 when w.n >= {most} then w.n else w.n + 1 end, w.ok + case when r.t - w.start > {us} or w.n < {most} then 1 else 0 end from walk w join r on r.email = w.email and r.i = w.i + 1)
  select email, cast(max(ok) as bigint) as allowed, count(*) - max(ok) as refused from walk group by email"""


def _limited(v: Views, most: int, seconds: int) -> DataFrame:
    out = online.replay(v.practice.select("email", "ts", "id"), online.FixedWindow(most, seconds))
    return out.groupBy("email").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


# the log is of days, so windows are hours and days where a server's are minutes
@ask("st_fixed_window_limit", "practice", LIMIT.format(us=86_400_000_000, most=2))
def st_fixed_window_limit(v: Views, most: int = 2, seconds: int = 86_400) -> DataFrame:
    return _limited(v, most, seconds)


@ask("st_route_limits", "practice", " ".join([
    ", " + ", ".join(f"x{k} as (with recursive {LIMIT.format(us=us, most=most)[2:]})" for k, us, most in (("a", 15 * 86_400_000_000, 20), ("p", 86_400_000_000, 1), ("g", 3_600_000_000, 6))),
    "select 'auth' as route, * from xa union all select 'proxy', * from xp union all select 'api', * from xg"]))
def st_route_limits(v: Views, routes: tuple = (("auth", 20, 15 * 86_400), ("proxy", 1, 86_400), ("api", 6, 3600))) -> DataFrame:
    parts = [_limited(v, most, seconds).select(F.lit(route).alias("route"), "email", "allowed", "refused") for route, most, seconds in routes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@ask("st_mastery_online", "practice", """, r as (select email, kp, case when is_correct and hint then 5 when is_correct then 15 else -20 end as x, row_number() over (partition by email, kp order by ts, id) as i from practice),
  walk as (select email, kp, i, greatest(0, least(100, x)) as s from r where i = 1 union all select w.email, w.kp, r.i, greatest(0, least(100, w.s + r.x)) from walk w join r on r.email = w.email and r.kp = w.kp and r.i = w.i + 1)
  select email, kp, cast(arg_max(s, i) as bigint) as mastery_percent, count(*) as attempts from walk group by email, kp""")
def st_mastery_online(v: Views) -> DataFrame:
    """What the stream of the log ends with: the same fold, over the log as a whole."""
    log = v.practice.select("email", "kp", "ts", "id", F.expr("cast(case when is_correct and hint then 5 when is_correct then 15 else -20 end as long)").alias("delta"))
    return folds.clamped(log, ["email", "kp"], ["ts", "id"], "delta").select("email", "kp", F.col("score").alias("mastery_percent"), F.col("n").alias("attempts"))


@ask("dom_mastery_fold", "practice", """, r as (select email, kp, is_correct, case when is_correct and hint then 5 when is_correct then 15 else -20 end as x, row_number() over (partition by email, kp order by ts, id) as i from practice),
  walk as (select email, kp, i, greatest(0, least(100, x)) as s from r where i = 1 union all select w.email, w.kp, r.i, greatest(0, least(100, w.s + r.x)) from walk w join r on r.email = w.email and r.kp = w.kp and r.i = w.i + 1),
  n as (select email, kp, count(*) as attempts, count(*) filter (where is_correct) as correct from practice group by email, kp)
  select n.email, n.kp, cast(arg_max(s, i) as int) as mastery_percent, attempts, correct from walk w join n on n.email = w.email and n.kp = w.kp group by n.email, n.kp, attempts, correct""")
def dom_mastery_fold(v: Views) -> DataFrame:
    log = v.practice.select("email", "kp", "ts", "id", F.col("is_correct").cast("long").alias("correct"), F.expr("cast(case when is_correct and hint then 5 when is_correct then 15 else -20 end as long)").alias("delta"))
    return folds.clamped(log, ["email", "kp"], ["ts", "id"], "delta", sums=("correct",)).select("email", "kp", F.col("score").cast("int").alias("mastery_percent"), F.col("n").alias("attempts"), "correct")


BUCKET = """, r as (select email, epoch_us(ts) as t, row_number() over (partition by email order by ts, id) as i from practice),
  walk as (select email, i, t, 86400000000 - 43200000000 as level, 1 as n from r where i = 1 union all
    select w.email, r.i, r.t, greatest(0, least(86400000000, w.level + r.t - w.t) - 43200000000), w.n + case when least(86400000000, w.level + r.t - w.t) >= 43200000000 then 1 else 0 end from walk w join r on r.email = w.email and r.i = w.i + 1)
  select email, cast(max(n) as bigint) as granted, count(*) - max(n) as delayed from walk group by email"""


@ask("st_token_bucket", "practice", BUCKET)
def st_token_bucket(v: Views, most: int = 2, seconds: int = 86_400) -> DataFrame:
    out = online.replay(v.practice.select("email", "ts", "id"), online.TokenBucket(most, seconds))
    return out.groupBy("email").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("delayed"))


GUARD = """, r as (select email, epoch_us(ts) as t, subject = 'purchase' as asks, is_correct as good, row_number() over (partition by email order by ts, id) as i from practice),
  walk as (select email, i, case when asks then t else -1 end as sent, 0 as tries, case when asks then 1 else 0 end as sends, 0 as ok, case when asks then 0 else 1 end as refused from r where i = 1 union all
    select email, i, case when asks then case when early then sent else t end when dead or good then -1 else sent end, case when asks then case when early then tries else 0 end when dead or good then 0 else tries + 1 end,
      sends + case when asks and not early then 1 else 0 end, ok + case when not asks and good and not dead then 1 else 0 end, refused + case when asks and early or not asks and dead then 1 else 0 end
    from (select r.*, w.sent, w.tries, w.sends, w.ok, w.refused, w.sent >= 0 and r.t - w.sent < 21600000000 as early, w.sent < 0 or r.t - w.sent > 432000000000 or w.tries >= 5 as dead from walk w join r on r.email = w.email and r.i = w.i + 1))
  select email, cast(max(sends) as bigint) as sends, cast(max(ok) as bigint) as verified, cast(max(refused) as bigint) as refused from walk group by email"""


@ask("st_resend_guard", "practice", GUARD)
def st_resend_guard(v: Views, again: int = 6 * 3600, expiry: int = 5 * 86_400, tries: int = 5) -> DataFrame:
    log = v.practice.select("email", "ts", "id", (F.col("subject") == "purchase").alias("asks"), F.col("is_correct").alias("good"))
    n = lambda x, name: F.count_if(F.col("outcome") == x).alias(name)
    return online.replay(log, online.ResendGuard(again, expiry, tries)).groupBy("email").agg(n("sent", "sends"), n("verified", "verified"), n("refused", "refused"))


@ask("win_fold", "practice", """, r as (select email, case when is_correct and hint then 5 when is_correct then 15 else -20 end as x, row_number() over (partition by email order by ts, id) as i from practice),
  walk as (select email, i, greatest(0, least(100, x)) as s from r where i = 1 union all select w.email, r.i, greatest(0, least(100, w.s + r.x)) from walk w join r on r.email = w.email and r.i = w.i + 1)
  select email, cast(arg_max(s, i) as bigint) as mastery_percent from walk group by email""")
def win_fold(v: Views) -> DataFrame:
    log = v.practice.select("email", "ts", "id", F.expr("cast(case when is_correct and hint then 5 when is_correct then 15 else -20 end as long)").alias("delta"))
    return folds.clamped(log, ["email"], ["ts", "id"], "delta").select("email", F.col("score").alias("mastery_percent"))


@ask("jn_asof", "practice", """, l as (select id, email, ts from practice where not is_correct), r as (select email, ts, max(id) as good from practice where is_correct group by email, ts),
  select l.id, l.email, t.good as last_good from l asof left join r t on l.email = t.email and l.ts >= t.ts""")
def jn_asof(v: Views) -> DataFrame:
    """To every wrong answer the learner's last right one before it."""
    right = v.practice.where("is_correct").select("email", "ts", "id")
    return asof.asof(v.practice.where("not is_correct").select("id", "email", "ts"), right, ["email"], "ts", {"id": "last_good"}).select("id", "email", "last_good")


@ask("ext_session", "practice", """, g as (select email, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 12 hours then 1 else 0 end as new from practice window w as (partition by email order by ts, id)),
  s as (select *, sum(new) over (partition by email order by ts rows between unbounded preceding and current row) as k from g)
  select email, epoch_us(min(ts)) as started_at, epoch_us(max(ts) + interval 12 hours) as ended_at, count(*) as n from s group by email, k""")
def ext_session(v: Views, gap: str = "12 hours") -> DataFrame:
    s = online.sessions(v.practice.select("id", "email", "ts"), gap)
    return s.select("email", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_at"), F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_at"), "n")


# --- schedule: reviews without a hint are spaced; points that were only answered with one have no date -----------------------------
SCHEDULE = """, r as (select email, kp, ts, case when not is_correct and time_ms > 30000 then 2 when not is_correct then 1 when time_ms < 10000 then 5 when time_ms < 30000 then 4 when time_ms < 60000 then 3 else 2 end as q,
    row_number() over (partition by email, kp order by ts, id) as i from practice where not hint), f as (select email, kp, list(q order by i) as qs, max(ts) as seen from r group by email, kp),
    s as (select email, kp, seen, list_reduce(list_prepend({'ease': cast(2.5 as double), 'days': cast(0 as bigint), 'q': 0}, list_transform(qs, lambda z: {'ease': cast(0 as double), 'days': cast(0 as bigint), 'q': z})),
      lambda a, x: {'ease': round(greatest(cast(1.3 as double), a.ease + cast(0.1 as double) - (5 - x.q) * (cast(0.08 as double) + (5 - x.q) * cast(0.02 as double))), 2),
        'days': cast(least(365, case when x.q < 3 then 1 when a.days = 0 then 1 when a.days = 1 then 6 else floor(a.days * greatest(cast(1.3 as double), a.ease + cast(0.1 as double) - (5 - x.q) * (cast(0.08 as double) + (5 - x.q) * cast(0.02 as double))) + 0.5) end) as bigint), 'q': 0}) as t from f),
    planned as (select m.email, m.kp, m.score, m.attempts, m.correct, cast(cast(s.seen as date) + cast(s.t.days as int) as date) as next_review, s.t.days as days from mastery m left join s on s.email = m.email and s.kp = m.kp),
    ranked as (select *, date_diff('day', next_review, date '2024-01-31') as late, round((1 - score) * cast(0.6 as double) + case when next_review is null then cast(0.8 as double) else least(cast(1 as double), greatest(cast(0 as double), cast(date_diff('day', next_review, date '2024-01-31') as double) / 7)) end * cast(0.4 as double), 3) as priority from planned)
"""


def _planned(v: Views) -> DataFrame:
    """Mastery of every point with its next review."""
    log = v.practice.where("not hint").select("email", "kp", "ts", "id", learner.quality(F.col("is_correct"), F.col("time_ms")).alias("q"), F.lit(0).alias("gain"))
    plan = folds.reviews(log, ["email", "kp"], every=False, needs_state=False).select("email", "kp", F.date_add("d", F.col("new_interval").cast("int")).alias("next_review"), F.col("new_interval").alias("interval"))
    return v.mastery.join(plan, ["email", "kp"], "left")


@ask("dom_priority", "practice mastery", SCHEDULE + "select email, kp, next_review, priority from ranked")
def dom_priority(v: Views, now: str = "2024-01-31 00:00:00") -> DataFrame:
    return _planned(v).select("email", "kp", "next_review", folds.priority(F.col("score"), F.col("next_review"), now).alias("priority"))


@ask("dom_daily_tasks", "practice mastery", SCHEDULE + """, a as (select *, row_number() over (partition by email order by score, kp) as r from ranked where attempts > 0),
  b as (select *, row_number() over (partition by email order by priority desc, score, kp) as place from a where r <= 60),
  c as (select *, late > 0 as is_overdue from b where place <= 20)
  select email, cast(place as int) as place, kp, score, priority, is_overdue, cast(case when late is not null then greatest(0, late) end as bigint) as days_overdue, next_review, days as interval, attempts, correct, round(100 * correct / attempts, 1) as accuracy,
    count(*) filter (where is_overdue) over w as total_due, count(*) filter (where score < 0.4) over w as total_weak, floor(cast(2 * sum(cast(round(priority * 1000) as bigint)) over w + count(*) over w as double) / (2 * count(*) over w)) / 1000 as avg_priority
  from c window w as (partition by email)""")
def dom_daily_tasks(v: Views, now: str = "2024-01-31 00:00:00", limit: int = 20, prefix: str | None = None) -> DataFrame:
    return folds.daily_tasks(_planned(v), now, limit, prefix)


# --- whole tables ----------------------------------------------------------------------------------------------------------------
@ask("jn_subject_group", "kps", "select a.subject, count(*) as pairs from kps a join kps b on a.subject = b.subject and a.id < b.id group by a.subject")
def jn_subject_group(v: Views) -> DataFrame:
    """How many pairs of points share a subject: counted, never made."""
    n = v.kps.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").select("subject", F.expr("n * (n - 1) div 2").alias("pairs"))


@ask("win_index", "edges", "select 'e' || cast(row_number() over (order by src, dst) - 1 as varchar) as id, src, dst from edges")
def win_index(v: Views) -> DataFrame:
    d = relational.numbered(v.edges, ["src", "dst"], "i", files.scratch(v.spark, "numbered"))
    return d.select(F.concat(F.lit("e"), F.col("i").cast("string")).alias("id"), "src", "dst")


@ask("win_round_robin", "questions kps", """select x.paper_id, x.seq, k.id as kp from (select paper_id, seq, row_number() over (order by paper_id, seq) - 1 as i from questions) x
  join (select id, row_number() over (order by id) - 1 as j, count(*) over () as n from kps) k on x.i % k.n = k.j""")
def win_round_robin(v: Views) -> DataFrame:
    """Questions take the points in turns."""
    q = relational.numbered(v.questions.select("paper_id", "seq"), ["paper_id", "seq"], "i", files.scratch(v.spark, "numbered"))
    k = relational.numbered(v.kps.select(F.col("id").alias("kp")), ["kp"], "j", files.scratch(v.spark, "numbered"))
    n = k.count()
    return q.withColumn("j", F.col("i") % max(1, n)).join(k, "j").select("paper_id", "seq", "kp")


@ask("agg_percentiles", "practice", """, a as (select subject, time_ms, row_number() over (partition by subject order by time_ms) as r, count(*) over (partition by subject) as n from practice)
  select subject, min(time_ms) as lo, max(time_ms) as hi, min(time_ms) filter (where r >= ceil(0.50 * n)) as p50, min(time_ms) filter (where r >= ceil(0.95 * n)) as p95, min(time_ms) filter (where r >= ceil(0.99 * n)) as p99 from a group by subject""")
def agg_percentiles(v: Views) -> DataFrame:
    return relational.nearest_ranks(v.practice, "subject", "time_ms", {"p50": 0.50, "p95": 0.95, "p99": 0.99})


COSINE = "list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[]))"


def _vectors(v: Views, *more: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and as queries those whose id 50 divides."""
    r = v.rag.select("id", F.col("embedding").alias("v"), *more)
    return r, r.where("id % 50 = 0")


def _searched(sql_rows: str, k: int, above: str = "") -> str:
    return f""", s as (select q.id, r.id as neighbour, {COSINE} as sim from rag q join rag r on q.id % 50 = 0 and r.id <> q.id {sql_rows}), t as (select *, row_number() over (partition by id order by sim desc, neighbour) as rank from s)
  select id, cast(rank as int) as rank, neighbour, round(sim, 4) as similarity from t where rank <= {k} {above}"""


@ask("top_vector", "rag", _searched("", 5))
def top_vector(v: Views, k: int = 5) -> DataFrame:
    return vector.exact(*_vectors(v), k).withColumn("similarity", F.round("similarity", 4))


@ask("fn_vec_cosine", "rag", _searched("and r.kp = q.kp", 1_000_000))
def fn_vec_cosine(v: Views) -> DataFrame:
    """The similarity of every query to every row of its point."""
    return vector.exact(*_vectors(v, "kp"), 1_000_000, within="kp").withColumn("similarity", F.round("similarity", 4))


@ask("dom_vec_search", "rag", _searched("and r.difficulty <= 4", 10, "and sim > 0.1"))
def dom_vec_search(v: Views, k: int = 10, above: float = 0.1, hardest: int = 4) -> DataFrame:
    rows, queries = _vectors(v, "difficulty")
    return vector.exact(relational.between(rows, "difficulty", None, hardest), queries, int(relational.clamp(k, 1, 50)), above=above).withColumn("similarity", F.round("similarity", 4))


def _graph_search(v: Views, name: str, k: int, where: str | None) -> DataFrame:
    """Builds and writes the index of all rows, then asks it."""
    rows, queries = _vectors(v, "kp", "difficulty")
    path = files.scratch(v.spark, name)
    graph_index.build(rows).write.parquet(path)
    return graph_index.search(v.spark.read.parquet(path), queries, k, where).withColumn("similarity", F.round("similarity", 4))


@ask("top_vector_graph", "rag", None)
def top_vector_graph(v: Views, k: int = 10) -> DataFrame:
    """The nearest rows of every fiftieth by the graph index: approximate, so no oracle."""
    return _graph_search(v, "graph_index", k, None)


@ask("dom_vec_search_graph", "rag", None)
def dom_vec_search_graph(v: Views, k: int = 10, hardest: int = 4) -> DataFrame:
    """The same among rows up to a difficulty, which the walk looks at as it goes."""
    return _graph_search(v, "graph_index_filtered", int(relational.clamp(k, 1, 50)), f"difficulty <= {int(hardest)}")


@ask("dom_vec_rag", "rag", _searched("and r.kp = q.kp", 3, "and sim > 0.05"))
def dom_vec_rag(v: Views, k: int = 3, above: float = 0.05) -> DataFrame:
    return vector.exact(*_vectors(v, "kp"), k, within="kp", above=above).withColumn("similarity", F.round("similarity", 4))


@ask("fn_chunk_id", "", None)
def fn_chunk_id(v: Views) -> DataFrame:
    """Ids of a document's chunks, and how many it has."""
    d = v.documents.select("doc_id", documents.chunk_markdown(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("i", "chunk")).select("doc_id", F.concat_ws("_", F.lit("idx"), F.col("doc_id"), "i").alias("chunk_id"), "total_chunks", F.length("chunk").alias("n_chars"))


cases("fn_frontmatter", {"---\nid: k1\nname: \"A b\"\n---\nbody": "k1,A b", "---\nname: x\n---\nid: no": "~,x", "no block\n---\nid: k\n---": "~,~", "---\nid: \n---\n": "~,~"}, lambda c: F.concat_ws(",", *[F.coalesce(files.frontmatter(c, k), F.lit("~")) for k in ("id", "name")]))
cases("fn_wikilinks", {"see [[A]] and [[B|b]] and [[A]]": "A|B", "[[ C ]] [[]] [D]": "C", "none": ""}, lambda c: _join(files.wiki_links(c)))
