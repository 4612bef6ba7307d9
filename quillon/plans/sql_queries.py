"""Relational, window, text, graph and learner-state queries as declarative SQL; Catalyst plans them.

Each query is a function of a dialect and returns one statement; the DuckDB text is the oracle. Orderings under a limit always end
in a unique key, nulls are placed explicitly, and wall-clock dates are the parameter AS_OF.
"""

from __future__ import annotations

import re

from .dialect import AS_OF, Duck, Spark, with_views
from ..registry import query

SQL: dict = {}


def sql(views: str = ""):
    def wrap(f):
        name = f.__name__

        def text(d):
            # a plain decimal literal is a DECIMAL in Spark and in DuckDB of different scales: make it a double
            return re.sub(r"(?<![\w.'%])(\d+\.\d+)(?![\w.'])", r"\1e0", (with_views(d, views) if views else "") + f(d))

        SQL[name] = text
        query(name, text(Duck()))(lambda spark, sf_dir: spark.sql(text(Spark(sf_dir))))
        return f

    return wrap


def q(name: str, views: str, body) -> None:
    """A query whose body is a string or a function of the dialect."""

    def f(d):
        return body(d) if callable(body) else body

    f.__name__ = name
    sql(views)(f)


# --- filters and projections ------------------------------------------------------------------------------------------
q("src_table", "", lambda d: f"select n_nationkey, n_name, n_regionkey from {d.t['nation']}")
q("flt_range", "questions", "select paper_id, seq, score from questions where score between 10 and 20 and difficulty >= 4")
q("flt_in_list", "kps", "select id, name from kps where id in (1, 5, 17, 99, 100000)")
q("flt_in_subquery", "questions papers", "select paper_id, seq from questions where paper_id in (select id from papers where province = 7)")
q("flt_not_in_subquery", "users papers", "select email from users where not exists (select 1 from papers where owner = email and level = 'F' and yr > 1996)")
q("flt_prefix_like", "kps", "select id, subject from kps where subject like 'S%'")
q("flt_ilike", "kps", lambda d: "select id, name from kps where lower(name) like '%e%' order by name, id limit 5")
q("flt_is_null", "practice", lambda d: f"select count(*) as n from practice where {d.json('props', 'k')} is not null")
q("flt_exclude_id", "rag", "select id, kp from rag where id <> 7 and kp = 3")
q("flt_relative_date", "practice", lambda d: f"select count(*) as n, count(distinct email) as users from practice where ts >= {d.plus_days(AS_OF, -7)}")
q("prj_case_bucket", "sessions", "select id, case when acc >= 90 then '90-100' when acc >= 80 then '80-89' when acc >= 70 then '70-79' when acc >= 60 then '60-69' else '0-59' end as bucket from (select id, 100.0 * correct_count / question_count as acc from sessions) s")
q("prj_coalesce", "users sessions", "select u.email, coalesce(s.n, 0) as n_sessions from users u left join (select email, count(*) as n from sessions group by email) s on u.email = s.email")
q("prj_rename_struct", "questions", "select paper_id as paper, seq as number, qtype as question_type from questions where score > 45")
q("prj_default", "kps", "select id, case when name is null or name = '' then cast(id as varchar(20)) else name end as label, case when difficulty is null or difficulty = 0 then 3 else difficulty end as difficulty from kps")

# --- joins ------------------------------------------------------------------------------------------------------------
q("jn_left_lookup", "papers provinces", "select p.id, p.province, v.name from papers p left join provinces v on p.province = v.code")
q("jn_inner", "questions papers", "select p.yr, count(*) as n from questions x join papers p on x.paper_id = p.id group by p.yr")
q("jn_inner_left_chain", "questions papers provinces", "select x.paper_id, x.seq, p.subject, v.name as province from questions x join papers p on x.paper_id = p.id left join provinces v on p.province = v.code where x.difficulty = 5")
q("jn_agg_subqueries", "practice wrong", """select k.kp, coalesce(w.n, 0) as wrong_count, coalesce(p.n, 0) as practice_count, coalesce(p.acc, 0) as accuracy from (select distinct kp from practice) k
    left join (select kp, count(*) as n from wrong group by kp) w on k.kp = w.kp
    left join (select kp, count(*) as n, round(avg(case when is_correct then 100.0 else 0.0 end), 4) as acc from practice group by kp) p on k.kp = p.kp""")
q("jn_fanout_avg", "papers questions", "select p.province, count(distinct p.id) as papers, count(x.seq) as questions, round(avg(p.yr), 6) as avg_year from papers p left join questions x on x.paper_id = p.id group by p.province")
q("jn_theta_on", "users sessions", lambda d: "select u.email, count(s.id) as n from users u left join sessions s on s.email = u.email and s.started_at >= timestamp '1997-01-01 00:00:00' group by u.email")
q("jn_client_hash", "papers provinces", "select p.id, coalesce(v.name, 'nationwide') as province from papers p left join (select * from provinces where region < 3) v on p.province = v.code")
q("jn_client_find", "practice wrong", "select s.subject, coalesce(w.n, 0) as n from (select distinct subject from practice) s left join (select subject, count(*) as n from wrong group by subject) w on s.subject = w.subject")
q("jn_group_attach", "papers questions", lambda d: f"select p.id, coalesce({d.joined('x.seq')}, '') as items from papers p left join (select * from questions where difficulty = 1) x on x.paper_id = p.id group by p.id")
q("jn_map_lookup", "kps mastery", "select k.id, m.email, m.score from kps k left join mastery m on k.id = m.kp")
q("jn_semi_edges", "edges kps", "select src, dst from edges where src in (select id from kps where difficulty <= 3) and dst in (select id from kps where difficulty <= 3)")
q("jn_anti_insert", "wrong practice", "select distinct email, kp from practice p where not exists (select 1 from wrong w where w.email = p.email and w.kp = p.kp)")
q("jn_first_match", "questions", "select paper_id, question_number, min(kp) as kp from questions group by paper_id, question_number")
q("jn_update_from", "questions papers", "select x.paper_id, x.seq, coalesce(case when x.qtype = 'N' then null else x.qtype end, p.subject) as subject from questions x left join papers p on x.paper_id = p.id")
q("jn_name_resolve", "kps", "select a.id, b.id as target from kps a left join (select name, min(id) as id from kps group by name) b on b.name = a.name")

# --- aggregates -------------------------------------------------------------------------------------------------------
q("agg_count_avg_subject", "sessions", "select subject, count(*) as n, round(avg(100.0 * correct_count / question_count), 4) as avg_score from sessions group by subject")
q("agg_error_count", "wrong practice", "select subject, count(*) as n from wrong group by subject order by n desc, subject")
q("agg_daily_union", "wrong practice checkins", "select day, count(*) as n from (select cast(ts as date) as day from wrong union all select d from checkins) a group by day order by day desc limit 30")
q("agg_kp_frequency", "wrong practice kps", "select k.id, k.name, count(*) as n from wrong w join kps k on w.kp = k.id group by k.id, k.name order by n desc, k.id limit 20")
q("agg_progress_trend", "practice", lambda d: f"select cast(ts as date) as day, subject, count(*) as n from practice where ts >= {d.plus_days(AS_OF, -30)} group by cast(ts as date), subject")
q("agg_distinct_users_today", "practice", "select count(distinct email) as users from practice where cast(ts as date) = date '2024-01-15'")
q("agg_overview_scalars", "users practice papers questions", "select * from (select count(*) as n_users from users) a cross join (select count(*) as n_practice from practice) b cross join (select count(*) as n_papers from papers) c cross join (select count(*) as n_questions from questions) d")
q("agg_distinct_then_count", "practice", "select subject, count(*) as users from (select distinct email, subject from practice where subject is not null) a group by subject")
q("agg_histogram", "questions", "select difficulty, count(*) as n from questions group by difficulty")
q("agg_student_perf", "users practice wrong sessions", """select u.email, u.grade, coalesce(w.wrong_count, 0) as wrong_count, coalesce(s.n, 0) as exam_count, round(s.acc, 4) as avg_accuracy from users u
    left join (select email, count(distinct id) as wrong_count from wrong group by email) w on w.email = u.email
    left join (select email, count(*) as n, avg(100.0 * correct_count / question_count) as acc from sessions group by email) s on s.email = u.email
    where coalesce(w.wrong_count, 0) > 0 or coalesce(s.n, 0) > 0 order by round(s.acc, 4) asc nulls last, u.email limit 50""")
q("jn_fanout_distinct", "users practice wrong sessions", """select u.email, coalesce(w.n, 0) as wrong_count, coalesce(s.n, 0) as session_count from users u
    left join (select email, count(distinct id) as n from wrong group by email) w on w.email = u.email left join (select email, count(distinct id) as n from sessions group by email) s on s.email = u.email""")
q("agg_weak_points_json", "wrong practice", lambda d: f"select subject, {d.json('data', 'k')} as k, count(*) as n, count(distinct email) as users from wrong group by subject, {d.json('data', 'k')} order by n desc, subject, k limit 50")
q("agg_weekly", "practice", lambda d: f"select {d.iso_week('ts')} as week, count(*) as n, count(distinct email) as users from practice group by {d.iso_week('ts')}")
q("agg_score_buckets", "sessions", "select bucket, count(*) as n from (select case when acc >= 90 then 'A' when acc >= 80 then 'B' when acc >= 70 then 'C' when acc >= 60 then 'D' else 'E' end as bucket from (select 100.0 * correct_count / question_count as acc from sessions) s) b group by bucket")
q("agg_paper_trend", "papers", "select yr, subject, level, province, count(*) as n from papers group by yr, subject, level, province")
q("agg_kp_year", "questions papers", "select p.yr, x.kp, count(*) as frequency, round(avg(x.difficulty), 4) as avg_difficulty, cast(sum(x.score) as bigint) as total_score from questions x join papers p on x.paper_id = p.id group by p.yr, x.kp")
q("agg_type", "questions", "select qtype, count(*) as n, round(avg(difficulty), 4) as avg_difficulty, round(avg(score), 4) as avg_score from questions group by qtype")
q("agg_top_kp", "questions", "select kp, count(*) as frequency from questions group by kp order by frequency desc, kp limit 20")
q("agg_compare", "papers questions", "select p.province, count(distinct p.id) as papers, count(*) as questions, round(avg(x.difficulty), 4) as avg_difficulty, round(avg(x.score), 4) as avg_score from papers p join questions x on x.paper_id = p.id where p.province in (1, 3, 8) group by p.province")
q("agg_province_stats", "papers", "select count(distinct province) as provinces, count(distinct subject) as subjects, count(*) as papers, min(yr) as first_year, max(yr) as last_year from papers")
q("agg_paper_stats", "papers", "select province, count(*) as n, min(yr) as first_year, max(yr) as last_year from papers group by province")
q("agg_refresh_paper", "papers questions", "select p.id, coalesce(a.n, 0) as question_count, a.d as difficulty_avg, coalesce(a.s, 0) as total_score from papers p left join (select paper_id, count(*) as n, round(avg(difficulty), 4) as d, cast(sum(score) as bigint) as s from questions where difficulty is not null group by paper_id) a on a.paper_id = p.id")
q("agg_filter_clause", "rag", "select count(*) as n, count(*) filter (where embedding is not null) as embedded, count(distinct kp) filter (where difficulty > 2) as kps from rag")
q("agg_cond_avg", "practice", "select cast(ts as date) as day, round(avg(case when is_correct then 100.0 else 0.0 end), 4) as accuracy, count(*) as n from practice group by cast(ts as date)")
q("agg_monthly", "sessions", lambda d: f"select {d.month('started_at')} as month, cast(sum(case when correct_count * 2 > question_count then 1 else 0 end) as bigint) as passed, count(*) as n from sessions group by {d.month('started_at')} order by month desc limit 6")
q("agg_share", "wrong practice", "select subject, n, round(100.0 * n / sum(n) over (), 4) as share from (select subject, count(*) as n from wrong group by subject) a")
q("agg_avg_of_daily", "practice", lambda d: "select round(avg(acc), 4) as avg_accuracy, count(*) as days from (select cast(ts as date) as day, avg(case when is_correct then 100.0 else 0.0 end) as acc from practice group by cast(ts as date) order by day desc limit 7) a")
q("agg_user_stats", "users practice wrong sessions checkins", """select u.email, coalesce(p.n, 0) as practiced, coalesce(p.c, 0) as correct, coalesce(w.n, 0) as wrong_count, coalesce(s.n, 0) as exams, coalesce(s.b, 0) as best_correct, coalesce(c.n, 0) as checkin_days from users u
    left join (select email, count(*) as n, count(case when is_correct then 1 end) as c from practice group by email) p on p.email = u.email left join (select email, count(*) as n from wrong group by email) w on w.email = u.email
    left join (select email, count(*) as n, max(correct_count) as b from sessions group by email) s on s.email = u.email left join (select email, count(*) as n from checkins group by email) c on c.email = u.email""")
q("agg_points_sum", "practice checkins", "select email, cast(sum(points) as bigint) as points from (select email, case when is_correct then 10 else 2 end as points from practice union all select email, 5 from checkins) log group by email")
q("agg_srs_stats", "practice", lambda d: f"select email, count(*) as total, count(case when cast(ts as date) = date '2024-01-30' then 1 end) as today, count(distinct case when ts >= {d.plus_days(AS_OF, -30)} then cast(ts as date) end) as active_days from practice group by email")
q("agg_status_map", "papers", lambda d: f"select {d.joined('x')} as status_counts from (select level || '=' || cast(count(*) as varchar(20)) as x from papers group by level) a")
q("agg_table_counts", "", lambda d: " union all ".join(f"select '{t}' as name, count(*) as n from {d.t[t]}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
q("agg_graph_stats", "mastery", "select count(*) as total, count(case when score >= 0.7 then 1 end) as mastered, count(case when score < 0.4 then 1 end) as weak from mastery")
q("agg_task_stats", "practice", "select outcome, count(*) as n from (select case when hint then 'fallback' when is_correct then 'success' when time_ms > 60000 then 'failed' else 'lowQuality' end as outcome from practice) a group by outcome")
q("agg_label_counts", "kps papers", "select 'KnowledgePoint' as label, count(*) as n from kps union all select 'Paper', count(*) from papers")
q("agg_collect", "questions kps", lambda d: f"select x.paper_id, {d.joined('k.name')} as names from questions x join kps k on x.kp = k.id group by x.paper_id")
q("agg_dedup_min", "questions", "select paper_id, question_number, min(seq) as seq from questions group by paper_id, question_number")
q("ext_rollup_region_year", "papers provinces", "select v.region, p.yr, count(*) as n from papers p join provinces v on p.province = v.code group by rollup (v.region, p.yr)")

# --- windows ----------------------------------------------------------------------------------------------------------
q("win_recent_n", "sessions", "select email, id, r from (select email, id, cast(row_number() over (partition by email order by started_at desc, id desc) as int) as r from sessions) a where r <= 10")
q("win_recency_weight", "sessions", "select email, round(sum(w * correct_count / question_count) / sum(w), 6) as weighted from (select *, 1.0 / (1 + 0.3 * (r - 1)) as w from (select email, correct_count, question_count, row_number() over (partition by email order by started_at desc, id desc) as r from sessions) a where r <= 10) b group by email")
STREAK = lambda d: f"""select email, d, cast(case when gap then 1 + sum(case when gap then 1 else 0 end) over (partition by email order by d) else 1 end as bigint) as streak from (select email, d, coalesce({d.days('d', 'lag(d) over (partition by email order by d)')} = 1, false) as gap from checkins) a"""
q("win_streak", "checkins", STREAK)
q("win_streak_true", "checkins", lambda d: f"select email, min(d) as first_day, count(*) as days from (select email, d, {d.plus_days('d', '-cast(row_number() over (partition by email order by d) as int)')} as island from checkins) a group by email, island")
q("win_dedup_rank", "questions", "select paper_id, question_number, seq from (select *, row_number() over (partition by paper_id, question_number order by seq) as r from questions) a where r = 1")
q("win_share", "questions", "select qtype, round(1.0 * count(*) / sum(count(*)) over (), 6) as share from questions group by qtype")
q("win_first3", "wrong practice", lambda d: "select kp, id, cast(r as int) as r from (select kp, id, row_number() over (partition by kp order by ts desc, id) as r from wrong) a where r <= 3")
q("win_hop_min", "edges", "select src, node, min(hop) as hop from (select src, dst as node, 1 as hop from edges union all select a.src, b.dst, 2 from edges a join edges b on a.dst = b.src) h group by src, node")
q("win_group_topn", "kps", "select difficulty, id, cast(r as int) as r from (select difficulty, id, row_number() over (partition by difficulty order by name, id) as r from kps) a where r <= 3")

# --- sorts and limits -------------------------------------------------------------------------------------------------
q("top_offset", "papers", "select id, created_at, (select count(*) from papers) as total from papers order by created_at desc, id limit 20 offset 40")
PRIORITY = lambda d: f"round(0.6 * (1 - score) + 0.4 * least(1.0, greatest(0.0, {d.days(AS_OF, 'cast(last_at as date)')} / 7.0)), 3)"
q("top_two_phase", "mastery", lambda d: f"select email, kp, score, priority from (select email, kp, score, {PRIORITY(d)} as priority from (select * from mastery where attempts > 0 order by score, email, kp limit 60) a) b order by priority desc, score, email, kp limit 20")
q("top_random", "questions", lambda d: f"select paper_id, seq from questions order by md5('seed' || {d.text('paper_id')} || '-' || {d.text('seq')}), paper_id, seq limit 20")
q("top_multi_key", "kps wrong practice", "select k.id, k.difficulty, count(*) as n from kps k join wrong w on w.kp = k.id group by k.id, k.difficulty order by n desc, k.difficulty desc, k.id limit 15")
q("top_nulls", "practice wrong", "select k.kp, w.n, p.acc from (select distinct kp from practice) k left join (select kp, count(*) as n from wrong group by kp) w on w.kp = k.kp left join (select kp, round(avg(case when is_correct then 1.0 else 0.0 end), 4) as acc from practice group by kp) p on p.kp = k.kp order by w.n desc nulls first, p.acc asc nulls last, k.kp limit 20")
q("top_reverse", "practice", "select day, n from (select cast(ts as date) as day, count(*) as n from practice group by cast(ts as date) order by day desc limit 7) a order by day")
q("top_codes_sorted", "provinces", lambda d: f"select region, {d.joined('code')} as cache_key from provinces group by region")
q("top_oldest_pending", "practice", "select id, ts from practice where not is_correct order by ts, id limit 1")

# --- sets -------------------------------------------------------------------------------------------------------------
q("set_union_all", "wrong practice checkins", "select email, cast(ts as date) as d from wrong union all select email, d from checkins")
q("set_distinct", "papers", "select distinct province, level from papers")
q("set_difference", "kps wrong practice", "select email, kp from practice except select email, kp from wrong")
q("set_concat_priority", "mastery wrong practice", "select email, kp, rank from (select distinct email, kp, 0 as rank from wrong union all select m.email, m.kp, 1 as rank from mastery m where not exists (select 1 from wrong w where w.email = m.email and w.kp = m.kp)) a order by email, rank, kp")
q("set_membership", "users sessions", "select email, grade in ('AUTOMOBILE', 'MACHINERY') as science, email in (select email from sessions) as active from users")

# --- scalars and text -------------------------------------------------------------------------------------------------
q("fn_date", "practice", "select id, cast(ts as date) as d from practice")
q("fn_iso_week", "practice", lambda d: f"select id, {d.iso_week('ts')} as week from practice")
q("fn_month", "papers", lambda d: f"select id, {d.month('created_at')} as month from papers")
q("fn_year", "papers", "select id, yr from papers")
q("fn_days_diff", "practice", lambda d: f"select id, {d.days(AS_OF, 'cast(ts as date)')} as days from practice")
q("fn_add_days", "practice", lambda d: f"select id, {d.plus_days('cast(ts as date)', 'cast(1 + id % 30 as int)')} as next_review from practice")
q("fn_clamp", "practice", "select id, greatest(0.0, least(1.0, time_ms / 50000.0)) as x from practice")
q("fn_round_n", "sessions", "select id, floor(100.0 * correct_count / question_count * 10 + 0.5) / 10 as accuracy from sessions")
q("fn_percent", "mastery", "select email, kp, case when attempts > 0 then 100.0 * correct / attempts else 0.0 end as percent from mastery")
q("fn_normalise_answer", "kps", "select id, lower(trim('  ' || upper(name) || ' ')) = lower(trim(name)) and name <> '' as same from kps")
q("fn_contains_ci", "", lambda d: f"select doc_id, lower(text) like '%the%' as hit from {d.t['documents']}")
q("fn_json_get", "practice", lambda d: f"select id, {d.json('props', 'k')} as k from practice")
q("fn_json_safe", "practice", lambda d: f"select id, coalesce({d.json('props', 'missing')}, {d.json('props', 'k')}, '[]') as v from practice")
q("fn_weakness_index", "kps wrong practice", "select k.id, round(count(*) * k.difficulty / 3.0 * case k.frequency when 'high' then 1.5 when 'medium' then 1.0 else 0.7 end, 6) as weakness from wrong w join kps k on w.kp = k.id group by k.id, k.difficulty, k.frequency")
q("fn_sha256", "", lambda d: f"select doc_id, {d.sha('text')} as hash from {d.t['documents']}")
q("fn_chunk_filter", "", lambda d: f"select doc_id from {d.t['documents']} where length(trim(text)) >= 50")
q("fn_metadata_header", "", lambda d: f"select doc_id, '[' || source || '|' || lang || '] ' || text as header from {d.t['documents']}")
q("fn_strip_data_url", "", lambda d: f"select conv_id, turn, {d.replace(chr(39) + 'data:image/png;base64,' + chr(39) + ' || role', '^data:image/[a-z]+;base64,', '')} as body from {d.t['conversations']}")

# --- domain -----------------------------------------------------------------------------------------------------------
q("dom_delta", "practice", "select id, case when is_correct and hint then 0.05 when is_correct then 0.15 else -0.20 end as delta from practice")
DELTA = "case when is_correct and hint then 5 when is_correct then 15 else -20 end"
q("dom_quality", "practice", "select id, case when not is_correct and time_ms > 30000 then 2 when not is_correct then 1 when time_ms < 10000 then 5 when time_ms < 30000 then 4 when time_ms < 60000 then 3 else 2 end as quality from practice")
q("dom_prereq", "edges", "select src, node, min(hop) as hop from (select src, dst as node, 1 as hop from edges union all select a.src, b.dst, 2 from edges a join edges b on a.dst = b.src) h group by src, node")
q("dom_upstream", "edges kps", "select e.src as id, k.id as prerequisite, k.name from edges e join kps k on e.dst = k.id")
q("dom_downstream", "edges kps", "select e.dst as id, k.id as dependent, k.name from edges e join kps k on e.src = k.id")
q("dom_recommend", "wrong practice", "select email, case when n = 0 then 30 when n <= 3 then 45 when n <= 6 then 60 else 90 end as minutes_a_day from (select email, count(*) as n from wrong group by email) a")
q("dom_exam_start", "questions", lambda d: f"select paper_id, seq, qtype, score from questions where qtype = 'R' order by md5('exam' || {d.text('paper_id')} || '-' || {d.text('seq')}), paper_id, seq limit 20")
q("dom_checkin", "checkins", lambda d: f"select email, d, streak, 5 + least(streak, 20) as points from ({STREAK(d)}) s")
q("dom_exam_score_ui", "sessions", "select id, correct_count as correct, question_count - correct_count as wrong_or_blank, cast(floor(100.0 * correct_count / question_count + 0.5) as int) as percent from sessions")
q("ext_tumbling", "practice", "select cast(ts as date) as day, subject, count(*) as n from practice group by cast(ts as date), subject")


# the id that was given, else the inferred one, else the first point whose name holds the inferred word
q("dom_kp_resolution", "kps wrong practice", lambda d: f"""select w.id, coalesce(a.id, b.id, c.id) as kp, coalesce(a.name, b.name, c.name) as kp_name, coalesce(a.id, b.id, c.id) is not null as kp_validated
    from (select id, kp * 37 as given, cast({d.json('data', 'k')} as bigint) * 31 as inferred, case id % 4 when 0 then 'RING' when 1 then 'dge' when 2 then 'ed w' else 'nothing' end as word from wrong) w left join kps a on a.id = w.given left join kps b on b.id = w.inferred
    left join (select f.word, k.id, k.name from (select p.word, min(k.id) as id from (select 'RING' as word union all select 'dge' union all select 'ed w' union all select 'nothing') p join kps k on lower(k.name) like '%' || lower(p.word) || '%' group by p.word) f join kps k on k.id = f.id) c on c.word = w.word""")
# 20 places: 13 to select, 4 to fill in, 3 to solve; a learner's weak points come first and take turns
SLOTS = ", ".join(f"({i})" for i in range(20))
q("dom_paper", "mastery kps", f"""select r.email, v.i + 1 as number, case when v.i < 13 then 'selection' when v.i < 17 then 'fill' else 'solution' end as section, r.kp, r.weak, case when v.i < 17 then 5 when v.i < 19 then 12 else 14 end as score,
    case when v.i < 5 or v.i in (13, 14) then 'easy' when v.i = 19 then 'hard' else 'medium' end as level
    from (select email, kp, weak, row_number() over (partition by email order by case when weak then 0 else 1 end, difficulty desc, kp) - 1 as i, count(*) over (partition by email) as n
      from (select m.email, m.kp, m.score < 0.6 as weak, k.difficulty from mastery m join kps k on k.id = m.kp) a) r join (values {SLOTS}) v(i) on v.i % r.n = r.i""")
