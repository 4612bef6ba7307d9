"""What the tutor computes for learners, as functions of DataFrames and parameters.

Scores of mastery are whole hundredths, so that every step is exact. Each function aggregates before it joins; windows are by learner (or by point),
and a learner's rows are as many as a person makes. Ties are broken by ids everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .learner import quality

# fixed values: how often a point is asked
FREQUENCY = {"high": 1.5, "medium": 1.0, "low": 0.7, "高": 1.5, "中": 1.0, "低": 0.7}
# fixed values: badges with the figure they look at and the least value
BADGES = [
    ("first_login", "login_days", 1), ("week_streak", "streak_days", 7), ("month_streak", "streak_days", 30), ("first_error", "total_errors", 1), ("error_50", "total_errors", 50),
    ("error_200", "total_errors", 200), ("exam_1", "total_exams", 1), ("exam_10", "total_exams", 10), ("exam_50", "total_exams", 50), ("accuracy_80", "best_accuracy", 80),
    ("accuracy_95", "best_accuracy", 95), ("points_100", "total_points", 100), ("points_1000", "total_points", 1000), ("all_subjects", "subject_count", 6),
]
# fixed values: easy, medium and hard questions up to a difficulty
BANDS = [(2, (12, 6, 2)), (3, (8, 8, 4)), (4, (5, 8, 7)), (None, (3, 6, 11))]


def ability(users: DataFrame, sessions: DataFrame, recent: int = 10) -> DataFrame:
    """users(email), sessions(email, id, started_at, correct_count, question_count, avg_difficulty) -> (email, ability): 1.0 to 5.0, newer sessions
    weigh 1/(1 + 0.3 i); 3.0 without sessions."""
    rank = F.row_number().over(Window.partitionBy("email").orderBy(F.desc("started_at"), F.desc("id"))) - 1
    share = F.col("correct_count") / F.col("question_count") * (0.5 + 0.5 * F.col("avg_difficulty") / 5)
    s = sessions.withColumn("i", rank).where(F.col("i") < recent).withColumn("w", 1 / (1 + 0.3 * F.col("i"))).withColumn("p", share)
    s = s.groupBy("email").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("n"))
    return users.select("email").join(s, "email", "left").select("email", F.coalesce(F.floor(F.round(F.col("n") * 4 + 1, 9) + 0.5).cast("double"), F.lit(3.0)).alias("ability"))


def adaptive_difficulty(able: Column, weak_ratio: Column) -> Column:
    """The difficulty of a learner's next questions: half a level down above 0.6 weak points, up below 0.2, drawn in at both ends, 1.5 to 4.5."""
    d = F.when(weak_ratio > 0.6, F.greatest(F.lit(1.5), able - 0.5)).when(weak_ratio < 0.2, F.least(F.lit(4.5), able + 0.5)).otherwise(able)
    d = F.when(d < 2, 1.5 + (d - 1) * 0.5).when(d > 4, 4 + (d - 4) * 0.5).otherwise(d)
    return F.floor(F.round(F.least(F.greatest(d, F.lit(1.5)), F.lit(4.5)) * 10, 9) + 0.5) / 10


def distribution(difficulty: Column, minutes: Column) -> Column:
    """struct(easy, medium, hard, total) questions of a paper; a short paper has seven tenths, a long one a fifth more easy and medium ones."""
    bands = lambda i: F.coalesce(*[F.when(difficulty <= top, F.lit(n[i])) for top, n in BANDS if top], F.lit(BANDS[-1][1][i]))
    short, long = minutes < 0.8 * 120, minutes > 1.2 * 120
    cut = lambda n, least: F.greatest(F.lit(least), F.floor(F.round(n * 0.7, 9))).cast("int")
    more = lambda n: F.floor(F.round(n * 1.2, 9)).cast("int")
    e, m, h = bands(0), bands(1), bands(2)
    e, m, h = F.when(short, cut(e, 4)).when(long, more(e)).otherwise(e), F.when(short, cut(m, 3)).when(long, more(m)).otherwise(m), F.when(short, cut(h, 1)).otherwise(h)
    return F.struct(F.greatest(F.lit(2), e).alias("easy"), F.greatest(F.lit(2), m).alias("medium"), F.greatest(F.lit(1), h).alias("hard"), (e + m + h + 7).alias("total"))


def ripple(state: DataFrame, answered: DataFrame, edges: DataFrame, up: bool) -> DataFrame:
    """state(email, kp, score), answered(email, kp, score): points just answered, with their new score -> (email, kp, old, new) of points that change.

    Up: each direct prerequisite gains 2 where the new score is 80 or more, up to 100. Down: each direct dependent loses 5 where it is 40 or less, down to 0.
    A point without state gains from 0, and is made with 0 by a loss. All steps of one kind move one way, so one clamp at the end equals one after each."""
    hit = answered.where("score >= 80" if up else "score <= 40").select("email", F.col("kp").alias("k"))
    near = edges.select(F.col("src" if up else "dst").alias("k"), F.col("dst" if up else "src").alias("kp"))
    moved = hit.join(near, "k").groupBy("email", "kp").agg(F.count(F.lit(1)).alias("n")).join(state.select("email", "kp", F.col("score").alias("old")), ["email", "kp"], "left")
    old = F.coalesce("old", F.lit(0))
    return moved.select("email", "kp", "old", (F.least(F.lit(100), old + 2 * F.col("n")) if up else F.greatest(F.lit(0), old - 5 * F.col("n"))).cast("long").alias("new"))


def complete_reviews(state: DataFrame, reviews: DataFrame) -> DataFrame:
    """state(email, kp, score, ease, days), reviews(email, kp, ts, id, is_correct, time_ms) -> the review log: a row for each review of a point that
    has state, with quality, mastery, interval and ease (in hundredths) before and after it, and the next date.

    Mastery gains 12 (5 for an answer of over a minute) or loses 15; interval and ease follow SM-2. Reviews of a point are folded in (ts, id) order."""
    q = quality(F.col("is_correct"), F.coalesce("time_ms", F.lit(0)))
    gain = F.when(~F.col("is_correct"), -15).when(F.coalesce("time_ms", F.lit(0)) > 60_000, 5).otherwise(12)
    log = folds.reviews(reviews.withColumns({"q": q, "gain": gain}), ["email", "kp"], state).where("id is not null")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    return log.select("email", "kp", "id", "quality", "old_mastery", "new_mastery", "old_interval", "new_interval", cents("old_ease"), cents("new_ease"), F.date_add("d", F.col("new_interval").cast("int")).alias("next_review"))


def weak_points(wrong: DataFrame, kps: DataFrame, keywords: DataFrame) -> DataFrame:
    """wrong(email, id, ts, content, hits) as ``patterns.matched`` gives it, kps(kp, name, difficulty, frequency), keywords(kp, keyword, core)
    -> (email, kp, name, difficulty, errors, score, confidence, keywords, weakness, samples).

    A wrong question counts for a point if it holds one of its keywords: core ones weigh 2, others 1; confidence is the mean share of the point's keywords.
    weakness = score * difficulty / 3 * frequency weight. samples: the newest three questions. Questions with the same keywords are
    counted first, so what meets the points is a row for each learner and set of keywords."""
    ranked = wrong.withColumn("_r", F.row_number().over(Window.partitionBy("email", "hits").orderBy(F.desc("ts"), F.desc("id"))))
    sets = ranked.groupBy("email", "hits").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("_r") <= 3, F.struct("ts", "id", "content"))).alias("top"))
    totals = keywords.groupBy("kp").agg(F.count(F.lit(1)).alias("total"))
    # which points each set of keywords meets, and how: sets are few
    each = sets.select("hits").distinct().select("hits", F.explode("hits").alias("keyword")).join(keywords, "keyword")
    meets = each.groupBy("hits", "kp").agg(F.sum(F.when(F.col("core"), 2).otherwise(1)).alias("s"), F.count(F.lit(1)).alias("m"), F.collect_set("keyword").alias("found"))
    met = sets.join(meets, "hits").groupBy("email", "kp").agg(
        F.sum("n").alias("errors"), F.sum(F.col("s") * F.col("n")).alias("score"), F.sum(F.col("m") * F.col("n")).alias("parts"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("keywords"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, 3).alias("samples"))
    weight = F.coalesce(*[F.when(F.col("frequency") == k, F.lit(v)) for k, v in FREQUENCY.items()], F.lit(1.0))
    out = met.join(kps.select("kp", "name", "difficulty", "frequency"), "kp").join(totals, "kp")
    return out.select(
        "email", "kp", "name", "difficulty", "errors", "score", (F.col("parts") / F.col("errors") / F.col("total")).alias("confidence"), "keywords",
        (F.col("score") * (F.col("difficulty") / 3) * weight).alias("weakness"), "samples")


def weak_level(wrong_count: Column, accuracy: Column) -> Column:
    """How weak a point is, from wrong answers and accuracy (0 to 1; none or 0 says nothing)."""
    return F.when(wrong_count >= 5, "critical").when(wrong_count >= 3, "high").when(wrong_count >= 1, "medium").when((accuracy > 0) & (accuracy < 0.6), "warning").otherwise("normal")


def weakest(users: DataFrame, wrong: DataFrame, practice: DataFrame, kps: DataFrame, most: int = 10) -> DataFrame:
    """users(email), wrong(email, kp), practice(email, kp, is_correct), kps(kp) -> (email, position, kp, wrong_count, practice_count, accuracy, level):
    each learner's ``most`` points, those never answered wrongly first (nulls first), then by wrong answers, then by accuracy, unseen last, then by kp.

    Of points without wrong answers at most ``most`` can be in the list, so it takes the first of those instead of every pair of a learner and a point."""
    w = wrong.groupBy("email", "kp").agg(F.count(F.lit(1)).alias("wrong_count"))
    p = practice.groupBy("email", "kp").agg(F.count(F.lit(1)).alias("practice_count"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    seen = p.join(w, ["email", "kp"], "full_outer").join(kps.select("kp"), "kp", "left_semi")
    mine = seen.groupBy("email").agg(F.collect_set("kp").alias("mine"))
    all_points = kps.select("kp").distinct().agg(F.array_sort(F.collect_list("kp")).alias("all"))  # one row; points are a dictionary
    # points that were never seen: the first in order, ``most`` at most
    unseen = users.select("email").join(mine.select("email", "mine"), "email", "left").crossJoin(F.broadcast(all_points))
    known = F.coalesce("mine", F.array().cast("array<long>"))
    # who has seen s points finds ``most`` others among the first most + s
    rest = F.slice(F.array_except(F.slice("all", F.lit(1), F.size(known) + most), known), 1, most)
    unseen = unseen.select("email", F.explode(rest).alias("kp")).withColumns({"wrong_count": F.lit(None).cast("long"), "practice_count": F.lit(None).cast("long"), "accuracy": F.lit(None).cast("double")})
    rows = seen.select("email", "kp", "wrong_count", "practice_count", "accuracy").unionByName(unseen)
    order = [F.col("wrong_count").desc_nulls_first(), F.col("accuracy").asc_nulls_last(), F.col("kp")]
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("email").orderBy(*order))).where(F.col("position") <= most)
    n = F.coalesce("wrong_count", F.lit(0))
    return rows.select("email", "position", "kp", n.alias("wrong_count"), F.coalesce("practice_count", F.lit(0)).alias("practice_count"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), weak_level(n, F.coalesce("accuracy", F.lit(0.0))).alias("level"))


def subject_shares(wrong: DataFrame) -> DataFrame:
    """wrong(email, subject) -> (email, subject, n, share): share of the learner's wrong answers in per cent, one decimal."""
    n = wrong.groupBy("email", "subject").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.floor(1000 * F.col("n") / F.sum("n").over(Window.partitionBy("email")) + 0.5) / 10)


def daily(practice: DataFrame, last: int = 7) -> DataFrame:
    """practice(email, ts, is_correct) -> (email, day, n, accuracy) of the last days with answers."""
    d = practice.groupBy("email", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("email").orderBy(F.desc("day")))).where(F.col("r") <= last).drop("r")


def monthly(practice: DataFrame, last: int = 6) -> DataFrame:
    m = practice.groupBy("email", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("email").orderBy(F.desc("month")))).where(F.col("r") <= last).drop("r")


def dashboard(users: DataFrame, wrong: DataFrame, practice: DataFrame, kps: DataFrame) -> dict[str, DataFrame]:
    """The parts of a learner's dashboard by name: overview, subjects, daily, monthly, weak_points, suggestions."""
    shares, days, weak = subject_shares(wrong), daily(practice), weakest(users, wrong, practice, kps)
    w = wrong.groupBy("email").agg(F.count(F.lit(1)).alias("wrong_questions"))
    d = days.groupBy("email").agg(F.sum("n").alias("practised"), F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("days"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    overview = users.select("email").join(w, "email", "left").join(d, "email", "left").select("email", zero("wrong_questions"), zero("practised"), zero("days"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    return {"overview": overview, "subjects": shares, "daily": days, "monthly": monthly(practice), "weak_points": weak, "suggestions": suggestions(users, weak, shares)}


def suggestions(users: DataFrame, weak: DataFrame, shares: DataFrame) -> DataFrame:
    """(email, position, type, n): critical points, then the first subject with over 30 per cent of wrong answers (n: its share), then points practised three
    times with under 70 per cent right; success if none of these."""
    w = weak.groupBy("email").agg(F.count_if(critical()).alias("critical"), F.count_if(low()).alias("low"))
    s = shares.where("share > 30").groupBy("email").agg(F.min_by("share", "subject").alias("share"))
    u = users.select("email").join(w, "email", "left").join(s, "email", "left")
    return u.select("email", F.posexplode(said("critical", "share", "low")).alias("position", "x")).select("email", (F.col("position") + 1).cast("long").alias("position"), "x.type", "x.n")


def critical() -> Column:
    return F.col("level") == "critical"


def low() -> Column:
    return (F.col("practice_count") >= 3) & (F.col("accuracy") > 0) & (F.floor(F.col("accuracy") * 1000 + 0.5) < 700)


def said(critical: str, share: str, low: str) -> Column:
    """What is suggested, in order, for these figures of a learner; null is none."""
    rules = (("critical", F.col(critical) > 0, critical), ("warning", F.col(share).isNotNull(), share), ("info", F.col(low) > 0, low))
    some = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.col(n).cast("double").alias("n"))) for t, c, n in rules]), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.struct(F.lit("success").alias("type"), F.lit(0.0).alias("n"))))


def phases(users: DataFrame, weak: DataFrame) -> DataFrame:
    """users(email), weak(email, kp, name, difficulty, weakness) -> (email, phase, week, level, topics): up to three easy, three medium and two hard points
    (a point may be in two), then the five weakest; two general weeks for a learner without weak points. Weakest first, ties by kp."""
    ranked = lambda cond, most: F.slice(F.transform(F.filter("points", cond), lambda x: x["name"]), 1, most)
    points = weak.groupBy("email").agg(F.array_sort(F.collect_list(F.struct((-F.col("weakness")).alias("o"), "kp", "name", "difficulty"))).alias("points"))
    u = users.select("email").join(points, "email", "left")
    none = F.array().cast("array<string>")
    parts = [(1, "easy", ranked(lambda x: x["difficulty"] <= 3, 3)), (2, "medium", ranked(lambda x: x["difficulty"].between(3, 4), 3)), (3, "hard", ranked(lambda x: x["difficulty"] >= 4, 2))]
    make = lambda week, level, topics: F.struct(F.lit(week).alias("week") if isinstance(week, int) else week.alias("week"), F.lit(level).alias("level"), topics.alias("topics"))
    some = F.filter(F.array(*[F.when(F.size(t) > 0, make(w, n, t)) for w, n, t in parts]), lambda x: x.isNotNull())
    last = make((F.size(some) + 1), "comprehensive", ranked(lambda x: F.lit(True), 5))
    general = F.array(make(1, "medium", none), make(2, "hard", none))
    plan = F.when(F.col("points").isNull(), general).otherwise(F.concat(some, F.array(last)))
    return u.select("email", F.posexplode(plan).alias("phase", "x")).select("email", (F.col("phase") + 1).cast("long").alias("phase"), F.col("x.week").cast("long").alias("week"), "x.level", "x.topics")


def badges(stats: DataFrame) -> DataFrame:
    """stats(email and the figures that BADGES names) -> (email, badge, current, target, percent, earned) of every badge."""
    rows = F.array(*[F.struct(F.lit(b).alias("badge"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("current"), F.lit(float(t)).alias("target")) for b, c, t in BADGES])
    x = stats.select("email", F.explode(rows).alias("x")).select("email", "x.*")
    return x.withColumn("percent", F.least(F.lit(100), F.floor(F.col("current") / F.col("target") * 100)).cast("int")).withColumn("earned", F.col("current") >= F.col("target"))


def trend_summary(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """papers(id, province, yr), questions(paper_id, kp, qtype, difficulty) -> a row for each province: years, papers, its three most asked points,
    its main type with count, mean difficulty of yearly means, and the label easy below 2.5, medium below 3.5, else hard."""
    p = papers.select(F.col("id").alias("paper_id"), "province", "yr")
    q = questions.select("paper_id", "kp", "qtype", "difficulty").join(p, "paper_id")
    top = q.groupBy("province", "kp").agg(F.count(F.lit(1)).alias("n"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("province").orderBy(F.desc("n"), "kp"))).where("r <= 3").groupBy("province").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "kp"))), lambda x: x["kp"].cast("string")), ",").alias("top_points"))
    kind = q.groupBy("province", "qtype").agg(F.count(F.lit(1)).alias("n")).groupBy("province").agg(F.max(F.struct(F.col("n"), F.col("qtype"))).alias("t"))
    yearly = q.groupBy("province", "yr").agg(F.avg("difficulty").alias("d")).groupBy("province").agg(F.avg("d").alias("d"))
    out = p.groupBy("province").agg(F.countDistinct("yr").alias("years"), F.count(F.lit(1)).alias("papers")).join(top, "province", "left").join(kind, "province", "left").join(yearly, "province", "left")
    return out.select("province", "years", "papers", "top_points", F.col("t.qtype").alias("main_type"), F.col("t.n").alias("main_count"), F.round("d", 4).alias("avg_difficulty"), F.when(F.col("d") < 2.5, "easy").when(F.col("d") < 3.5, "medium").when(F.col("d").isNotNull(), "hard").alias("label"))


def recover_stale(tasks: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """tasks(.., status, updated_at): those in processing for over ``minutes`` are pending again, as of now."""
    stale = F.coalesce((F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))
    return tasks.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))})


def finish_tasks(tasks: DataFrame, outcomes: DataFrame, now: Column, attempts: int = 3) -> DataFrame:
    """tasks(id, status, retry_count, updated_at), outcomes(id, ok): a task in processing is completed, or pending again, or failed after ``attempts``."""
    t = tasks.join(outcomes.select("id", "ok"), "id", "left")
    ran = (F.col("status") == "processing") & F.col("ok").isNotNull()
    again = F.col("retry_count") + 1 < attempts
    status = F.when(~ran, F.col("status")).when(F.col("ok"), "completed").when(again, "pending").otherwise("failed")
    retries = F.when(ran & ~F.col("ok") & again, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    return t.select("id", F.coalesce(status, F.col("status")).alias("status"), F.coalesce(retries, F.col("retry_count")).alias("retry_count"), F.when(ran, now).otherwise(F.col("updated_at")).alias("updated_at"))


def job_states(changes: DataFrame) -> DataFrame:
    """changes(job, ts, id, status, processed, failed, error) -> the state of each job: last status and time, last figures that were given, when it last
    started running and when it last ended."""
    by = F.struct("ts", "id")
    last = lambda c, cond: F.max_by(F.when(cond, F.col(c)), F.when(cond, by))
    known = lambda c: last(c, F.col(c).isNotNull()).alias(c)
    return changes.groupBy("job").agg(
        F.max_by("status", by).alias("status"), F.max("ts").alias("updated_at"), known("processed"), known("failed"), known("error"),
        F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("completed_at"))


def grade_exam(sessions: DataFrame, answers: DataFrame, questions: DataFrame, wrong: DataFrame) -> dict[str, DataFrame]:
    """sessions(session, email, subject), answers(session, question, answer), questions(question, subject, answer, score), wrong(email, question)
    -> sessions: (session, email, questions, correct, earned, total, accuracy, points); wrong: rows (email, question, session) to add to the log.

    Only questions of the session's subject count; answers are compared without case and blanks at the ends, and an empty one is wrong;
    a question without a score counts 5. A learner's wrong question is logged once."""
    s = sessions.select("session", "email", F.col("subject").alias("_s"))
    q = questions.select("question", F.col("subject").alias("_s"), F.col("answer").alias("_right"), "score")
    a = answers.join(s, "session").join(q, ["question", "_s"])
    low = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    score = F.when(F.coalesce("score", F.lit(0)) == 0, 5).otherwise(F.col("score"))
    a = a.withColumn("ok", F.coalesce(low("answer") == low("_right"), F.lit(False))).withColumn("score", score.cast("long"))
    g = a.groupBy("session", "email").agg(F.count(F.lit(1)).alias("questions"), F.count_if("ok").alias("correct"), F.sum(F.when(F.col("ok"), F.col("score")).otherwise(0)).alias("earned"), F.sum("score").alias("total"))
    g = g.withColumn("accuracy", F.floor(1000 * F.col("earned") / F.col("total") + 0.5) / 10).withColumn("points", (F.floor(F.col("earned") / 5) + 10).cast("long"))
    new = a.where("not ok").groupBy("email", "question").agg(F.min("session").alias("session")).join(wrong.select("email", "question").distinct(), ["email", "question"], "left_anti")
    return {"sessions": g, "wrong": new}
