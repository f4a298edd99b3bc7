"""Relational reads: filters, visibility, ranked lists, pages, details and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTS = {
    "score_desc": ("score", True),
    "score_asc": ("score", False),
    "created_at_desc": ("created_at", True),
    "created_at_asc": ("created_at", False),
}


def order(sort: str = "score_desc") -> list[Column]:
    """Sort keys of a mode (the best score first by default), ties by id."""
    name, down = SORTS.get(sort, SORTS["score_desc"])
    return [F.col(name).desc() if down else F.col(name).asc(), F.col("id").asc()]


def match_filter(matches: DataFrame, *, cv_id=None, job_id=None, session_id=None, unassigned_only=False, min_score=None, max_score=None, search=None, search_in=()) -> DataFrame:
    """Only the conditions that are given; bounds count in; % and _ of a search keep their meaning."""
    out = matches
    for name, value in (("cv_id", cv_id), ("job_id", job_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if session_id is not None:
        out = out.filter((F.col("cv_session_id") == session_id) & (F.col("job_session_id") == session_id))
    if unassigned_only:
        out = out.filter(F.col("cv_session_id").isNull() & F.col("job_session_id").isNull())
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    if max_score is not None:
        out = out.filter(F.col("score") <= max_score)
    return out.filter(ilike_any(search, *search_in)) if search else out


def ilike_any(term: str, *columns: str) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).ilike(f"%{term}%")
    return test


def eligible(a: Column, b: Column) -> Column:
    """Either owner missing, or the same."""
    return a.isNull() | b.isNull() | (a == b)


def visible_active(docs: DataFrame, user_id: int | Column) -> DataFrame:
    return docs.filter(F.col("owner_id").isNull() | (F.col("owner_id") == user_id))


def visible_sessions(sessions: DataFrame, users: DataFrame, user_id: int, rank: int) -> DataFrame:
    """One's own archives and those of lower ranks; unclaimed ones only above rank 0."""
    lower = users.filter((F.col("rank") < rank) | (F.col("id") == user_id)).select(F.col("id").alias("owner_id"))
    seen = sessions.join(lower, "owner_id", "left_semi")
    return seen.unionByName(sessions.filter(F.col("owner_id").isNull())) if rank > 0 else seen


def without_invisible(matches: DataFrame, hidden_cvs: DataFrame, hidden_jobs: DataFrame) -> DataFrame:
    """Null-safe NOT IN on either side."""
    out = matches.join(hidden_cvs.select(F.col("id").alias("cv_id")), "cv_id", "left_anti")
    return out.join(hidden_jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def star(matches: DataFrame, cvs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Matches with both documents' columns, prefixed."""
    named = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    return matches.join(named(cvs, "cv"), "cv_id").join(named(jobs, "job"), "job_id")


def with_text(docs: DataFrame, extracted: DataFrame, key: str = "path") -> DataFrame:
    return docs.join(extracted, key, "left")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last row of each match."""
    w = Window.partitionBy("match_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return feedback.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unreviewed(matches: DataFrame, feedback: DataFrame) -> DataFrame:
    return matches.join(feedback.select(F.col("match_id").alias("id")), "id", "left_anti")


def best_per_person(matches: DataFrame, sort: str = "score_desc", within: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """The first match of each person in the sort's order, per offer; a CV without a person key stands for itself."""
    key = F.coalesce(F.col("person_key"), F.concat(F.lit("#"), F.col("cv_id").cast("string")))
    w = Window.partitionBy(*within, key).orderBy(*order(sort))
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(rows: DataFrame, number: int, size: int, sort: str = "score_desc", largest: int = 100) -> DataFrame:
    """One page of the sorted rows; the size is clamped to [1, largest]."""
    size = max(1, min(size, largest))
    return rows.orderBy(*order(sort)).offset((max(1, number) - 1) * size).limit(size)


def top(rows: DataFrame, k: int, sort: str = "score_desc") -> DataFrame:
    return rows.orderBy(*order(sort)).limit(max(1, min(k, 200)))


def list_matches(matches: DataFrame, feedback: DataFrame, *, number: int = 1, size: int = 20, sort: str = "score_desc", **filters) -> DataFrame:
    """The ranked read: filter, one match a person where one offer is asked for, page, then the latest feedback."""
    rows = match_filter(matches, **filters)
    if filters.get("job_id") is not None and filters.get("cv_id") is None:
        rows = best_per_person(rows, sort)
    last = latest_feedback(feedback).select(F.col("match_id").alias("id"), "decision", "rating")
    return page(rows, number, size, sort).join(last, "id", "left").orderBy(*order(sort))


def document_detail(matches: DataFrame, doc: str, k: int = 10, keywords: int = 12) -> DataFrame:
    """For each document: matches and mean score over all, and the most frequent keywords of its ``k`` best matches."""
    whole = matches.groupBy(doc).agg(F.count("*").alias("n_matches"), F.avg("score").alias("avg_score"))
    best = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col("id"))
    few = matches.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
    words = few.select(doc, F.explode("keywords").alias("word")).groupBy(doc, "word").agg(F.count("*").alias("n"))
    ranked = words.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(F.col("n").desc(), "word"))).filter(F.col("_n") <= keywords)
    lists = ranked.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]).alias("top_keywords"))
    return whole.join(lists, doc, "left")


def counterparts(matches: DataFrame, doc: str, other: str) -> DataFrame:
    """How many different fully scored counterparts each document has."""
    return matches.filter(F.col("score_skills").isNotNull()).groupBy(doc).agg(F.countDistinct(other).alias("n_counterparts"))


def progress(matches: DataFrame, cvs: DataFrame, jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: active documents on both sides, matches expected, computed and not yet reviewed."""
    active = lambda d: d.filter(F.col("session_id").isNull())
    a, b = (active(d).agg(F.count("*").alias(n)) for d, n in ((cvs, "active_cv"), (jobs, "active_job")))
    live = matches.join(active(cvs).select(F.col("id").alias("cv_id")), "cv_id", "left_semi").join(active(jobs).select(F.col("id").alias("job_id")), "job_id", "left_semi")
    c = live.agg(F.count("*").alias("computed"))
    d = unreviewed(live, feedback).agg(F.count("*").alias("unreviewed"))
    one = [x.withColumn("_k", F.lit(1)) for x in (a, b, c, d)]
    out = one[0].join(one[1], "_k").join(one[2], "_k").join(one[3], "_k").drop("_k")
    return out.withColumn("expected", F.col("active_cv") * F.col("active_job"))


def health(cvs: DataFrame, jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """(name, value): documents in all, active and archived, and matches between active ones."""

    def split(d: DataFrame, name: str) -> DataFrame:
        on = F.col("session_id").isNull()
        row = d.agg(F.count("*").alias("a"), F.count(F.when(on, 1)).alias("b"), F.count(F.when(~on, 1)).alias("c"))
        return row.select(F.expr(f"stack(3, '{name}_total', a, 'active_{name}', b, 'archived_{name}', c) as (name, value)"))

    live = matches.join(cvs.filter("session_id is null").select(F.col("id").alias("cv_id")), "cv_id", "left_semi")
    live = live.join(jobs.filter("session_id is null").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return split(cvs, "cv").unionByName(split(jobs, "job")).unionByName(live.agg(F.lit("active_match").alias("name"), F.count("*").alias("value")))


def session_counts(sessions: DataFrame, cvs: DataFrame, jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """cv, job and match counts of every session; a match counts where both its documents are in it."""
    per = lambda d, n: d.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias(n))
    both = matches.join(cvs.select(F.col("id").alias("cv_id"), "session_id"), "cv_id").join(jobs.select(F.col("id").alias("job_id"), F.col("session_id").alias("_s")), "job_id")
    m = both.filter("session_id = _s").groupBy("session_id").agg(F.count("*").alias("match_count"))
    out = sessions.join(per(cvs, "cv_count"), "session_id", "left").join(per(jobs, "job_count"), "session_id", "left").join(m, "session_id", "left")
    return out.na.fill(0, ["cv_count", "job_count", "match_count"])


def date_bucket(ts: Column, today: Column) -> Column:
    """today, yesterday, this week (from Monday), last week, or the year."""
    d, week = F.to_date(ts), F.to_date(F.date_trunc("week", today))
    days = F.datediff(F.to_date(today), d)
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(d >= week, "this week").when(d >= F.date_sub(week, 7), "last week").otherwise(F.year(d).cast("string"))


def active_ratio(active: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * active / total)).otherwise(0.0)


def listing_diff(remote: DataFrame, local: DataFrame, key: str = "path") -> DataFrame:
    """(key, action): local entries to upload, remote ones to delete."""
    up = local.join(remote.select(key), key, "left_anti").select(key, F.lit("upload").alias("action"))
    return up.unionByName(remote.join(local.select(key), key, "left_anti").select(key, F.lit("delete").alias("action")))
