"""Queries of filters, joins, aggregates, windows, sorts and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchengine.operators import fields, merge, reads
from matchengine.operators import feedback as fb
from matchengine.plans.bindings import CVS, FEEDBACK, JOBS, MATCHES, cvs, feedback, jobs, matches, reviews
from matchengine.registry import query, table

M, J, C, FB = f"({MATCHES})", f"({JOBS})", f"({CVS})", f"({FEEDBACK})"
R4 = lambda c, name=None: F.round(c, 4).alias(name or c)


@query("c_filter_ilike", "select p_partkey, p_name, p_brand from part where p_name ilike '%an%' or p_type ilike '%brushed%'")
def c_filter_ilike(spark, d):
    return table(spark, d, "part").filter(reads.ilike_any("an", "p_name") | reads.ilike_any("brushed", "p_type")).select("p_partkey", "p_name", "p_brand")


@query("c_filter_range", f"select id, cv_id, job_id, score from {M} where score >= 20 and score <= 60")
def c_filter_range(spark, d):
    return reads.match_filter(matches(spark, d), min_score=20, max_score=60).select("id", "cv_id", "job_id", "score")


@query("c_unassigned", f"select m.id, m.score from {M} m join {C} c on c.id = m.cv_id join {J} j on j.id = m.job_id where c.session_id is null and j.session_id is null")
def c_unassigned(spark, d):
    return reads.match_filter(reads.star(matches(spark, d), cvs(spark, d), jobs(spark, d)), unassigned_only=True).select("id", "score")


@query("c_session", f"select m.id, m.score from {M} m join {C} c on c.id = m.cv_id join {J} j on j.id = m.job_id where c.session_id = 45 and j.session_id = 45")
def c_session(spark, d):
    return reads.match_filter(reads.star(matches(spark, d), cvs(spark, d), jobs(spark, d)), session_id=45).select("id", "score")


@query("c_status_active", "select o_orderkey as id from orders where o_orderstatus = 'O' and (case when o_orderstatus = 'F' then 1 end) is null")
def c_status_active(spark, d):
    return jobs(spark, d).filter("session_id is null and status = 'O'").select("id")


@query("c_label_default", "select page_id, coalesce(nullif(trim(''), ''), regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1)) as label from pages")
def c_label_default(spark, d):
    from matchengine.functions.text import label

    return table(spark, d, "pages").select("page_id", label(F.lit(" "), "url").alias("label"))


@query("c_owner_visibility", f"select id from {J} where owner_id is null or owner_id = 7")
def c_owner_visibility(spark, d):
    return reads.visible_active(jobs(spark, d), 7).select("id")


USERS = "(select c_custkey as id, c_nationkey % 3 as rank from customer)"


@query("c_archive_visibility", f"select id from {J} where session_id is not null and (owner_id in (select id from {USERS} where rank < 2 or id = 5) or owner_id is null)")
def c_archive_visibility(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("rank"))
    return reads.visible_sessions(jobs(spark, d).filter("session_id is not null"), users, 5, 2).select("id")


@query("d_star_join", f"select m.id, c.name as cv_name, j.title as job_title from {M} m join {C} c on c.id = m.cv_id join {J} j on j.id = m.job_id")
def d_star_join(spark, d):
    return reads.star(matches(spark, d), cvs(spark, d), jobs(spark, d)).select("id", "cv_name", "job_title")


@query("d_left_text", "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def d_left_text(spark, d):
    return reads.with_text(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("d_anti_invisible", f"select id from {M} m where cv_id not in (select id from {C} where years > 45) and job_id not in (select id from {J} where status = 'P')")
def d_anti_invisible(spark, d):
    return reads.without_invisible(matches(spark, d), cvs(spark, d).filter("years > 45"), jobs(spark, d).filter("status = 'P'")).select("id")


@query("d_semi_roles", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def d_semi_roles(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("d_not_exists", "select o_orderkey as id from orders o where not exists (select 1 from events e where e.user_id = o.o_orderkey)")
def d_not_exists(spark, d):
    return reads.unreviewed(jobs(spark, d), reviews(spark, d)).select("id")


@query(
    "d_owner_theta",
    "select l.s_suppkey as cv_id, r.c_custkey as job_id from supplier l join customer r on (case when l.s_nationkey > 1 then l.s_nationkey end) is null "
    "or (case when r.c_nationkey > 1 then r.c_nationkey end) is null or l.s_nationkey = r.c_nationkey",
)
def d_owner_theta(spark, d):
    from matchengine.operators.pairs import eligible_pairs

    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 1, F.col("s_nationkey")).alias("owner_id"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") > 1, F.col("c_nationkey")).alias("owner_id"))
    return eligible_pairs(a, b)


@query("d_feedback_match", f"select m.id, f.decision, f.rating from {FB} f join {M} m on f.match_id = m.id")
def d_feedback_match(spark, d):
    return feedback(spark, d).join(matches(spark, d).select(F.col("id").alias("match_id")), "match_id").select(F.col("match_id").alias("id"), "decision", "rating")


@query("d_listing_diff", "select p_partkey as path, 'upload' as action from part where p_partkey not in (select l_partkey from lineitem) union all select distinct l_suppkey + 1000000 as path, 'delete' as action from lineitem where l_suppkey + 1000000 not in (select p_partkey from part)")
def d_listing_diff(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    remote = l.select(F.col("l_partkey").alias("path")).union(l.select((F.col("l_suppkey") + 1000000).alias("path"))).distinct()
    return reads.listing_diff(remote, table(spark, d, "part").select(F.col("p_partkey").alias("path")))


@query("e_feedback_by_decision", f"select decision, n, round(100.0 * n / sum(n) over (), 4) as pct, round(a, 4) as avg_rating from (select decision, count(*) as n, avg(rating) as a from {FB} group by 1)")
def e_feedback_by_decision(spark, d):
    return fb.by_decision(feedback(spark, d)).select("decision", "n", R4("pct"), R4("avg_rating"))


@query("e_component_avg", f"select decision, round(avg(skills), 4) as skills, round(avg(experience), 4) as experience, round(avg(score), 4) as score from {FB} group by 1")
def e_component_avg(spark, d):
    return fb.component_means(feedback(spark, d), ["skills", "experience", "score"]).select("decision", R4("skills"), R4("experience"), R4("score"))


@query(
    "e_domain_pivot",
    f"select domain, count(*) as total, count(*) filter (decision = 'accept') as accept, count(*) filter (decision = 'reject') as reject, count(*) filter (decision = 'review') as review, "
    f"round(avg(score) filter (decision = 'accept'), 4) as avg_score from {FB} where domain is not null group by 1",
)
def e_domain_pivot(spark, d):
    return fb.domain_table(feedback(spark, d)).withColumn("avg_score", F.round("avg_score", 4))


@query(
    "e_weight_hints",
    "with m as (select " + ", ".join(f"avg({c}) filter (decision = 'accept') - avg({c}) filter (decision = 'reject') as {c}" for c in ("skills", "experience")) + f" from {FB}) "
    "select 'skills' as component, round(skills, 6) as delta from m union all select 'experience', round(experience, 6) from m",
)
def e_weight_hints(spark, d):
    return fb.weight_hints(feedback(spark, d), ["skills", "experience"]).select("component", F.round("delta", 6).alias("delta"))


@query("e_mean_of_means", f"select round(avg(a), 4) as rating from (select avg(rating) as a from {FB} group by decision)")
def e_mean_of_means(spark, d):
    return fb.mean_of_means(feedback(spark, d)).select(R4("rating"))


@query(
    "e_doc_detail",
    f"""with m as (select job_id, id, score, string_split(p_name, ' ') as kw from {M} m join part on p_partkey = m.cv_id),
    b as (select *, row_number() over (partition by job_id order by score desc, id) as n from m),
    k as (select job_id, w, count(*) as c from (select job_id, unnest(kw) as w from b where n <= 3) group by 1, 2),
    r as (select *, row_number() over (partition by job_id order by c desc, w) as n from k)
    select m.job_id, count(*) as n_matches, round(avg(score) + 1e-7, 4) as avg_score, any_value(t.t) as top_keywords
    from m left join (select job_id, string_agg(w, ',' order by n) as t from r where n <= 5 group by 1) t on t.job_id = m.job_id group by 1""",
)
def e_doc_detail(spark, d):
    m = matches(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("cv_id"), F.split("p_name", " ").alias("keywords")), "cv_id")
    out = reads.document_detail(m, "job_id", 3, 5)
    return out.select("job_id", "n_matches", F.round(F.col("avg_score") + 1e-7, 4).alias("avg_score"), F.array_join("top_keywords", ",").alias("top_keywords"))


@query("e_count_distinct", f"select cv_id, count(distinct job_id) as n_counterparts from {M} where score_skills is not null group by 1")
def e_count_distinct(spark, d):
    return reads.counterparts(matches(spark, d), "cv_id", "job_id")


LIVE = f"(select m.* from {M} m join {C} c on c.id = m.cv_id and c.session_id is null join {J} j on j.id = m.job_id and j.session_id is null)"


@query(
    "e_progress",
    f"select (select count(*) from {C} where session_id is null) as active_cv, (select count(*) from {J} where session_id is null) as active_job, count(*) as computed, "
    f"count(*) filter (id not in (select user_id from events)) as unreviewed, (select count(*) from {C} where session_id is null) * (select count(*) from {J} where session_id is null) as expected from {LIVE}",
)
def e_progress(spark, d):
    return reads.progress(matches(spark, d), cvs(spark, d), jobs(spark, d), reviews(spark, d))


@query(
    "e_health",
    " union all ".join(
        f"select '{n}_total' as name, count(*) as value from {t} union all select 'active_{n}', count(*) from {t} where session_id is null union all select 'archived_{n}', count(*) from {t} where session_id is not null"
        for n, t in (("cv", C), ("job", J))
    )
    + f" union all select 'active_match', count(*) from {LIVE}",
)
def e_health(spark, d):
    return reads.health(cvs(spark, d), jobs(spark, d), matches(spark, d))


@query(
    "e_session_counts",
    f"""select s.session_id, (select count(*) from {C} c where c.session_id = s.session_id) as cv_count, (select count(*) from {J} j where j.session_id = s.session_id) as job_count,
    (select count(*) from {M} m join {C} c on c.id = m.cv_id join {J} j on j.id = m.job_id where c.session_id = j.session_id and c.session_id = s.session_id) as match_count
    from (select distinct session_id from {J} where session_id is not null) s""",
)
def e_session_counts(spark, d):
    s = jobs(spark, d).filter("session_id is not null").select("session_id").distinct()
    return reads.session_counts(s, cvs(spark, d), jobs(spark, d), matches(spark, d))


@query("e_core_repeat", "select user_id as id, event_type as canonical, count(*) as n from events group by 1, 2 having count(*) >= 3")
def e_core_repeat(spark, d):
    from matchengine.operators.skills import repeated

    return repeated(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("canonical")))


YEARS = "(select o_custkey, o_orderkey, cast(year(o_orderdate) as int) + o_orderkey % 30 as a, cast(year(o_orderdate) as int) + o_orderkey % 30 + o_orderkey % 3 as b from orders)"


@query(
    "e_interval_merge",
    f"""with t as (select *, max(b) over (partition by o_custkey order by a, b rows between unbounded preceding and 1 preceding) as p from {YEARS}),
    i as (select *, sum(case when p is null or a > p + 1 then 1 else 0 end) over (partition by o_custkey order by a, b rows unbounded preceding) as g from t)
    select o_custkey, cast(sum(n) as bigint) as covered from (select o_custkey, g, max(b) - min(a) as n from i group by 1, 2) group by 1""",
)
def e_interval_merge(spark, d):
    o = table(spark, d, "orders")
    a = F.year("o_orderdate") + F.col("o_orderkey") % 30
    return fields.merged_intervals(o.select("o_custkey", a.alias("a"), (a + F.col("o_orderkey") % 3).alias("b")), "o_custkey", "a", "b")


@query("f_latest", "select user_id as match_id, event_id as id, event_type as decision from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def f_latest(spark, d):
    return reads.latest_feedback(reviews(spark, d)).select("match_id", "id", "decision")


@query("f_carry_forward", "select event_id as id, last_value(r ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as rating from (select *, case when event_type = 'purchase' then least(5, greatest(1, cast(floor(value) as int))) end as r from events)")
def f_carry_forward(spark, d):
    r = reviews(spark, d).withColumn("rating", F.when(F.col("decision") == "purchase", F.floor("rating").cast("int")))
    return fb.carried(r).select("id", "rating")


@query("f_person_dedupe", f"select id, job_id, cv_id, score from (select m.*, row_number() over (partition by job_id, coalesce(person_key, '#' || cv_id) order by score desc, m.id) as n from {M} m join {C} c on c.id = m.cv_id) where n = 1")
def f_person_dedupe(spark, d):
    m = matches(spark, d).join(cvs(spark, d).select(F.col("id").alias("cv_id"), "person_key"), "cv_id")
    return reads.best_per_person(m).select("id", "job_id", "cv_id", "score")


@query("f_prev_dedupe", "select event_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p <> event_type")
def f_prev_dedupe(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("event_type").over(w))
    return e.filter(F.col("p").isNull() | (F.col("p") != F.col("event_type"))).select("event_id")


@query("g_topk", f"select id, score from {M} order by score desc, id limit 25")
def g_topk(spark, d):
    return reads.top(matches(spark, d).select("id", "score"), 25)


@query("g_page", f"select id, score from {M} order by created_at asc, id limit 20 offset 40")
def g_page(spark, d):
    return reads.page(matches(spark, d), 3, 20, "created_at_asc").select("id", "score")


@query("g_newest", "select event_id as id, event_type from events order by event_id desc limit 200")
def g_newest(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return e.orderBy(F.col("id").desc()).limit(200)


@query(
    "g_list_matches",
    f"""with p as (select id, score, row_number() over (partition by coalesce(person_key, '#' || cv_id) order by score desc, m_id) as n from (select m.id, m.id as m_id, m.score, m.cv_id, c.person_key from {M} m join {C} c on c.id = m.cv_id where job_id = 1)),
    g as (select id, score from p where n = 1 order by score desc, id limit 20), f as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
    select g.id, g.score, f.event_type as decision from g left join f on f.user_id = g.id and f.n = 1""",
)
def g_list_matches(spark, d):
    m = matches(spark, d).join(cvs(spark, d).select(F.col("id").alias("cv_id"), "person_key"), "cv_id")
    return reads.list_matches(m, reviews(spark, d), job_id=1).select("id", "score", "decision")


@query("i_buckets", "select event_id, case when date_diff('day', cast(ts as date), date '2024-07-01') = 0 then 'today' when date_diff('day', cast(ts as date), date '2024-07-01') = 1 then 'yesterday' when cast(ts as date) >= date '2024-07-01' then 'this week' when cast(ts as date) >= date '2024-06-24' then 'last week' else cast(year(ts) as varchar) end as bucket from events")
def i_buckets(spark, d):
    return table(spark, d, "events").select("event_id", reads.date_bucket(F.col("ts"), F.lit("2024-07-01").cast("timestamp_ntz")).alias("bucket"))


@query("i_active_ratio", f"select owner_id, case when count(*) > 0 then round(100.0 * count(*) filter (session_id is null) / count(*)) else 0 end as ratio from {J} group by 1")
def i_active_ratio(spark, d):
    g = jobs(spark, d).groupBy("owner_id").agg(F.count(F.when(F.col("session_id").isNull(), 1)).alias("a"), F.count("*").alias("n"))
    return g.select("owner_id", reads.active_ratio(F.col("a"), F.col("n")).alias("ratio"))


OLD = f"(select id, score, score_skills from {M} where l_returnflag <> 'N')"
NEW = f"(select id, score + 1 as score, case when l_suppkey % 2 = 0 then score_experience end as score_skills from {M} where l_returnflag <> 'A')"


@query("b_upsert_keep_components", f"select coalesce(n.id, o.id) as id, case when n.id is not null then n.score else o.score end as score, coalesce(n.score_skills, o.score_skills) as score_skills from {OLD} o full join {NEW} n on o.id = n.id")
def b_upsert_keep_components(spark, d):
    m = matches(spark, d)
    new = m.filter("l_returnflag <> 'A'").select("id", (F.col("score") + 1).alias("score"), F.when(F.col("l_suppkey") % 2 == 0, F.col("score_experience")).alias("score_skills"))
    return merge.upsert(m.filter("l_returnflag <> 'N'").select("id", "score", "score_skills"), new, ["id"], ("score_skills",))


@query("b_embedding_upsert", "select n.p_partkey as id, n.p_type as content_hash from part n left join (select p_partkey, case when p_size % 2 = 0 then p_type when p_size % 3 = 0 then null else 'x' end as h from part where p_size > 5) o on n.p_partkey = o.p_partkey where o.p_partkey is null or o.h is distinct from n.p_type")
def b_embedding_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.expr("case when p_size % 2 = 0 then p_type when p_size % 3 = 0 then null else 'x' end").alias("content_hash"))
    return merge.changed_only(old, p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("content_hash")), "id")


@query("b_extraction_upsert", "select p_partkey as id, case when p_size % 2 = 0 and p_size % 3 = 0 then p_name end as profile_hash from part")
def b_extraction_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("content_hash"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("method"), F.col("p_name").alias("profile_hash"))
    new = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("content_hash"), F.col("p_brand").alias("method"))
    return merge.invalidated(old, new, "id").select("id", "profile_hash")


@query("b_retention", "select event_id from events where ts >= timestamp '2024-02-12 12:00:00' - interval 30 days")
def b_retention(spark, d):
    return merge.retain(table(spark, d, "events"), "2024-02-12 12:00:00", 30, "ts").select("event_id")


@query("b_orphans", "select p_partkey as path, 'document' as kind from part where p_partkey not in (select o_orderkey from orders) union all select o_orderkey, 'file' from orders where o_orderkey not in (select p_partkey from part)")
def b_orphans(spark, d):
    return merge.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("path")), table(spark, d, "orders").select(F.col("o_orderkey").alias("path")))


@query("b_cascade", f"select user_id as match_id, event_id as id from events where user_id in (select id from {M} where cv_id not in (select id from {C} where years > 30))")
def b_cascade(spark, d):
    return merge.cascade(cvs(spark, d).filter("years > 30"), matches(spark, d), reviews(spark, d), "cv_id")[1].select("match_id", "id")


@query("b_csv", f"select id, score, replace(p_name, ' ', '; ') as keywords from {M} m join part on p_partkey = cv_id order by score desc, id limit 20000")
def b_csv(spark, d):
    m = matches(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("cv_id"), F.split("p_name", " ").alias("keywords")), "cv_id")
    return merge.csv_rows(m.select("id", "score", "keywords"))
