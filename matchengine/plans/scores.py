"""Queries of scoring components over pairs, and the flagship: scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchengine.functions import scoring
from matchengine.functions.text import fold
from matchengine.operators import pairs, profile
from matchengine.plans.bindings import MATCHES, matches
from matchengine.plans.texts import aliases
from matchengine.plans.vectors import TOP, top
from matchengine.registry import query, table

PAIRS = "(select l_orderkey * 10 + l_linenumber as id, p_size % 12 as cv_years, o_orderkey % 8 as job_years, string_split(p_name, ' ') as cv, ['red', 'widget', 'bolt'] as req, p_brand, o_orderpriority, l_discount, l_tax, l_returnflag from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey)"
ZONE = "(case when cv_years < a then greatest(0.0, 1 - (a - cv_years) / cast(a as double)) when cv_years / cast(a as double) <= 2 then 1.0 when cv_years / cast(a as double) >= 4 then 0.85 else 1 - 0.15 * (cv_years / cast(a as double) - 2) / 2 end)"
EXPERIENCE = f"case when a <= 0 and cv_years <= 0 then 0.5 when a <= 0 then 0.75 when cv_years <= 0 then 0.2 else {ZONE} end"


def rows(spark, d):
    l, p, o = (table(spark, d, n) for n in ("lineitem", "part", "orders"))  # noqa: E741
    j = l.join(p, F.col("p_partkey") == F.col("l_partkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("p_size") % 12).alias("cv_years"), (F.col("o_orderkey") % 8).alias("job_years"),
        F.split("p_name", " ").alias("cv"), F.array(*map(F.lit, ("red", "widget", "bolt"))).alias("req"), "p_brand", "o_orderpriority", "l_discount", "l_tax", "l_returnflag",
    )


def r6(c):
    return F.round(c + 1e-9, 6)


@query("i_experience", f"select id, round({EXPERIENCE} + 1e-9, 6) as score, not (a <= 0 or cv_years <= 0) as signal from (select *, job_years as a from {PAIRS})")
def i_experience(spark, d):
    s, sig = scoring.experience(F.col("cv_years"), F.col("job_years"))
    return rows(spark, d).select("id", r6(s).alias("score"), sig.alias("signal"))


@query("i_skill_weights", f"select id, array_to_string(list_transform(req, lambda s: case when s = 'red' then '3.0' when s = 'bolt' then '0.25' else '1.0' end), ',') as weights from {PAIRS}")
def i_skill_weights(spark, d):
    w = scoring.skill_weights(F.col("req"), F.array(F.lit("red")), F.array(F.lit("bolt")))
    return rows(spark, d).select("id", F.array_join(F.transform(w, lambda x: x.cast("string")), ",").alias("weights"))


COVER = "((case when list_contains(cv, 'red') then 3.0 else 0 end + case when list_contains(cv, 'widget') then 1.0 else 0 end + case when list_contains(cv, 'bolt') then 0.25 else 0 end) / 4.25)"


@query("i_skill_cov", f"select id, round({COVER} + 1e-9, 6) as score from {PAIRS}")
def i_skill_cov(spark, d):
    empty = F.array().cast("array<string>")
    s, _ = scoring.skill_coverage(F.col("cv"), F.col("req"), empty, F.array(F.lit("red")), F.array(F.lit("bolt")))
    return rows(spark, d).select("id", r6(s).alias("score"))


@query("i_jaccard", f"select id, round(len(list_intersect(cv, req)) / cast(len(list_distinct(list_concat(cv, req))) as double) + 1e-9, 6) as score from {PAIRS}")
def i_jaccard(spark, d):
    return rows(spark, d).select("id", r6(scoring.education(F.col("cv"), F.col("req"))[0]).alias("score"))


@query("i_language", f"select id, round(len(list_intersect(cv, req)) / 3.0 + 1e-9, 6) as score from {PAIRS}")
def i_language(spark, d):
    return rows(spark, d).select("id", r6(scoring.languages(F.col("cv"), F.col("req"))[0]).alias("score"))


@query("i_contract", f"select id, case when l_returnflag = 'A' then 1.0 else 0.0 end as score from {PAIRS}")
def i_contract(spark, d):
    return rows(spark, d).select("id", scoring.contract(F.col("l_returnflag"), F.lit("A"))[0].alias("score"))


@query("i_priority", f"select id, round(len(list_intersect(cv, req)) / 3.0 + 1e-9, 6) as score from {PAIRS}")
def i_priority(spark, d):
    asked = F.concat(F.col("req"), F.array(F.lit("red")))
    return rows(spark, d).select("id", r6(scoring.priority_keywords(F.col("cv"), asked)[0]).alias("score"))


@query("i_core", f"select id, case when list_contains(cv, 'red') then 1.0 else 0.0 end as score from {PAIRS}")
def i_core(spark, d):
    return rows(spark, d).select("id", scoring.core_coverage(F.col("cv"), F.array(F.lit("red"))).cast("double").alias("score"))


@query("i_semantic_credit", f"select id, round((case when l_discount * 10 >= 0.6 then 0.8 * least(1.0, (l_discount * 10 - 0.6) / 0.4) else 0 end) + 1e-9, 6) as credit from {PAIRS}")
def i_semantic_credit(spark, d):
    return rows(spark, d).select("id", r6(scoring.semantic_credit(F.col("l_discount") * 10)).alias("credit"))


@query("i_seniority", "select o_orderkey, case o_orderkey % 5 when 0 then 8 when 1 then 5 when 2 then 3 when 3 then 1 else 0 end as years from orders")
def i_seniority(spark, d):
    title = F.expr("case o_orderkey % 5 when 0 then 'Consultant Expert' when 1 then 'Data Analyst Sénior H/F' when 2 then 'Profil confirmé' when 3 then 'Développeur Junior' else 'Chef de Projet IT' end")
    return table(spark, d, "orders").select("o_orderkey", scoring.seniority_years(title, F.lit("")).alias("years"))


WEIGHTED = f"""(select *, {COVER} as sk, {EXPERIENCE} as ex, not (a <= 0 or cv_years <= 0) as exs, len(list_intersect(cv, req)) / 3.0 as pk, len(list_intersect(cv, req)) / cast(len(list_distinct(list_concat(cv, req))) as double) as ed
    from (select *, job_years as a from {PAIRS}))"""
FINAL = f"""(select *, least(m, 0.3 + 0.7 * sk, 0.3 + 0.7 * pk) * (case when list_contains(cv, 'red') then 1.0 else 0.45 end) * 100 as score
    from (select *, (0.10 * 0.5 + 0.40 * sk + 0.40 * pk + (case when exs then 0.20 * ex else 0 end) + 0.08 * ed) / (0.10 + 0.40 + 0.40 + (case when exs then 0.20 else 0 end) + 0.08) as m from {WEIGHTED}))"""


def scored(spark, d):
    cv, req, empty = F.col("cv"), F.col("req"), F.array().cast("array<string>")
    parts = {
        "semantic": (F.lit(0.5), F.lit(True)),
        "skills": scoring.skill_coverage(cv, req, empty, F.array(F.lit("red")), F.array(F.lit("bolt"))),
        "priority_keywords": scoring.priority_keywords(cv, req),
        "experience": scoring.experience(F.col("cv_years"), F.col("job_years")),
        "education": scoring.education(cv, req),
        "languages": scoring.languages(cv, empty),
        "contract": scoring.contract(F.lit(""), F.lit("")),
    }
    s = scoring.final_score(parts, scoring.profile_weights(F.lit("equilibre")), scoring.core_coverage(cv, F.array(F.lit("red"))))
    return rows(spark, d).withColumn("score", s).withColumn("low", F.array_join(scoring.low_confidence(parts), ","))


@query("i_final", f"select id, round(score + 1e-9, 5) as score from {FINAL}")
def i_final(spark, d):
    return scored(spark, d).select("id", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query("i_low_confidence", f"select id, case when job_years <= 0 or cv_years <= 0 then 'experience,languages,contract' else 'languages,contract' end as low from {PAIRS}")
def i_low_confidence(spark, d):
    return scored(spark, d).select("id", "low")


@query("i_tone", f"select id, case when score >= 80 then 'Fort' when score >= 60 then 'Moyen' else 'À vérifier' end as tone from {MATCHES.join(['(', ')'])}")
def i_tone(spark, d):
    return matches(spark, d).select("id", scoring.tone(F.col("score")).alias("tone"))


@query("i_hybrid", f"select id, round((greatest(0.0, 1 - l_tax * 5) * 100 * 0.3 + l_discount * 1000 * 0.7) + 1e-9, 6) as score from {PAIRS}")
def i_hybrid(spark, d):
    return rows(spark, d).select("id", r6(scoring.hybrid_score(scoring.vector_score(F.col("l_tax") * 5), F.col("l_discount") * 1000)).alias("score"))


@query("i_domain_label", f"select id, case when o_orderpriority <> '1-URGENT' then o_orderpriority else p_brand end as domain from {PAIRS}")
def i_domain_label(spark, d):
    job = F.when(F.col("o_orderpriority") == "1-URGENT", "general").otherwise(F.col("o_orderpriority"))
    return rows(spark, d).select("id", scoring.domain_label(job, F.col("p_brand")).alias("domain"))


@query("i_weights", "select p_partkey, cast(case p_size % 3 when 0 then 0.20 when 1 then 0.35 else 0.12 end as double) as experience from part")
def i_weights(spark, d):
    name = F.expr("case p_size % 3 when 0 then 'unknown' when 1 then 'priorite_experience' else 'priorite_mots_cles' end")
    return table(spark, d, "part").select("p_partkey", scoring.profile_weights(name)["experience"].alias("experience"))


@query("i_backoff", "select event_id, least(10.0, 0.5 * pow(2, event_id % 7)) as delay from events")
def i_backoff(spark, d):
    return table(spark, d, "events").select("event_id", scoring.backoff(F.col("event_id") % 7 + 1).alias("delay"))


JOINED = "array_to_string({0}[1:8], ', ')"
COMMON, LACKING = "list_filter(cv, lambda s, i: list_contains(req, s) and list_position(cv, s) = i)", "list_filter(req, lambda s: not list_contains(cv, s))"
EXPLAIN = f"""select id, to_json({{'why': case when len(why) > 0 then why else ['aucun'] end, 'vigilance': case when len(care) > 0 then care else ['aucun'] end, 'evidence': case when len(ev) > 0 then ev else ['aucun'] end}})::varchar as explanation from
    (select id, list_filter([case when len(common) > 0 then 'Compétences communes : ' || {JOINED.format('common')} end, case when job_years > 0 and cv_years >= job_years then 'Expérience suffisante : ' || cv_years || ' ans pour ' || job_years || ' demandés' end,
        case when score >= 80 then 'Score élevé' end], lambda x: x is not null) as why,
        list_filter([case when len(lacking) > 0 then 'Compétences manquantes : ' || {JOINED.format('lacking')} end, case when job_years > 0 and cv_years < job_years then 'Expérience insuffisante : ' || cv_years || ' ans pour ' || job_years || ' demandés' end], lambda x: x is not null) as care,
        list_filter(cv, lambda w: len(list_filter(common, lambda c: contains(w, c))) > 0)[1:4] as ev from (select *, {COMMON} as common, {LACKING} as lacking from {FINAL}))"""


@query("i_explain", EXPLAIN)
def i_explain(spark, d):
    e = profile.explanation(F.array_intersect("cv", "req"), F.array_except("req", "cv"), F.col("score"), F.col("cv_years"), F.col("job_years").cast("int"), F.array_join("cv", ". "))
    return scored(spark, d).select("id", F.to_json(e).alias("explanation"))


@query("i_word_in_text", "select p_partkey, contains(' ' || p_name || ' ', ' red ') as hit from part")
def i_word_in_text(spark, d):
    from matchengine.operators.skills import word_in_text

    return table(spark, d, "part").select("p_partkey", word_in_text(F.lit("Réd"), fold("p_name")).alias("hit"))


# a sixth of the parts and a quarter of the orders had other contents when their pairs were scored
@query("k_memo_skip", """with r as (select l_orderkey * 10 + l_linenumber as id, p_name, p_type, l_linestatus = 'F' and p_size % 6 <> 0 and o_orderkey % 4 <> 0 as done from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey)
    select id from r anti join (select id, p_name, p_type from r where done) using (id, p_name, p_type)""")
def k_memo_skip(spark, d):
    l, p, o = (table(spark, d, n) for n in ("lineitem", "part", "orders"))  # noqa: E741
    rows = l.join(p, F.col("p_partkey") == F.col("l_partkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("cv_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("job_id", F.col("o_orderkey"))
    cv, job = F.concat_ws("|", "p_name", "p_type"), F.concat_ws("|", "o_orderpriority", "o_orderdate")
    now = rows.select("cv_id", "job_id", F.sha2(cv, 256).alias("cv_hash"), F.sha2(job, 256).alias("job_hash"))
    then_cv, then_job = F.when(F.col("p_size") % 6 == 0, F.concat(cv, F.lit(" old"))).otherwise(cv), F.when(F.col("o_orderkey") % 4 == 0, F.lit("draft")).otherwise(job)
    done = rows.select("cv_id", "job_id", F.sha2(then_cv, 256).alias("cv_hash"), F.sha2(then_job, 256).alias("job_hash"), F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("score_skills"))
    return pairs.unfinished(now, done).select(F.col("cv_id").alias("id"))


@query("j_affected_pairs", "select l_orderkey * 10 + l_linenumber as id from lineitem join part on p_partkey = l_partkey where p_size % 6 = 0 or l_orderkey % 4 = 0 or p_size > 45")
def j_affected_pairs(spark, d):
    """Pairs of lines' parts and orders of which one has changed or is new."""
    p, o = table(spark, d, "part"), table(spark, d, "orders")
    cvs = p.select(F.col("p_partkey").alias("id"), "p_size", F.sha2("p_name", 256).alias("content_hash"))
    old_cvs = cvs.filter("p_size <= 45").withColumn("content_hash", F.when(F.col("p_size") % 6 != 0, F.col("content_hash")))
    jobs = o.select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderdate").cast("string"), 256).alias("content_hash"))
    old_jobs = jobs.withColumn("content_hash", F.when(F.col("id") % 4 == 0, "draft").otherwise(F.col("content_hash")))
    every = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cv_id"), F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return pairs.affected(every, cvs, jobs, old_cvs, old_jobs).select("id")


@query("k_two_stage", f"""select query_id as job_id, id as cv_id, case when rank <= 5 then (id % 11) * 9.0 when o and id % 5 <> 0 then 50.0 else round(sim + 1e-9, 6) end as score,
    rank > 5 and not (o and id % 5 <> 0) as provisional from (select *, (query_id // 100 + id) % 3 = 0 as o from {TOP} where rank <= 25)""")
def k_two_stage(spark, d):
    """Vector scores of each query's neighbours, full ones of the first five, over scores from before, of which a fifth are
    of other contents."""
    e = table(spark, d, "embeddings")
    prints = e.select(F.col("vec_id").alias("id"), F.sha2(F.concat_ws(",", "embedding"), 256).alias("hash"))
    near = top(spark, d, 25).withColumn("full_score", (F.col("id") % 11) * 9.0).withColumn("score", r6(F.col("score")))
    near = near.join(prints.withColumnRenamed("hash", "cv_hash"), "id").join(prints.select(F.col("id").alias("query_id"), F.col("hash").alias("job_hash")), "query_id")
    named = near.withColumn("cv_id", F.col("id")).withColumn("job_id", F.col("query_id"))
    old = named.filter((F.floor(F.col("query_id") / 100) + F.col("id")) % 3 == 0).withColumn("score", F.lit(50.0)).withColumn("provisional", F.lit(False))
    old = old.withColumn("cv_hash", F.when(F.col("id") % 5 != 0, F.col("cv_hash")).otherwise("old"))
    return pairs.merged(old, pairs.provisional_then_final(named, 5)).select("job_id", "cv_id", "score", "provisional")


@query("j_offer_text", "select p_partkey, p_name || chr(10) || 'Entreprise : ' || p_brand || chr(10) || 'Compétences requises : ' || replace(p_name, ' ', ', ') || chr(10) || 'Contraintes : Non renseigné' || chr(10) || 'Non renseigné' as offer from part")
def j_offer_text(spark, d):
    return table(spark, d, "part").select("p_partkey", profile.offer_text(F.col("p_name"), F.col("p_brand"), F.split("p_name", " "), F.lit(None).cast("array<string>"), F.lit(" ")).alias("offer"))


@query("j_profile_pairs")
def j_profile_pairs(spark, d):
    """Each conversation's user turns as a CV against its assistant turns as an offer: profiles, then scores."""
    c = table(spark, d, "conversations")
    whole = c.groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    every = profile.profiles(whole.filter("role in ('user', 'assistant')").withColumn("id", F.struct("conv_id", "role")), aliases(spark), 2025, "id")
    side = lambda r: F.first(F.when(F.col("id.role") == r, F.col("p")), ignorenulls=True)
    both = every.select("id", F.struct("*").alias("p")).groupBy("id.conv_id").agg(side("user").alias("cv"), side("assistant").alias("job")).filter("cv is not null and job is not null")
    return profile.score(both).select("conv_id", "score", F.array_join("common_skills", ",").alias("common"), F.array_join("low_confidence", ",").alias("low"))
