"""Queries of ingest rules, sessions, forms, spans, searches over documents, and line look-ahead."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchengine.functions import text as T
from matchengine.operators import annotations, fields, ingest, merge, offers, profile, reads, sections, skills
from matchengine.operators import vectors as V
from matchengine.plans.bindings import CVS, JOBS, MATCHES, cvs, jobs, matches
from matchengine.plans.texts import FOLD, TOKENS, aliases, docs
from matchengine.plans.vectors import TOP, top
from matchengine.registry import query, table
from matchengine.sources import files

M, J, C = f"({MATCHES})", f"({JOBS})", f"({CVS})"


def part(spark, d):
    return table(spark, d, "part")


@query("j_ingest_refusal", "select p_partkey as id, case when p_size % 7 = 0 then 'folder' when p_size % 2 = 0 and p_size % 3 = 0 then 'keywords' when p_size % 5 = 0 then 'name' when p_size % 11 = 0 then 'suffix' when p_retailprice > 1500 then 'size' end as reason from part")
def j_ingest_refusal(spark, d):
    p = part(spark, d).select(
        "p_partkey", "p_size", F.expr("case when p_size % 7 = 0 then 'x' when p_size % 2 = 0 then 'cv' else 'job' end").alias("folder"), F.when(F.col("p_size") % 3 == 0, "sql").alias("words"),
        F.expr("case when p_size % 5 = 0 then ' ' when p_size % 11 = 0 then 'a.png' else 'a/b.PDF' end").alias("name"), F.col("p_retailprice").alias("size"),
    )
    return p.select(F.col("p_partkey").alias("id"), ingest.refusal(F.col("folder"), F.col("name"), F.col("size"), F.col("words"), 1500).alias("reason"))


@query("j_resolve_names", "select p_partkey as upload_id, 'cv' || p_partkey || case when p_size % 3 = 1 then '' when p_size % 5 <> 0 or p_size % 2 = 1 then '__u1' else '__u1-2' end || '.pdf' as path from part")
def j_resolve_names(spark, d):
    p = part(spark, d)
    name = lambda end: F.concat(F.lit("cv"), F.col("p_partkey").cast("string"), F.lit(end))
    have = p.select(name(".pdf").alias("path"), (F.col("p_size") % 3).cast("long").alias("owner_id")).unionByName(p.filter("p_size % 5 = 0").select(name("__u1.pdf").alias("path"), (F.col("p_size") % 2).cast("long").alias("owner_id")))
    up = p.select(F.col("p_partkey").alias("upload_id"), name(".pdf").alias("name"), F.lit(1).cast("long").alias("owner_id"))
    return ingest.resolve_names(up, have).select("upload_id", "path")


# uploads of a thousand names at most by all customers at once; every tenth name has a record of customer 1
BATCH = """(select o_orderkey as upload_id, 'cv' || o_orderkey % 997 || '.pdf' as name, o_custkey as owner_id from orders),
    u2 as (select *, case when o % 10 = 0 then 1 else first_value(owner_id) over (partition by name order by upload_id) end as holder from (select *, cast(regexp_extract(name, '[0-9]+') as int) as o from u)),
    named as (select upload_id, owner_id, case when owner_id = holder then name else replace(name, '.pdf', '__u' || owner_id || '.pdf') end as path from u2)"""


def batch(spark, d):
    o = table(spark, d, "orders")
    up = o.select(F.col("o_orderkey").alias("upload_id"), F.concat(F.lit("cv"), (F.col("o_orderkey") % 997).cast("string"), F.lit(".pdf")).alias("name"), F.col("o_custkey").alias("owner_id"))
    number = F.regexp_extract("name", "[0-9]+", 0).cast("int")
    return up, up.select(F.col("name").alias("path"), number.alias("n")).distinct().filter("n % 10 = 0").select("path", F.lit(1).cast("long").alias("owner_id"))


@query("j_resolve_batch", f"with u as {BATCH} select upload_id, path from named")
def j_resolve_batch(spark, d):
    """Many owners upload files of one name in one batch; no two of them get the same path."""
    return ingest.resolve_names(*batch(spark, d)).select("upload_id", "path")


@query("j_ingest_batch", f"""with u as {BATCH} select path, arg_max(owner_id, upload_id) as owner_id, arg_max(upload_id, upload_id)::varchar as priority_keywords from named group by path
    union all select distinct name, 1, null from u2 where o % 10 = 0 and name not in (select path from named)""")
def j_ingest_batch(spark, d):
    """The records after that batch: one of each name and owner, with what the last upload said."""
    up, have = batch(spark, d)
    have = have.select("path", "owner_id", F.lit("ready").alias("status"), F.lit(None).cast("long").alias("session_id"), F.lit(None).cast("string").alias("priority_keywords"))
    named = ingest.resolve_names(up, have).withColumn("priority_keywords", F.col("upload_id").cast("string"))
    return ingest.ingest(have, named).select("path", "owner_id", "priority_keywords")


RECORDS = "(select p_partkey as path, p_size % 4 as owner_id, case when p_size % 3 = 0 then p_size end as session_id, case when p_size % 6 < 3 then p_brand end as priority_keywords, 'ready' as status from part where p_size % 5 <> 0)"
UPLOADS = "(select p_partkey as path, 9 as owner_id, case when p_size % 2 = 0 then p_type end as priority_keywords from part where p_size > 20)"


@query("j_ingest", f"""select coalesce(u.path, r.path) as path, cast(case when u.path is not null then u.owner_id else r.owner_id end as int) as owner_id, coalesce(r.status, 'pending') as status,
    case when u.path is null then r.session_id end as session_id, coalesce(u.priority_keywords, r.priority_keywords) as priority_keywords from {RECORDS} r full join {UPLOADS} u on r.path = u.path""")
def j_ingest(spark, d):
    p = part(spark, d)
    have = p.filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 4).alias("owner_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("session_id"), F.when(F.col("p_size") % 6 < 3, F.col("p_brand")).alias("priority_keywords"), F.lit("ready").alias("status"))
    up = p.filter("p_size > 20").select(F.col("p_partkey").alias("path"), F.lit(9).alias("owner_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("priority_keywords"))
    return ingest.ingest(have, up)


@query("b_document_upsert", """select p_partkey as path, case when p_size > 10 then p_type else p_brand end as content_hash, case when p_size <= 10 then 'pending' when p_size % 2 = 0 then 'ready' else 'failed' end as status,
    case when p_size > 10 and p_size % 2 = 1 then case when p_size % 3 = 0 then 'torn' else 'extraction failed' end end as last_error, case when p_size <= 10 or p_size % 4 = 0 then p_size end as session_id from part""")
def b_document_upsert(spark, d):
    p = part(spark, d)
    have = p.select(F.col("p_partkey").alias("path"), F.when((F.col("p_size") > 10) & (F.col("p_size") % 4 == 0), F.col("p_type")).otherwise(F.col("p_brand")).alias("content_hash"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("last_error"), F.col("p_size").alias("session_id"))
    new = p.filter("p_size > 10").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("content_hash"), (F.col("p_size") % 2 == 0).alias("success"), F.when(F.col("p_size") % 3 == 0, "torn").alias("error"))
    return ingest.upsert_extracted(have, new)


@query("b_upsert_latest", "select user_id as id, event_type as kind from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def b_upsert_latest(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), "event_id")
    return merge.upsert(e.limit(0), merge.latest(e, ["id"], "event_id"), ["id"]).select("id", "kind")


@query("j_session_assign", f"select id, case when owner_id % 3 = 0 then 7 else session_id end as session_id from {J}")
def j_session_assign(spark, d):
    j = jobs(spark, d)
    return ingest.assign(j, j.filter("owner_id % 3 = 0"), 7).select("id", F.col("session_id").cast("long").alias("session_id"))


@query("j_session_dissolve", f"select id, case when session_id is distinct from 5 then session_id end as session_id from {J}")
def j_session_dissolve(spark, d):
    j = jobs(spark, d)
    return ingest.dissolve(j, j.select(F.col("session_id").alias("id")), 5)[0].select("id", "session_id")


@query("j_session_clone", f"select id as source_id, 'j' || id || case when owner_id = 5 then '' else '__u5' end || '.txt' as path from {J} where session_id = 5")
def j_session_clone(spark, d):
    j = jobs(spark, d).select("id", F.concat(F.lit("j"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), "owner_id", "session_id", F.lit("h").alias("content_hash"))
    return ingest.clone(j, 5, 5).select("source_id", "path")


@query("j_feedback_append", f"""select l_orderkey * 10 + l_linenumber as match_id, 'accept' as decision, cast(case when l_linenumber % 2 = 0 then greatest(1, least(5, l_linenumber + 2)) end as int) as rating, m.score from lineitem join {M} m on m.id = l_orderkey * 10 + l_linenumber""")
def j_feedback_append(spark, d):
    new = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id"), F.lit("accept").alias("decision"), (F.col("l_linenumber") + 2).alias("rating"), (F.col("l_linenumber") % 2 == 0).alias("rating_given"))
    none = new.limit(0).select("match_id", "rating")
    return offers.feedback_rows(new, matches(spark, d), none).select("match_id", "decision", "rating", F.col("scores_snapshot.score").alias("score"))


@query("b_prometheus", f"""select name, part, line from (select name, 0 as part, '# TYPE matchengine_' || name || ' gauge' as line from (select 'active_cv' as name union all select 'archived_cv' union all select 'cv_total' union all select 'active_job' union all select 'archived_job' union all select 'job_total' union all select 'active_match')
    union all select 'cv_total', 1, 'matchengine_cv_total ' || count(*) from {C} union all select 'active_cv', 1, 'matchengine_active_cv ' || count(*) from {C} where session_id is null union all select 'archived_cv', 1, 'matchengine_archived_cv ' || count(*) from {C} where session_id is not null
    union all select 'job_total', 1, 'matchengine_job_total ' || count(*) from {J} union all select 'active_job', 1, 'matchengine_active_job ' || count(*) from {J} where session_id is null union all select 'archived_job', 1, 'matchengine_archived_job ' || count(*) from {J} where session_id is not null
    union all select 'active_match', 1, 'matchengine_active_match ' || count(*) from {M} m join {C} c on c.id = m.cv_id and c.session_id is null join {J} j on j.id = m.job_id and j.session_id is null)""")
def b_prometheus(spark, d):
    return ingest.prometheus(reads.health(cvs(spark, d), jobs(spark, d), matches(spark, d)))


@query("k_event_log", "select event_id, 'watcher' as source, case when user_id % 2 = 0 then sha256('x' || user_id) end as fingerprint from events")
def k_event_log(spark, d):
    e = table(spark, d, "events")
    there = e.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("path")).distinct().withColumn("content", F.concat(F.lit("x"), "path").cast("binary"))
    logged = ingest.event_log(e.select("event_type", F.col("user_id").cast("string").alias("path"), F.struct("event_id", "ts").alias("observed_at")), there)
    return logged.select(F.col("observed_at.event_id").alias("event_id"), "source", "fingerprint")


@query("k_bounded_queue", "select event_id from events order by ts desc, event_id desc limit 1000")
def k_bounded_queue(spark, d):
    return ingest.newest(table(spark, d, "events")).select("event_id")


@query("k_stale", "select id from (select user_id as id, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'view' and epoch(timestamp '2024-06-01 00:00:00') - epoch(ts) > 300")
def k_stale(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select(F.col("user_id").alias("id"), F.col("l.ts").alias("delivered_at"), (F.col("l.event_type") == "view").alias("done"))
    return ingest.stale(last, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).select("id")


@query("f_split_ranges", "select o_orderkey, cast(case when y + k <= 2025 then k else 0 end as int) as years from (select o_orderkey, 2000 + o_orderkey % 25 as y, o_orderkey % 7 as k from orders)")
def f_split_ranges(spark, d):
    t = F.expr("concat('De mai ', 2000 + o_orderkey % 25, ' à\\n', o_orderpriority, ' Dijon\\ndéc. ', 2000 + o_orderkey % 25 + o_orderkey % 7, '\\nfin')")
    return table(spark, d, "orders").select("o_orderkey", fields.covered_years(fields.date_ranges(t, 2025)).alias("years"))


@query("f_lookahead", """with l as (select doc_id, i, line, lead(line) over (partition by doc_id order by i) as b from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
    w as (select *, len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')) as n, len(regexp_replace(line, '[^\\p{L}]', '', 'g')) as a, len(regexp_replace(line, '[^\\p{Lu}]', '', 'g')) as u from l)
    select doc_id, count(*) as headings from w where n between 1 and 6 and ((a > 0 and u > 0.65 * a) or coalesce(regexp_matches(b, '^\\s*[-•*0-9]\\s+'), false)) group by 1""")
def f_lookahead(spark, d):
    return sections.heading_like(sections.lines(docs(spark, d))).filter("heads").groupBy("doc_id").agg(F.count("*").alias("headings"))


@query("h_token_budget", f"select doc_id, cast(k as int) as pos, len(t[k * 510 + 1 : k * 510 + 510]) as n, t[k * 510 + 1] as first from (select doc_id, t, unnest(generate_series(0, (len(t) - 1) // 510)) as k from (select doc_id, {TOKENS('text')} as t from documents) where len(t) > 0)")
def h_token_budget(spark, d):
    toks = docs(spark, d).select("doc_id", T.skill_tokens("text").alias("t"))
    return toks.select("doc_id", F.posexplode(T.budget_pieces("t", 512, 2)).alias("pos", "piece")).select("doc_id", "pos", F.size("piece").cast("long").alias("n"), F.col("piece")[0].alias("first"))


@query("d_embeddings_documents", "select vec_id, lang, label from embeddings join documents on doc_id = vec_id where lang = 'en'")
def d_embeddings_documents(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return V.with_documents(e, docs(spark, d).select("doc_id", "lang"), "vec_id").filter("lang = 'en'").select("vec_id", "lang", "label")


WORDS_OF = lambda c: f"list_distinct(regexp_extract_all({FOLD(c)}, '[a-z0-9]{{2,}}'))"


@query("j_search", f"""with h as (select t.query_id, t.id, greatest(0.0, t.sim) * 100 as v, {WORDS_OF('q.text')} as a, {WORDS_OF('d.text')} as b from {TOP} t join documents q on q.doc_id = t.query_id join documents d on d.doc_id = t.id where rank <= 20),
    s as (select query_id, id, v, case when len(a) > 0 then 100.0 * len(list_intersect(a, b)) / len(a) else 0 end as l from h)
    select query_id, id, round(0.3 * v + 0.7 * l + 1e-9, 5) as score from s where 0.3 * v + 0.7 * l >= 20""")
def j_search(spark, d):
    """Vector hits, joined with their documents, whose words give the lexical side: the share of the query's that they have."""
    t = docs(spark, d).select("doc_id", F.array_distinct(T.canonical_tokens("text")).alias("words"))
    hits = V.with_documents(top(spark, d, 20), t, "id").join(t.select(F.col("doc_id").alias("query_id"), F.col("words").alias("asked")), "query_id")
    return V.search(hits, V.lexical_share(F.col("asked"), F.col("words")), min_score=20).select("query_id", "id", F.round(F.col("hybrid_score") + 1e-9, 5).alias("score"))


@query("c_noise_terms", "select p_partkey, (p_name ilike '%red%' and p_size % 2 = 0) or p_size % 3 = 0 as noise from part")
def c_noise_terms(spark, d):
    v = F.expr("case when p_name ilike '%red%' and p_size % 2 = 0 then ' Divers ' when p_size % 3 = 0 then 'ÉTC' else p_name end")
    return part(spark, d).select("p_partkey", offers.is_noise(v, ["divers", "etc"]).alias("noise"))


@query("c_valid_entities", "select p_partkey from part where p_size % 3 = 0 or (p_size % 3 = 1 and p_brand <> '')")
def c_valid_entities(spark, d):
    v = part(spark, d).select("p_partkey", F.expr("case when p_size % 3 = 0 then 'Acme Paris' when p_size % 3 = 1 then p_brand when p_size % 2 = 0 then 'lower case' else 'The' end").alias("value"))
    return offers.valid_entities(v, aliases(spark)).select("p_partkey")


@query("c_decisions", "select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'accept' when 'R' then 'reject' else 'review' end as decision from lineitem")
def c_decisions(spark, d):
    v = F.expr("case l_returnflag when 'A' then 'accept' when 'R' then 'reject' else 'review' end")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", offers.checked_column(v).alias("decision"))


@query("i_semantic_text", "select p_partkey, case when p_size % 4 = 0 then p_brand when p_size % 4 = 1 then p_type || chr(10) || p_name || chr(10) || p_brand when p_size % 4 = 2 then repeat(p_name, 100) else p_name || chr(10) || p_brand end as t from part")
def i_semantic_text(spark, d):
    c = lambda sql: F.expr(f"case p_size % 4 {sql} end")
    t = offers.semantic_text(c("when 1 then p_type when 2 then repeat(p_name, 100) when 3 then p_name"), c("when 1 then concat(' ', p_name) when 3 then concat(p_name, ' ')"), c("when 0 then ' '"), F.col("p_brand"))
    return part(spark, d).select("p_partkey", t.alias("t"))


@query("h_job_offer", """select p_partkey, case when p_size % 2 = 0 then p_name else p_type end as title, case when p_size % 2 = 0 then 'Non renseigné' else p_type end as category, 'CDI' as contract_type, 'Français' as languages, replace(p_name, ' ', ',') as skills,
    'a,b' as strong_constraints, case when p_size % 2 = 0 then 'a' || chr(10) || chr(10) || 'b' else 'a' || chr(10) || chr(10) || 'b' || chr(10) || p_type end as description from part""")
def h_job_offer(spark, d):
    even = F.col("p_size") % 2 == 0
    words, none = F.split("p_name", " "), F.lit(None).cast("array<string>")
    o = offers.job_offer(F.when(even, F.col("p_name")), F.when(~even, F.col("p_type")), F.lit("a\n\nb"), F.lit(" "), F.lit("x"), F.lit("CDI"), none, words, words, F.lit("/x/y.pdf"))
    return part(spark, d).select("p_partkey", o.alias("o")).select("p_partkey", "o.title", "o.category", "o.contract_type", *[F.array_join(f"o.{c}", ",").alias(c) for c in ("languages", "skills", "strong_constraints")], "o.description")


@query("h_spans", "select o_orderkey as doc_id, label, cast(s as int) as start, value from (select o_orderkey, 'EMAIL' as label, 0 as s, 'a' || o_orderkey || '@x.fr' as value from orders union all select o_orderkey, 'PHONE', length('a' || o_orderkey || '@x.fr') + 1, '01 23 45 67 89' from orders union all select o_orderkey, 'YEARS', length('a' || o_orderkey || '@x.fr') + 17, (o_orderkey % 30 + 1) || ' ans' from orders)")
def h_spans(spark, d):
    t = F.expr("concat('a', o_orderkey, '@x.fr 01 23 45 67 89, ', o_orderkey % 30 + 1, ' ans')")
    return offers.spans(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))).select("doc_id", "label", "start", "value")


@query("b_annotation_tasks")
def b_annotation_tasks(spark, d):
    few = docs(spark, d).select("doc_id", "text")
    return offers.annotation_tasks(few, offers.spans(few), 50)


@query("i_enrich", "with t as (select o_orderkey as id, unnest([o_orderkey % 5, o_orderkey % 3, o_orderkey % 5]) as k, unnest([0, 1, 2]) as pos from orders), f as (select id, k % 4 as u, min(pos) as pos from t group by 1, 2) select id, string_agg('uri' || u, ',' order by pos) as uris from f group by 1")
def i_enrich(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("term"), F.concat(F.lit("uri"), (F.col("n_nationkey") % 4).cast("string")).alias("uri"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    k = lambda m: F.concat(F.lit("t"), (F.col("o_orderkey") % m).cast("string"))
    terms = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(k(5), k(3), k(5))).alias("pos", "term"))
    return offers.enriched(n, terms).select("id", T.join_keywords("uris").alias("uris"))


WHITELIST = ["thattion", "schenei", "mentaux", "the"]


@query("h_fuzzy_whitelist")
def h_fuzzy_whitelist(spark, d):
    """The dictionary's skills and those of a short list, by name or a resembling word."""
    few = docs(spark, d)
    return skills.with_whitelist(few, skills.find_skills(few, aliases(spark)), aliases(spark), WHITELIST).select("doc_id", "canonical", "n", "pos")


SINGLE = ["the", "la", "der", "and", "est", "of"]


@query("h_skill_spans", f"select doc_id, t as token, count(*) as n from (select doc_id, unnest({TOKENS('text')}) as t from documents) where t in ('the', 'la', 'der', 'and', 'est', 'of') group by 1, 2")
def h_skill_spans(spark, d):
    """Places of one-word aliases in the texts themselves; a span counts if the text from its start to its end is its value."""
    known = skills.compiled(skills.layered(spark.createDataFrame([(0, w.upper(), w) for w in SINGLE], "layer int, canonical string, alias string")))
    found = annotations.annotated(docs(spark, d), known, patterns={}, names=False)
    both = found.join(docs(spark, d), "doc_id").filter(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value"))
    return both.groupBy("doc_id", T.fold("value").alias("token")).agg(F.count("*").alias("n"))


@query("h_all_spans")
def h_all_spans(spark, d):
    return annotations.annotated(docs(spark, d), skills.compiled(aliases(spark)))


GRID_LINES = "(select l_orderkey as id, l_linenumber as n, l_orderkey % 40 as doc_id, l_linenumber as page, l_partkey % 600 as x0, l_partkey % 600 + 20 as x1, l_suppkey * 37 % 800 as y0, l_suppkey * 37 % 800 + 10 as y1 from lineitem)"
GRID_BOXES = "(select p_partkey % 40 as doc_id, p_size % 7 + 1 as page, p_partkey * 13 % 500 as x0, p_partkey * 13 % 500 + p_size * 4 as x1, p_partkey * 29 % 700 as y0, p_partkey * 29 % 700 + p_size * 3 as y1 from part where p_partkey % 5 = 0)"


@query("a_outside_tables", f"select id, n from {GRID_LINES} l where not exists (from {GRID_BOXES} b where b.doc_id = l.doc_id and b.page = l.page and (l.x0 + l.x1) / 2 between b.x0 and b.x1 and (l.y0 + l.y1) / 2 between b.y0 and b.y1)")
def a_outside_tables(spark, d):
    at = lambda t, rows, *cols: table(spark, d, t).filter(rows).selectExpr(*cols)
    lines = at("lineitem", "true", "l_orderkey as id", "l_linenumber as n", "l_orderkey % 40 as doc_id", "l_linenumber as page", "l_partkey % 600 as x0", "l_partkey % 600 + 20 as x1", "l_suppkey * 37 % 800 as y0", "l_suppkey * 37 % 800 + 10 as y1")
    boxes = at("part", "p_partkey % 5 = 0", "p_partkey % 40 as doc_id", "p_size % 7 + 1 as page", "p_partkey * 13 % 500 as x0", "p_partkey * 13 % 500 + p_size * 4 as x1", "p_partkey * 29 % 700 as y0", "p_partkey * 29 % 700 + p_size * 3 as y1")
    return files.outside_tables(lines, boxes).select("id", "n")


CLASSES = {"article": ["the", "der", "la", "of the"], "joining": ["and", "und", "et", "in the"]}


@query("a_section_class", """with t as (select doc_id, lower(trim(text[1:80])) as t from documents), w as (select *, list_transform(regexp_split_to_array(t, '\\s+'), lambda x: trim(x, ':,.;()[]')) as w from t)
    select doc_id, case when contains(t, 'of the') then 'article' when contains(t, 'in the') then 'joining' when list_contains(w, 'the') or list_contains(w, 'der') then 'article'
        when list_contains(w, 'and') or list_contains(w, 'und') then 'joining' when list_contains(w, 'la') then 'article' when list_contains(w, 'et') then 'joining' else 'other' end as section from w""")
def a_section_class(spark, d):
    return docs(spark, d).select("doc_id", sections.classed(F.substring("text", 1, 80), CLASSES).alias("section"))


@query("j_cv_text", """select p_partkey, 'CV STRUCTURÉ' || chr(10) || 'Nom complet: ' || p_name || chr(10) || 'Titre professionnel: ' || p_type || chr(10) || 'Statut: ' || case when p_size % 2 = 0 then 'draft' else 'published' end || chr(10) || 'Profil' || chr(10) || p_brand || chr(10)
    || 'Compétences' || chr(10) || case when p_size % 3 = 0 then 'Aucune' else '- ' || replace(p_name, ' ', chr(10) || '- ') end || chr(10) || chr(10) || 'Expérience' || chr(10) || '- ' || p_type || chr(10) || chr(10) || 'Formation' || chr(10) || 'Aucune' || chr(10) || chr(10)
    || 'Certifications' || chr(10) || 'Aucune' || chr(10) || chr(10) || 'Langues: ' || case when p_size % 5 = 0 then 'fr, en' else 'Français' end || chr(10) || 'Contrat recherché: Non renseigné' || chr(10) || 'Localisation: ' || p_brand || chr(10) as cv from part""")
def j_cv_text(spark, d):
    p = part(spark, d)
    some = lambda when, value: F.when(when, value)
    form = {
        "full_name": F.concat(F.lit(" "), "p_name"), "headline": F.col("p_type"), "status": some(F.col("p_size") % 2 == 0, "draft"), "summary": F.col("p_brand"), "skills": some(F.col("p_size") % 3 != 0, F.split("p_name", " ")),
        "experience": F.array(F.lit(" "), F.col("p_type"), F.lit(None).cast("string")), "languages": some(F.col("p_size") % 5 == 0, F.array(F.lit("fr"), F.lit(" en "))), "location": F.col("p_brand"),
    }
    return p.select("p_partkey", profile.cv_text(form).alias("cv"))


@query("j_profile_json", """select p_partkey as doc_id, to_json({'title_line': p_name, 'experience_years': p_size, 'domain': case when p_size % 2 = 0 then p_brand end, 'skill_terms': string_split(p_name, ' ')})::varchar as profile from part""")
def j_profile_json(spark, d):
    p = part(spark, d).select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title_line"), F.col("p_size").alias("experience_years"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("domain"), F.split("p_name", " ").alias("skill_terms"))
    return profile.as_json(p)
