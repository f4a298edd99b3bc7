"""Queries of text, dictionary, field and section operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchengine.functions import text as T
from matchengine.operators import fields, profile, sections, skills
from matchengine.registry import query, table
from matchengine.sources import files

FOLD = lambda c: f"lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g'))"
TOKENS = lambda c: f"list_filter(list_transform(regexp_extract_all(replace({FOLD(c)}, '/', ' '), '[a-z0-9#+.]+'), lambda x: trim(x, '.')), lambda x: x <> '')"

# a small dictionary of frequent words of the test corpus, the same in both engines
ALIASES = [
    (0, "Article", "the"), (0, "Article", "la"), (0, "Article", "der"), (0, "Genitive", "of"), (0, "Genitive", "of the"), (0, "Genitive", "de la"), (1, "Genitive", "de"), (0, "Conjunction", "and"), (0, "Conjunction", "und"),
    (1, "Preposition", "in"), (1, "Preposition", "in the"), (1, "Preposition", "to"), (2, "Other", "and"), (2, "Pronoun", "it"), (2, "Verb", "is"), (2, "Verb", "est"), (1, "Negation", "no"), (0, "Plural", "les"),
]
ALIAS_SQL = "(select alias, arg_min(canonical, layer * 100 + n) as canonical from (values " + ", ".join(f"({l}, '{c}', '{a}', {i})" for i, (l, c, a) in enumerate(sorted(ALIASES, key=lambda r: (r[0], r[1])))) + ") t(layer, canonical, alias, n) group by alias)"  # noqa: E741


def aliases(spark):
    return skills.layered(spark.createDataFrame(ALIASES, "layer int, canonical string, alias string"))


def docs(spark, d):
    return files.spread(table(spark, d, "documents"))


@query("h_fold", f"select doc_id, {FOLD('text')} as folded from documents")
def h_fold(spark, d):
    return docs(spark, d).select("doc_id", T.fold("text").alias("folded"))


@query("h_tokens", f"select doc_id, len({TOKENS('text')}) as n, array_to_string({TOKENS('text')}, ' ') as tokens from documents")
def h_tokens(spark, d):
    t = docs(spark, d).select("doc_id", T.skill_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("h_canonical_tokens", f"select conv_id, turn, len(regexp_extract_all({FOLD('text')}, '[a-z0-9]{{2,}}')) as n from conversations")
def h_canonical_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.canonical_tokens("text")).cast("long").alias("n"))


@query("h_synonyms", "select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name), '.', ' '), '\\bsmall\\b', 'little', 'g'), '\\bred\\b', 'rouge', 'g'), '\\s+', ' ', 'g')) as name from part")
def h_synonyms(spark, d):
    return table(spark, d, "part").select("p_partkey", T.replace_words(F.col("p_name"), {"small": "little", "red": "rouge"}).alias("name"))


GRAMS = f"""with t as (select doc_id, {TOKENS('text')} as t from documents), g as (
    {' union all '.join(f"select doc_id, {n} as n, unnest(generate_series(0, len(t) - {n})) as pos, t from t where len(t) >= {n}" for n in range(1, 6))}),
    h as (select doc_id, canonical, g.n, min(pos) as pos from g join {ALIAS_SQL} a on a.alias = array_to_string(t[pos + 1 : pos + g.n], ' ') group by 1, 2, 3),
    r as (select *, row_number() over (partition by doc_id, canonical order by n desc) as k from h)"""


@query("h_ngram_lookup", GRAMS + " select doc_id, canonical, n, pos from r where k = 1")
def h_ngram_lookup(spark, d):
    return skills.find_skills(docs(spark, d), aliases(spark)).select("doc_id", "canonical", F.col("n").cast("int").alias("n"), F.col("pos").cast("long").alias("pos"))


@query("h_skill_list", GRAMS + " select doc_id, string_agg(canonical, ',' order by pos, n desc, canonical) as skills from r where k = 1 group by 1")
def h_skill_list(spark, d):
    return skills.skill_lists(skills.find_skills(docs(spark, d), aliases(spark))).select("doc_id", T.join_keywords("skills").alias("skills"))


@query("h_partition", GRAMS + " select doc_id, string_agg(canonical, ',' order by canonical) filter (canonical not in ('Verb', 'Other', 'Article')) as hard, string_agg(canonical, ',' order by canonical) filter (canonical in ('Verb', 'Other')) as soft from r where k = 1 group by 1")
def h_partition(spark, d):
    s = skills.skill_lists(skills.find_skills(docs(spark, d), aliases(spark)))
    hard, soft = skills.partition(F.col("skills"), ["Verb"], ["Other"], ["Article"])
    none = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ","))
    return s.select("doc_id", none(hard).alias("hard"), none(soft).alias("soft"))


@query("g_layer_union", """with l as (select p_size % 3 as layer, p_brand as canonical, case when p_size % 7 = 0 then left(p_name, 1) else p_name end as alias from part)
    select alias, arg_min(canonical, (layer, canonical)) as canonical from l where layer = 0 or length(alias) >= 2 group by alias""")
def g_layer_union(spark, d):
    """One canonical for each alias of three layers; some aliases are of one letter."""
    p = table(spark, d, "part")
    return skills.layered(p.select((F.col("p_size") % 3).alias("layer"), F.col("p_brand").alias("canonical"), F.expr("case when p_size % 7 = 0 then left(p_name, 1) else p_name end").alias("alias")))


@query("h_normalize", f"select p_partkey, a.canonical from part left join {ALIAS_SQL} a on a.alias = (case when p_size % 2 = 0 then 'the' when p_size % 3 = 0 then 'of the' else lower(p_name) end)")
def h_normalize(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr("case when p_size % 2 = 0 then 'The' when p_size % 3 = 0 then 'Of/The' else p_name end").alias("term"))
    return t.join(skills.normalise(t.select("term").distinct(), aliases(spark)), "term").select("p_partkey", "canonical")


@query("h_fuzzy")
def h_fuzzy(spark, d):
    words = docs(spark, d).select(F.explode(T.skill_tokens("text")).alias("word"))
    return skills.fuzzy(words, spark.createDataFrame([("thattion",), ("schenei",), ("mentaux",)], "target string"))


@query("h_similar_names")
def h_similar_names(spark, d):
    """Words of the benchmark's texts that resemble a word of the conversations, which is another."""
    words = lambda t, c: table(spark, d, t).select(F.explode(T.skill_tokens("text")).alias(c)).filter(F.length(c) >= 4)
    return skills.resembling(words("benchmark", "word"), words("conversations", "target")).filter("word <> target").select("word", "target", F.round("ratio", 6).alias("ratio"))


SIGNALS = {"english": ["the", "of", "that", "tion"], "french": ["les", "est", "une", "queeaux"], "german": ["der", "und", "die"], "spanish": ["del", "los", "para"]}
STRONG = {"english": ["the", "of"], "french": ["est"]}
ORDER = ["german", "spanish", "french", "english"]
POINTS = fields.signals(SIGNALS, STRONG)
PAD = f"(' ' || regexp_replace({FOLD('text[1:3000]')}, '[^a-z0-9]+', ' ', 'g') || ' ')"
POINT_SQL = {o: " + ".join(f"case when contains(t, ' {s} ') then {p} else 0 end" for x, s, p in POINTS if x == o) for o in ORDER}


@query("h_domain", f"with d as (select doc_id, {PAD} as t from documents), p as (select doc_id, {', '.join(f'{v} as {k}' for k, v in POINT_SQL.items())} from d) select doc_id, case when greatest({', '.join(ORDER)}) = 0 then 'general' " + " ".join(f"when {o} = greatest({', '.join(ORDER)}) then '{o}'" for o in ORDER) + " end as domain from p")
def h_domain(spark, d):
    return docs(spark, d).select("doc_id", fields.domain(F.col("text"), POINTS, ORDER).alias("domain"))


@query("h_domain_default", "select doc_id, 'general' as domain from documents")
def h_domain_default(spark, d):
    """The fixed signals, none of which a corpus of invented words has."""
    return docs(spark, d).select("doc_id", fields.domain(F.col("text")).alias("domain"))


@query("h_lang", f"select doc_id, array_to_string(list_filter([case when regexp_matches({FOLD('text')}, '\\bfrancais\\b|\\bfrench\\b') then 'français' end, case when regexp_matches({FOLD('text')}, '\\banglais\\b|\\benglish\\b|\\bbilingue anglais\\b') then 'anglais' end], lambda x: x is not null), ',') as languages from documents")
def h_lang(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(fields.languages(F.col("text")), ",").alias("languages"))


SENTENCE = "'Contrat ' || (case c_custkey % 5 when 0 then 'CDI' when 1 then 'stage, remote' when 2 then 'Indépendant' when 3 then 'full-time' else c_mktsegment end)"


@query("h_contract", f"select c_custkey, case c_custkey % 5 when 0 then 'CDI' when 1 then 'Stage' when 2 then 'Freelance' when 3 then 'Temps plein' end as contract from customer")
def h_contract(spark, d):
    return table(spark, d, "customer").select("c_custkey", fields.contract(F.expr(SENTENCE)).alias("contract"))


@query("h_years_explicit", "select o_orderkey, case when o_orderkey % 60 between 1 and 40 then o_orderkey % 60 end as years from orders")
def h_years_explicit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fields.stated_years(F.expr("concat('Profil de ', o_orderkey % 60, ' années d’expérience, ', o_orderpriority)")).alias("years"))


@query("h_date_ranges", "select o_orderkey, cast(least(o_orderkey % 15, 2025 - (2000 + o_orderkey % 24)) * (case when 2000 + o_orderkey % 24 + o_orderkey % 15 <= 2025 then 1 else 0 end) as int) as years from orders")
def h_date_ranges(spark, d):
    t = F.expr("concat('Poste : janvier ', 2000 + o_orderkey % 24, ' – déc. ', 2000 + o_orderkey % 24 + o_orderkey % 15)")
    return table(spark, d, "orders").select("o_orderkey", fields.covered_years(fields.date_ranges(t, 2025)).alias("years"))


@query("h_hedge", f"select o_orderkey, 'Python requis.' as kept, case when o_orderkey % 2 = 0 then 'SQL serait un plus.' else 'Go si possible.' end as hedged from orders")
def h_hedge(spark, d):
    kept, hedged = sections.hedged(F.expr("concat('Python requis. ', case when o_orderkey % 2 = 0 then 'SQL serait un plus.' else 'Go si possible.' end)"))
    return table(spark, d, "orders").select("o_orderkey", kept.alias("kept"), hedged.alias("hedged"))


@query("h_person_key", "select p_partkey, array_to_string(list_sort(regexp_extract_all(lower(p_name), '[a-z]{2,}')), ' ') as person_key from part")
def h_person_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.person_key("p_name").alias("person_key"))


@query("h_hash", "select doc_id, sha256(text) as content_hash from documents")
def h_hash(spark, d):
    return docs(spark, d).select("doc_id", profile.content_hash("text").alias("content_hash"))


@query("h_evidence", "select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n•.]'), lambda x: trim(x)), lambda x: x <> '' and contains(lower(x), 'ation'))[1:4], ' | ') as evidence from documents")
def h_evidence(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.evidence("text", F.array(F.lit("ation"))), " | ").alias("evidence"))


@query("h_keyword_lines", "select o_orderkey, 'SQL,' || o_orderpriority as keywords from orders")
def h_keyword_lines(spark, d):
    t = F.expr("concat('Mots clés :\\n1. SQL\\n\\n', '• ', o_orderpriority, '\\n')")
    return table(spark, d, "orders").select("o_orderkey", T.join_keywords(T.keyword_lines(t)).alias("keywords"))


# each step cuts one window behind its last line end, or else its last blank, or else at its end
CHUNKS = """with recursive c(doc_id, rest, piece, nth) as (
        select doc_id, text, '', 0 from documents where text is not null
        union all select doc_id, rest[cut + 1 :], rest[1 : cut], nth + 1 from (select doc_id, rest, nth, case when length(rest) <= 800 then length(rest)
            else coalesce(nullif(length(regexp_extract(rest[1 : 800], '(?s)^.*\n')), 0), nullif(length(regexp_extract(rest[1 : 800], '(?s)^.* ')), 0), 800) end as cut from c where rest <> '')),
    k as (select doc_id, nth, trim(piece, ' ') as chunk from c where nth > 0)"""


@query("h_chunk", CHUNKS + " select doc_id, cast(row_number() over (partition by doc_id order by nth) - 1 as int) as pos, chunk from k where chunk <> ''")
def h_chunk(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.chunks("text")).alias("pos", "chunk"))


@query("h_clean")
def h_clean(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.clean_lines("text"), "\n").alias("cleaned"))


@query("h_line_dedupe", f"""with l as (select doc_id, i, line, {FOLD('line')} as k from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
    p as (select *, lag(k) over (partition by doc_id order by i) as b from l), q as (select * from p where b is null or b <> k), n as (select *, row_number() over (partition by doc_id, k order by i) as n from q)
    select doc_id, count(*) as kept from n where length(line) <= 20 or n <= 2 group by 1""")
def h_line_dedupe(spark, d):
    return sections.without_repeats(sections.lines(docs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("kept"))


HEADS = {"first": "the", "second": "of"}


@query("f_section_carry", f"""with l as (select conv_id, turn, role, text from conversations), h as (select *, case when role = 'assistant' then 'a' || turn end as heading from l)
    select conv_id, turn as pos, coalesce(last_value(heading ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), 'other') as section from h""")
def f_section_carry(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", F.concat(F.lit("a"), F.col("turn").cast("string"))).alias("heading"))
    return sections.carry(c, "conv_id").select("conv_id", "pos", "section")


@query("h_sections")
def h_sections(spark, d):
    return sections.sectioned(docs(spark, d)).select("doc_id", "section", F.length("body").alias("n_chars"))


@query("h_profile")
def h_profile(spark, d):
    p = profile.profiles(docs(spark, d), aliases(spark), 2025)
    lists = [T.join_keywords(c).alias(c) for c in ("language_terms", "education_tokens", "skill_terms", "required_skill_terms", "nice_skill_terms", "title_skills")]
    return p.select("doc_id", "domain", "contract_type", "experience_years", "title_line", *lists)


@query("h_title_line", "select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] as title_line from documents")
def h_title_line(spark, d):
    return docs(spark, d).select("doc_id", fields.title_line(F.col("text")).alias("title_line"))


@query("g_set_ops", "select p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') as common, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as missing from (select p_partkey, string_split(p_name, ' ') as a, ['red', 'small', 'widget'] as b from part)")
def g_set_ops(spark, d):
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("small"), F.lit("widget"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("common"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("missing"))


@query("g_ordered_distinct", f"""with w as (select conv_id, turn, x, min(i) as i from (select conv_id, turn, unnest(regexp_extract_all({FOLD('text')}, '[a-z0-9]{{2,}}')) as x, generate_subscripts(regexp_extract_all({FOLD('text')}, '[a-z0-9]{{2,}}'), 1) as i from conversations) group by 1, 2, 3)
    select conv_id, turn, string_agg(x, ' ' order by i) as words from w group by 1, 2""")
def g_ordered_distinct(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.canonical_tokens("text")).alias("w"))
    return c.filter(F.size("w") > 0).select("conv_id", "turn", F.array_join("w", " ").alias("words"))


@query("i_keywords_csv", "select p_partkey, array_to_string(list_filter(string_split(replace(p_name, ' ', ','), ','), lambda x: x <> ''), ';') as keywords from part")
def i_keywords_csv(spark, d):
    c = T.split_keywords(T.join_keywords(F.split("p_name", " ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(c, ";").alias("keywords"))


@query("a_ocr_gate", "select doc_id, case when length(trim(text)) < 20 then 'empty' end as reason from documents where length(trim(text)) < 20")
def a_ocr_gate(spark, d):
    return docs(spark, d).select("doc_id", files.ocr_reason(F.col("text"), F.lit(0.0)).alias("reason")).filter("reason = 'empty'")


@query("a_gutter", """with l as (select conv_id, turn, (turn % 3) * 200.0 as x0, (turn % 3) * 200.0 + 90 + turn % 5 as x1 from conversations), b as (select *, max(x1) over (partition by conv_id order by x0, x1 rows between unbounded preceding and 1 preceding) as b from l),
    g as (select conv_id, arg_max((x0 + b) / 2, (x0 - b) * 1e6 + (x0 + b) / 2) as m, max(x0 - b) as g from b group by 1) select conv_id as doc_id, case when g >= 0.02 * 595 then m else 297.5 end as gutter from g""")
def a_gutter(spark, d):
    x = (F.col("turn") % 3) * 200.0
    l = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), x.alias("x0"), (x + 90 + F.col("turn") % 5).alias("x1"), F.lit(595.0).alias("width"))  # noqa: E741
    return files.gutters(l).select("doc_id", "gutter")


# even turns are the left column, odd ones the right; a page with little text on a side is read from top to bottom
COLUMNS = """select conv_id as doc_id, string_agg(text, chr(10) order by case when two then turn % 2 else 0 end, turn, text) as text from (select *, least(l, r) >= 0.15 * (l + r) as two from
    (select *, sum(case when turn % 2 = 0 then length(text) else 0 end) over (partition by conv_id) as l, sum(case when turn % 2 = 1 then length(text) else 0 end) over (partition by conv_id) as r from conversations)) group by 1"""


@query("a_column_text", COLUMNS)
def a_column_text(spark, d):
    return columns(spark, d)


@query("a_column_order", f"select doc_id, length(text) as n_chars from ({COLUMNS})")
def a_column_order(spark, d):
    return columns(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars"))


def columns(spark, d):
    x = F.when(F.col("turn") % 2 == 0, 50.0).otherwise(320.0)
    l = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), x.alias("x0"), (x + 200).alias("x1"), (F.col("turn") * 12.0).alias("y0"), F.lit(595.0).alias("width"), "text")  # noqa: E741
    return files.reading_order(l).select("doc_id", "text")


@query("a_markdown_sections", "select conv_id as doc_id, role as heading, trim(text) as body from conversations")
def a_markdown_sections(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("t")))), lambda s: s["t"]), "\n").alias("text"))
    return files.markdown_sections(c).filter("heading is not null").select("doc_id", "heading", "body")
