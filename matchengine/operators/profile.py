"""Documents to typed profiles, and profiles to explained pair scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.functions import scoring
from matchengine.functions.text import bound, canonical_tokens, evidence, fold, keyword_lines
from matchengine.operators import fields, sections, skills

STRINGS = "array<string>"


def profiles(docs: DataFrame, aliases: DataFrame | skills.Dictionary, as_of_year: int, id_: str = "doc_id", text: str = "text", override: str | None = None) -> DataFrame:
    """One row a document: title_line, domain, language_terms, contract_type, experience_years, education_tokens,
    skill_terms, required_skill_terms, nice_skill_terms, title_skills. Sections decide what is required and optional;
    where an offer names no required section, its text without hedged sentences counts. ``override`` names a map of sections
    that were split beforehand: where it has any, they count in place of the text's own, and its title as the title line.

    Everything is made within the document's row: nothing is shuffled but for a dictionary too large to be sent."""
    known = aliases if isinstance(aliases, skills.Dictionary) else skills.compiled(aliases)
    wanted = ["job_required", "job_nice", "education"]
    own = sections.bodies(F.col("_x"), wanted)
    base = docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("_x"), *([F.col(override).alias("_given")] if override else []))
    title = fields.title_line(F.col("_x"))
    if override:
        some = F.size(F.filter(F.map_entries("_given"), lambda e: (e["key"] != sections.TITLE_KEY) & (F.trim(e["value"]) != ""))) > 0
        given = F.struct(*[sections.overriding(F.col("_given"), n).alias(n) for n in wanted])
        own = F.when(some, given).otherwise(own)
        title = F.coalesce(F.when(F.trim(F.try_element_at("_given", F.lit(sections.TITLE_KEY))) != "", F.trim(F.try_element_at("_given", F.lit(sections.TITLE_KEY)))), title)
    out = base.select(
        id_,
        title.alias("title_line"),
        fields.domain(F.col("_x")).alias("domain"),
        fields.languages(F.col("_x")).alias("language_terms"),
        fields.contract(F.col("_x")).alias("contract_type"),
        fields.years(F.col("_x"), as_of_year).alias("experience_years"),
        "_x",
        own.alias("_s"),
    )
    # true of every row: without a filter between, the optimizer would compute _s anew for each of its uses
    out = out.filter(F.monotonically_increasing_id() >= 0)
    kept, optional = sections.hedged(F.coalesce(F.col("_s.job_required"), F.col("_x")))
    out = out.select("*", F.struct(kept.alias("kept"), optional.alias("optional")).alias("_h"))
    out = out.withColumn("_req", F.col("_h.kept")).withColumn("_nice", F.concat_ws("\n", F.coalesce("_s.job_nice", F.lit("")), F.col("_h.optional")))
    out = out.withColumn("education_tokens", scoring.education_tokens(F.coalesce("_s.education", F.lit("")))).drop("_s", "_h")
    names = {"_x": "skill_terms", "_req": "required_skill_terms", "_nice": "nice_skill_terms", "title_line": "title_skills"}
    return skills.with_lists(out, known, names, id_).drop("_x", "_req", "_nice")


def score(pairs: DataFrame, weak: list[str] = (), semantic: Column | None = None) -> DataFrame:
    """Adds score, its components, matched and missing skills and low-confidence names to rows with a cv and a job
    struct of profiles(). semantic: a scorer's column; without one every pair gets 0.5."""
    cv, job = F.col("cv"), F.col("job")
    none = F.array(*[F.lit(w) for w in weak]).cast(STRINGS)
    required = F.when(F.size(job["required_skill_terms"]) > 0, job["required_skill_terms"]).otherwise(job["skill_terms"])
    parts = {
        "semantic": (F.lit(0.5) if semantic is None else semantic, F.lit(True)),
        "skills": scoring.skill_coverage(cv["skill_terms"], required, job["nice_skill_terms"], job["title_skills"], none),
        "priority_keywords": scoring.priority_keywords(cv["skill_terms"], job["priority_keywords"]) if "priority_keywords" in pairs.select("job.*").columns else (F.lit(0.5), F.lit(False)),
        "experience": scoring.experience(cv["experience_years"], job["experience_years"], scoring.seniority_years(job["title_line"], job["title_line"])),
        "education": scoring.education(cv["education_tokens"], job["education_tokens"]),
        "languages": scoring.languages(cv["language_terms"], job["language_terms"]),
        "contract": scoring.contract(cv["contract_type"], job["contract_type"]),
    }
    profile = job["scoring_profile"] if "scoring_profile" in pairs.select("job.*").columns else F.lit("equilibre")
    total = scoring.final_score(parts, scoring.profile_weights(profile), F.lit(1.0))
    out = pairs.withColumn("score", total)
    for c, (value, _) in parts.items():
        out = out.withColumn(f"score_{c}", value)
    out = out.withColumn("common_skills", F.array_sort(F.array_intersect(cv["skill_terms"], required))).withColumn("missing_skills", F.array_sort(F.array_except(required, cv["skill_terms"])))
    return out.withColumn("low_confidence", scoring.low_confidence(parts)).withColumn("domain", scoring.domain_label(job["domain"], cv["domain"]))


def explanation(common: Column, missing: Column, score_: Column, years: Column, asked: Column, text: Column) -> Column:
    """Struct (why, vigilance, evidence): ordered sentences, "aucun" where a list has nothing, eight keywords a line."""
    some = lambda a: F.array_join(F.slice(a, 1, 8), ", ")
    lines = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    or_none = lambda a: bound(a, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("aucun"))))
    why = lines(F.when(F.size(common) > 0, F.concat(F.lit("Compétences communes : "), some(common))), F.when((asked > 0) & (years >= asked), F.format_string("Expérience suffisante : %d ans pour %d demandés", years, asked)), F.when(score_ >= 80, F.lit("Score élevé")))
    care = lines(F.when(F.size(missing) > 0, F.concat(F.lit("Compétences manquantes : "), some(missing))), F.when((asked > 0) & (years < asked), F.format_string("Expérience insuffisante : %d ans pour %d demandés", years, asked)))
    return F.struct(or_none(why).alias("why"), or_none(care).alias("vigilance"), or_none(evidence(text, common)).alias("evidence"))


def offer_text(title: Column, company: Column, skills_: Column, constraints: Column, body: Column) -> Column:
    """A form's fields as a text; missing ones read "Non renseigné"."""
    said = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c)).otherwise(F.lit("Non renseigné"))
    list_ = lambda a, n: said(F.array_join(F.slice(F.coalesce(a, F.array().cast(STRINGS)), 1, n), ", "))
    return F.concat_ws("\n", said(title), F.concat(F.lit("Entreprise : "), said(company)), F.concat(F.lit("Compétences requises : "), list_(skills_, 10)), F.concat(F.lit("Contraintes : "), list_(constraints, 6)), said(body))


def cv_text(form: dict[str, Column]) -> Column:
    """A CV form's fields (full_name, headline, status, summary, contract_type, location; arrays skills, experience,
    education, certifications, languages) as a text whose headings sections.bodies() finds again."""
    none = F.lit(None).cast("string")
    text = lambda n: F.trim(F.coalesce(form.get(n, none), F.lit("")))
    items = lambda n: F.filter(F.transform(F.coalesce(form.get(n, F.lit(None).cast(STRINGS)), F.array().cast(STRINGS)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    said = lambda n, other: F.when(text(n) != "", text(n)).otherwise(F.lit(other))
    bullets = lambda n: F.when(F.size(items(n)) > 0, F.array_join(F.transform(items(n), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit("Aucune"))
    named = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    lines = [F.lit("CV STRUCTURÉ"), named("Nom complet", text("full_name")), named("Titre professionnel", text("headline")), named("Statut", said("status", "published")), F.lit("Profil"), text("summary")]
    for label, n in (("Compétences", "skills"), ("Expérience", "experience"), ("Formation", "education"), ("Certifications", "certifications")):
        lines += [F.lit(label), bullets(n), F.lit("")]
    spoken = F.when(F.size(items("languages")) > 0, F.array_join(items("languages"), ", ")).otherwise(F.lit("Français"))
    lines += [named("Langues", spoken), named("Contrat recherché", said("contract_type", "Non renseigné")), named("Localisation", said("location", "Non renseignée"))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def as_json(profiles_: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, profile): each profile as a JSON object, absent values as null."""
    fields_ = F.struct(*[F.col(f"`{c}`") for c in profiles_.columns if c != id_])
    return profiles_.select(id_, F.to_json(fields_, {"ignoreNullFields": "false"}).alias("profile"))


def priority(jobs: DataFrame, aliases: DataFrame, text: str = "priority_text", id_: str = "id") -> DataFrame:
    """(id, keywords): keyword lines brought to canonical skills, each once; unknown ones stay as typed."""
    rows = jobs.select(id_, F.posexplode(keyword_lines(text)).alias("_p", "term"))
    named = rows.join(skills.normalise(rows.select("term").distinct(), aliases), "term", "left").withColumn("_k", F.coalesce("canonical", "term"))
    first = named.groupBy(id_, "_k").agg(F.min("_p").alias("_p"))
    return first.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_k"))), lambda x: x["_k"]).alias("keywords"))


def content_hash(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def tokens_of(c: str) -> Column:
    return canonical_tokens(fold(c))
