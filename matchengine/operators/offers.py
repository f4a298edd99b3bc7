"""What is made of a profile: the text for a scorer, a form's draft, spans for annotation; and checks of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.functions.text import canonical_tokens, fold

STRINGS = "array<string>"
UNSAID = "Non renseigné"
DECISIONS = ("accept", "reject", "review")
PROFILES = ("equilibre", "priorite_experience", "priorite_mots_cles")
# Labels of spans and what they look like.
SPANS = {
    "EMAIL": r"[\w.+-]+@[\w-]+\.[\w.-]*\w",
    "PHONE": r"(?:\+\d{2}|\b0)[ .]?\d(?:[ .-]?\d{2}){4}\b",
    "YEARS": r"\b\d{1,2}\s*(?:ans|years)\b",
}


def _filled(*texts: Column) -> Column:
    """The texts that have something, trimmed."""
    return F.filter(F.array(*[F.trim(F.coalesce(t, F.lit(""))) for t in texts]), lambda x: x != "")


def semantic_text(required: Column, skills: Column, summary: Column, cleaned: Column, thin: int = 400, most: int | None = None) -> Column:
    """What a cross-encoder reads of a document: its different informative sections, required first; the whole cleaned
    text where there is none, and behind them where they have under ``thin`` characters. most: a cap, none by default."""

    def told(parts: Column) -> Column:
        joined, tail = F.array_join(parts, "\n"), F.trim(F.coalesce(cleaned, F.lit("")))
        more = F.when((tail != "") & ~F.array_contains(parts, tail), F.trim(F.concat(joined, F.lit("\n"), tail))).otherwise(joined)
        return F.when(F.size(parts) == 0, tail).when(F.length(joined) < thin, more).otherwise(joined)

    whole = F.element_at(F.transform(F.array(F.array_distinct(_filled(required, skills, summary))), told), 1)
    return F.substring(whole, 1, most) if most else whole


def job_offer(job_title: Column, summary: Column, required: Column, nice: Column, cleaned: Column, contract: Column, languages: Column, must: Column, may: Column, file: Column) -> Column:
    """A draft of an offer's form from a parsed document: title, category, contract_type, languages, skills,
    strong_constraints (six lines at most), meta_keywords (ten words at most), description, status."""
    said = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast(STRINGS)
    first = F.get(lines(summary), 0)
    skills = F.array_distinct(F.concat(F.coalesce(must, none), F.coalesce(may, none)))
    body = F.array_join(_filled(required, nice, summary), "\n")
    return F.struct(
        F.coalesce(said(job_title), first, said(F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)), F.lit("Offre")).alias("title"),
        F.coalesce(F.when(F.size(F.split(first, r"\s+")) <= 6, first), F.lit(UNSAID)).alias("category"),
        F.coalesce(said(contract), F.lit(UNSAID)).alias("contract_type"),
        F.when(F.size(F.coalesce(languages, none)) > 0, languages).otherwise(F.array(F.lit("Français"))).alias("languages"),
        skills.alias("skills"),
        F.slice(lines(required), 1, 6).alias("strong_constraints"),
        F.slice(F.array_distinct(canonical_tokens(F.array_join(skills, " "))), 1, 10).alias("meta_keywords"),
        F.when(body != "", body).otherwise(F.substring(F.coalesce(cleaned, F.lit("")), 1, 1000)).alias("description"),
        F.lit("draft").alias("status"),
    )


def is_noise(value: Column, terms: list[str]) -> Column:
    """Whether a value, folded, is a term that says nothing."""
    return F.trim(fold(value)).isin([t.strip() for t in terms])


def valid_entities(found: DataFrame, aliases: DataFrame, value: str = "value") -> DataFrame:
    """Entities with a capital letter that are no known skill."""
    from matchengine.functions.text import skill_tokens

    named = found.filter(F.col(value).rlike(r"\p{Lu}")).withColumn("_a", F.array_join(skill_tokens(value), " "))
    return named.join(aliases.select(F.col("alias").alias("_a")), "_a", "left_anti").drop("_a")


def checked(name: str, allowed: tuple[str, ...]) -> str:
    """The value itself; one that is not allowed is refused before any plan is made."""
    if name not in allowed:
        raise ValueError(f"{name!r} is none of {', '.join(allowed)}")
    return name


def checked_column(c: Column, allowed: tuple[str, ...] = DECISIONS) -> Column:
    """The column; a row with a value that is not allowed stops the query."""
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string"))


def tuning(threshold: float = 0.6, max_credit: float = 0.8) -> dict[str, float]:
    """Arguments of scoring.semantic_credit(), each above 0 and at most 1."""
    for name, x in (("threshold", threshold), ("max_credit", max_credit)):
        if not 0 < x <= 1:
            raise ValueError(f"{name} has to be above 0 and at most 1")
    return {"threshold": threshold, "max_credit": max_credit}


def spans(docs: DataFrame, id_: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """(id, label, start, end, value) of what the patterns find, ends exclusive. Of spans that overlap the earlier stays,
    of those with one start the longer."""
    import re

    import pyarrow as pa

    tests = [(label, re.compile(p)) for label, p in (patterns or SPANS).items()]

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                end = 0
                for start, stop, label in sorted((m.start(), -m.end(), label) for label, p in tests for m in p.finditer(t or "")):
                    if start >= end and -stop > start:
                        end = -stop
                        out.append((i, label, start, end, t[start:end]))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [id_, "label", "start", "end", "value"])

    return docs.select(F.col(id_).cast("long"), text).mapInArrow(run, f"{id_} long, label string, start int, end int, value string")


def annotation_tasks(docs: DataFrame, found: DataFrame, most: int, seed: int = 0, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, task): ``most`` documents, drawn by a seeded hash, as JSON tasks with their spans as predictions."""
    drawn = docs.select(id_, text).orderBy(F.xxhash64(F.lit(seed), id_), id_).limit(most)
    one = F.struct("start", "end", F.col("value").alias("text"), F.array("label").alias("labels"))
    marks = found.groupBy(id_).agg(F.array_sort(F.collect_list(one)).alias("_m"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,text:string,labels:array<string>>>")
    task = F.struct(F.struct(F.col(text).alias("text")).alias("data"), F.coalesce("_m", empty).alias("predictions"))
    return drawn.join(marks, id_, "left").select(id_, F.to_json(task).alias("task"))


def enriched(lookup: DataFrame, terms: DataFrame, id_: str = "id", most: int = 30) -> DataFrame:
    """(id, uris): for each document the different best URIs of its terms (id, pos, term), in order, ``most`` at most.
    lookup: (term, uri, score, rank) of vectors.label_lookup()."""
    best = lookup.filter("rank = 1").select("term", "uri")
    first = terms.join(best, "term").groupBy(id_, "uri").agg(F.min("pos").alias("pos"))
    return first.groupBy(id_).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "uri"))), lambda x: x["uri"]), 1, most).alias("uris"))


def feedback_rows(new: DataFrame, matches: DataFrame, previous: DataFrame) -> DataFrame:
    """Feedback to append, of (match_id, decision, rating, rating_given): a rating that was not given is the previous
    one's, ratings are 1 to 5, and the scores of the match as it is now are kept as a snapshot. Matches that do not exist
    have no row. previous: (match_id, rating) of reads.latest_feedback()."""
    old = previous.select("match_id", F.col("rating").alias("_old"))
    rows = new.join(matches.select(F.col("id").alias("match_id"), F.struct("score", "score_skills", "score_experience").alias("scores_snapshot")), "match_id").join(old, "match_id", "left")
    rating = F.when(F.col("rating_given"), F.col("rating")).otherwise(F.col("_old"))
    return rows.select("match_id", checked_column(F.col("decision")).alias("decision"), F.when(rating.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), rating))).cast("int").alias("rating"), "scores_snapshot")
