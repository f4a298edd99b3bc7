"""Pair-scoring components. Each is a pair of Columns: the score and whether there is a signal; a component without
a signal takes no part in the average and its weight goes to the others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchengine.functions.constants import COMPONENTS, EDUCATION_STOPWORDS, PROFILES, SENIORITY
from matchengine.functions.text import fold

Signal = tuple[Column, Column]


def _either(*cases: tuple[Column, float, bool], otherwise: Signal) -> Signal:
    score, signal = otherwise
    for test, s, sig in reversed(cases):
        score, signal = F.when(test, F.lit(float(s))).otherwise(score), F.when(test, F.lit(sig)).otherwise(signal)
    return score, signal


def _empty(a: Column) -> Column:
    return F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0


def skill_weights(required: Column, title: Column, weak: Column) -> Column:
    """A number for each required skill: 3 if the title names it, a quarter if it is a weak one, else 1."""
    return F.transform(required, lambda s: F.when(F.array_contains(title, s), 3.0).when(F.array_contains(weak, s), 0.25).otherwise(1.0))


def skill_coverage(cv: Column, required: Column, nice: Column, title: Column, weak: Column, semantic: Column | None = None) -> Signal:
    """Weighted share of the required skills that the CV has. semantic: credit 0 to 1 for each required skill that it
    lacks, a map by skill. Nice-to-have skills count 15 in 100 where there are any."""
    credit = lambda s: F.coalesce(F.try_element_at(semantic, s), F.lit(0.0)) if semantic is not None else F.lit(0.0)
    weights = skill_weights(required, title, weak)
    got = F.zip_with(required, weights, lambda s, w: w * F.when(F.array_contains(cv, s), 1.0).otherwise(credit(s)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    share = total(got) / total(weights)
    with_nice = F.when(_empty(nice), share).otherwise(0.85 * share + 0.15 * F.size(F.array_intersect(cv, nice)) / F.size(F.array_distinct(nice)))
    return _either((_empty(required), 0.5, False), (_empty(cv), 0.0, True), otherwise=(F.least(F.lit(1.0), with_nice), F.lit(True)))


def semantic_credit(similarity: Column, threshold: float = 0.6, most: float = 0.8) -> Column:
    """What a lacking skill earns by its nearest one: nothing below the threshold, ``most`` at 1."""
    return F.when(similarity >= threshold, most * F.least(F.lit(1.0), (similarity - threshold) / (1 - threshold))).otherwise(0.0)


def experience_zone(cv: Column, job: Column) -> Column:
    """1 from the years asked for to twice as many, falling to 0.85 at four times; below, the share of the years."""
    r = cv / job
    return F.when(cv < job, F.greatest(F.lit(0.0), 1 - (job - cv) / job)).when(r <= 2, 1.0).when(r >= 4, 0.85).otherwise(1 - 0.15 * (r - 2) / 2)


def experience(cv: Column, job: Column, inferred: Column | None = None) -> Signal:
    """Years against years; inferred: years that the offer's wording implies, counted half, where it states none."""
    inferred = F.lit(0) if inferred is None else inferred
    asked = F.when(job > 0, job).otherwise(inferred)
    raw = experience_zone(cv, asked)
    return _either(
        ((asked <= 0) & (cv <= 0), 0.5, False), (asked <= 0, 0.75, False), (cv <= 0, 0.2, False), otherwise=(F.when(job > 0, raw).otherwise(0.5 * raw + 0.5 * 0.75), F.lit(True))
    )


def seniority_years(title: Column, text: Column) -> Column:
    """Years that the title, or else the text's beginning, implies; 0 of none."""
    t = fold(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring(text, 1, 500)))
    return F.coalesce(*[F.when(t.rlike(rf"\b{w}e?s?\b"), F.lit(y)) for w, y in SENIORITY], F.lit(0))


def education_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(EDUCATION_STOPWORDS)))


def education(cv: Column, job: Column) -> Signal:
    """Jaccard likeness of two token lists."""
    return _either((_empty(cv) | _empty(job), 0.5, False), otherwise=(F.size(F.array_intersect(cv, job)) / F.size(F.array_union(cv, job)), F.lit(True)))


def languages(cv: Column, job: Column) -> Signal:
    return _either((_empty(job), 0.5, False), (_empty(cv), 0.3, False), otherwise=(F.size(F.array_intersect(cv, job)) / F.size(F.array_distinct(job)), F.lit(True)))


def contract(cv: Column, job: Column) -> Signal:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return _either((blank(job), 0.5, False), (blank(cv), 0.4, False), otherwise=(F.when(cv == job, 1.0).otherwise(0.0), F.lit(True)))


def priority_keywords(cv: Column, asked: Column, credit: Column | None = None) -> Signal:
    """Share of the distinct keywords asked for that the CV has, plus credit, at most 1."""
    asked = F.array_distinct(asked)
    return _either((_empty(asked), 0.5, False), otherwise=(F.least(F.lit(1.0), (F.size(F.array_intersect(cv, asked)) + (F.lit(0.0) if credit is None else credit)) / F.size(asked)), F.lit(True)))


def core_coverage(cv: Column, core: Column) -> Column:
    """Share of the core keywords that the CV has; 1 where there are none."""
    return F.when(_empty(core), 1.0).otherwise(F.size(F.array_intersect(cv, core)) / F.size(F.array_distinct(core)))


def profile_weights(profile: Column) -> dict[str, Column]:
    """Weight of each component under the named profile, the first one of an unknown name."""
    first = next(iter(PROFILES))
    out = {}
    for i, c in enumerate(COMPONENTS):
        w = F.lit(PROFILES[first][i])
        for name, values in PROFILES.items():
            w = F.when(profile == name, F.lit(values[i])).otherwise(w)
        out[c] = w
    return out


def final_score(parts: dict[str, Signal], weights: dict[str, Column], core: Column) -> Column:
    """Weighted mean over the components with a signal (the semantic one always), 0 to 1, capped by poor skills and
    priority keywords, lowered by lacking core keywords; times 100, not rounded."""
    used = {c: F.when(F.lit(True) if c == "semantic" else parts[c][1], weights[c]).otherwise(0.0) for c in COMPONENTS if c in parts}
    value = sum((used[c] * parts[c][0] for c in used), F.lit(0.0)) / sum(used.values(), F.lit(0.0))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    for c in ("skills", "priority_keywords"):
        if c in parts:
            value = F.when(parts[c][1], F.least(value, 0.30 + 0.70 * parts[c][0])).otherwise(value)
    return 100 * F.when(core < 1, value * (0.45 + 0.55 * core)).otherwise(value)


def low_confidence(parts: dict[str, Signal]) -> Column:
    """Names of the components without a signal, in their fixed order."""
    return F.filter(F.array(*[F.when(~parts[c][1], F.lit(c)) for c in COMPONENTS if c in parts and c != "semantic"]), lambda x: x.isNotNull())


def hybrid_score(vector: Column, lexical: Column, wv: float = 0.3, wl: float = 0.7) -> Column:
    return (vector * wv + lexical * wl) / (wv + wl) if wv + wl > 0 else vector


def vector_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance) * 100


def tone(score: Column) -> Column:
    return F.when(score >= 80, "Fort").when(score >= 60, "Moyen").otherwise("À vérifier")


def domain_label(job: Column, cv: Column) -> Column:
    return F.when(job != "general", job).otherwise(cv)


def backoff(attempt: Column, base: float = 0.5, most: float = 10.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
