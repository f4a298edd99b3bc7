"""Sections: headings are told line by line, the current one is carried on, and lines are gathered under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.functions.constants import HEDGE_FILLERS, HEDGES, SECTIONS
from matchengine.functions.text import bound, fold

# Words that may stand beside a heading's own.
BESIDE = "de des du d la le les l et ou a au aux en mes mon ma vos votre nos notre and of the my your"
ADJECTIVE = r"(elles?|euses?|aux|iques?|ales?|ees?|ives?|ieures?|ipales|clefs?|cles?|majeures?)$"


def lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, line)."""
    return docs.select(id_, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def unspaced(line: Column) -> Column:
    """A heading typed letter by letter, four or more and most of its words, put together."""
    single = lambda parts: F.size(F.filter(parts, lambda p: F.length(p) == 1))
    put = lambda parts: F.when((F.size(parts) >= 4) & (single(parts) >= 0.8 * F.size(parts)), F.array_join(parts, "")).otherwise(line)
    return bound(F.split(F.trim(line), r"\s+"), put)


def _fits(names: str):
    return lambda w: w.rlike(rf"^({names})$") | w.rlike(ADJECTIVE)


def section_of(line: Column, sections: dict[str, list[str]] | None = None) -> Column:
    """The section that a line heads, else null: an alias itself, or one of four characters and more with nothing
    beside it but small words, words of the same section and adjectives. Six words at most."""
    table = sections or SECTIONS
    alias = {" ".join(a.replace("-", " ").split()): s for s, v in reversed(list(table.items())) for a in v}
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*:\s*$", ""), r"[^a-z0-9]+", " "))
    form = lambda x: bound(F.regexp_replace(x, r"\(.*?\)", " "), lambda y: plain(fold(y)))
    # no other line has a section's name
    some = r"\b(?:" + "|".join(sorted({*alias, "formations?", "diplomes?"})) + r")\b"
    names = F.create_map(*[F.lit(x) for a, s in alias.items() for x in (a, s)])

    def told(t: Column) -> Column:
        found = F.try_element_at(names, t)
        near = F.lit(None).cast("string")
        for s in reversed(list(table)):
            own = sorted({w for a in table[s] for w in a.replace("-", " ").split()}, key=lambda w: (-len(w), w))
            fit = "|".join([*own, *BESIDE.split()])
            long = "|".join(sorted((a.replace("-", " ") for a in table[s] if len(a) >= 4), key=lambda a: (-len(a), a)))
            words = F.split(t, " ")
            ok = t.rlike(rf"\b({long})\b") & F.forall(words, _fits(fit))
            near = F.when(ok, F.lit(s)).otherwise(near)
        whole = F.coalesce(found, near)
        both = t.rlike(r"\b(formations?|diplomes?)\b.*\bcertifications?\b")
        return F.when(F.size(F.split(t, " ")) <= 6, F.when(both & whole.isNull(), F.lit("education")).otherwise(whole))

    # letter by letter, a possessive runs into the name behind it
    parted = lambda t: F.regexp_replace(t, r"^(mes|ma|mon|nos|notre)(?=[a-z]{4})", "")

    def heads(x: Column) -> Column:
        one = lambda t: F.when(t.rlike(some), told(t))
        plain = lambda u: bound(form(u), lambda t: F.when(u == x, one(t)).otherwise(F.coalesce(one(t), bound(parted(t), one))))
        return bound(unspaced(x), plain)

    return bound(F.when(F.length(line) <= 120, line), lambda x: F.when(x != "", heads(x)))  # what is longer heads nothing


def classed(title: Column, sections: dict[str, list[str]] | None = None) -> Column:
    """The section of a structured conversion's heading by the longest alias in it, the first of equally long ones; "other"
    of none. An alias of one word has to be a word of the heading, so that "stack" is not found in "full-stack"."""
    known = sorted(((a, s) for s, v in (sections or SECTIONS).items() for a in v), key=lambda x: -len(x[0]))

    def told(t: Column) -> Column:
        words = F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, r"^[:,.;()\[\]]+|[:,.;()\[\]]+$", ""))
        out = [F.struct(F.lit(a).alias("a"), F.lit(s).alias("s"), F.lit(" " in a).alias("long")) for a, s in known]
        return bound(words, lambda w: F.filter(F.array(*out), lambda x: F.when(x["long"], F.contains(t, x["a"])).otherwise(F.array_contains(w, x["a"]))))

    return F.coalesce(F.get(bound(F.lower(F.trim(title)), told), F.lit(0))["s"], F.lit("other"))


def heading_like(ls: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Adds ``heads`` to lines: one to six words, mostly in capitals or with a list's first entry on the next line."""
    after = F.lead("line").over(Window.partitionBy(id_).orderBy("pos"))
    words = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != ""))
    letters, capitals = (F.length(F.regexp_replace("line", p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    listed = F.coalesce(after.rlike(r"^\s*[-•*0-9]\s+"), F.lit(False))
    return ls.withColumn("heads", words.between(1, 6) & (((letters > 0) & (capitals > 0.65 * letters)) | listed))


def carry(heads: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, pos, line, section): the last heading's section up to each line; "other" before any."""
    w = Window.partitionBy(id_).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return heads.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("other")))


def sectioned(docs: DataFrame, id_: str = "doc_id", text: str = "text", sections: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, section, body): lines without the headings, in order. A "Skills: ..." line within experience heads nothing."""
    ls = lines(docs, id_, text).withColumn("heading", section_of(F.col("line"), sections))
    full = carry(ls, id_).filter("heading is null and trim(line) <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return full.groupBy(id_, "section").agg(F.array_join(parts, "\n").alias("body"))


def bodies(text: Column, names: list[str], sections: dict[str, list[str]] | None = None) -> Column:
    """Struct of the bodies of some of the sections, as sectioned() gives them, null of one that is absent: a row's lines
    are parted at its headings within the row, without a shuffle."""

    def parted(ls: Column) -> Column:
        told = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), section_of(x, sections).alias("s"))), lambda m: m["s"].isNotNull())
        return bound(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("other").alias("s"))), told), lambda marks: gathered(ls, marks))

    def gathered(ls: Column, marks: Column) -> Column:
        end = lambda k: F.coalesce(F.get(marks, k + 1)["i"], F.size(ls))
        runs = F.transform(marks, lambda m, k: F.struct(m["s"].alias("s"), F.filter(F.slice(ls, m["i"] + 2, end(k) - m["i"] - 1), lambda x: F.trim(x) != "").alias("l")))
        return bound(runs, lambda r: F.struct(*[_body(r, n).alias(n) for n in names]))

    return bound(F.split(F.coalesce(text, F.lit("")), "\n"), parted)


def _body(runs: Column, name: str) -> Column:
    own = F.flatten(F.transform(F.filter(runs, lambda x: x["s"] == F.lit(name)), lambda x: x["l"]))
    return F.when(F.size(own) > 0, F.array_join(own, "\n"))


# Another name of a section in structured conversions, and the key of a document's title there.
OTHER_NAMES = {"strength": "job_nice"}
TITLE_KEY = "_doc_title"


def overriding(given: Column, name: str) -> Column:
    """A section's body of a map of sections that a structured conversion has split already; null if it has none."""
    own = F.filter(F.map_entries(given), lambda e: F.coalesce(F.get(F.array(*[F.when(e["key"] == k, F.lit(v)) for k, v in OTHER_NAMES.items()]), F.lit(0)), e["key"]).eqNullSafe(F.lit(name)))
    texts = F.filter(F.transform(own, lambda e: F.trim(F.regexp_replace(e["value"], r"^\s+|\s+$", ""))), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def is_hedged(sentence: Column) -> Column:
    """Whether a sentence has a phrase of what is optional: its words in a row, fillers between them left out."""
    few = F.when(sentence.rlike("(?i)plus|atout|appr.{1,3}ci|nice|pr.{1,3}f|possible"), sentence)  # no other can have one
    words = F.filter(F.split(F.coalesce(fold(few), F.lit("")), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(HEDGE_FILLERS))
    plain = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return bound(plain, lambda p: F.exists(F.array(*[F.lit(f" {h}") for h in HEDGES]), lambda h: F.contains(p, h)))


def hedged(text: Column) -> tuple[Column, Column]:
    """(kept, hedged): sentences that call something optional apart from the rest."""
    told = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("s"), is_hedged(s).alias("h")))
    some = lambda h: F.array_join(F.transform(F.filter(told, lambda x: x["h"] == F.lit(h)), lambda x: x["s"]), " ")
    return some(False), some(True)


def without_repeats(ls: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Lines unlike the one before, folded; a line over 20 characters twice at most in a document."""
    w = Window.partitionBy(id_).orderBy("pos")
    keyed = ls.withColumn("_k", fold("line")).withColumn("_b", F.lag("_k").over(w))
    keyed = keyed.filter(F.col("_b").isNull() | (F.col("_k") != F.col("_b")))
    n = F.row_number().over(Window.partitionBy(id_, "_k").orderBy("pos"))
    return keyed.withColumn("_n", n).filter((F.length("line") <= 20) | (F.col("_n") <= 2)).drop("_k", "_b", "_n")
