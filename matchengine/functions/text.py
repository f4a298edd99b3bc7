"""Text and list functions as Column expressions: folding, tokens, sentences, keyword lists, keys and chunks."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BULLET = r"^\s*(?:[•◦‣▪·\-*]|\(?\d+[.)])\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.cache
def decomposed() -> tuple[str, str, dict[str, str]]:
    """Of the characters outside ASCII whose compatibility decomposition has ASCII ones: those with one and, in the same
    order, that one; and those with several, with them."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x30000)):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            several[c] = plain
    return "".join(one), "".join(one.values()), several


@functools.cache
def _any_of(characters: str) -> str:
    """A regular expression for one of these characters, neighbouring ones as ranges."""
    codes = sorted(map(ord, characters))
    known = set(codes)
    first, last = [c for c in codes if c - 1 not in known], [c for c in codes if c + 1 not in known]
    return "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in zip(first, last, strict=True)) + "]"


def _spread(c: Column) -> Column:
    """Ligatures, fractions and the like as the characters they stand for; a text with any is parted at these alone."""
    several = decomposed()[2]
    # one literal for all pairs: as a literal each, thousands of them would slow down the planning of every query
    pairs = F.str_to_map(F.lit("\u0001".join(f"{c}\u0002{plain}" for c, plain in several.items())), F.lit("\u0001"), F.lit("\u0002"))
    one = _any_of("".join(several))
    # parted by a private character, which folding drops like any other outside ASCII
    parts = F.transform(F.split(F.regexp_replace(c, f"({one})", "\uE000$1\uE000"), "\uE000"), lambda x: F.coalesce(F.try_element_at(pairs, x), x))
    return F.when(c.rlike(one), F.array_join(parts, "")).otherwise(c)


def fold(c: Column | str, quotes: bool = False) -> Column:
    """Lower case without accents: compatibility decomposition, of which what is outside ASCII is dropped. quotes:
    typographic ones become '. A text of ASCII alone is only lowered."""
    c = _col(c)
    accented, plain, _ = decomposed()
    wide = F.translate(c, "’´`", "'''") if quotes else c
    wide = F.lower(F.regexp_replace(F.translate(_spread(wide), accented, plain), r"[^\x00-\x7F]+", ""))
    return F.when(c.rlike(r"[^\x00-\x7F]"), wide).otherwise(F.lower(F.translate(c, "`", "'") if quotes else c))


def skill_tokens(c: Column | str) -> Column:
    """Words of letters, digits, #, + and inner dots of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9#+](?:[a-z0-9#+.]*[a-z0-9#+])?"), F.lit(0))


def canonical_tokens(c: Column | str) -> Column:
    """Words of two letters or digits and more of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]{2,}"), F.lit(0))


def replace_words(c: Column, pairs: dict[str, str]) -> Column:
    """Whole-word replacements in the folded text, longest source first, one after the other."""
    c = F.translate(fold(c), ".", " ")
    for source, target in sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])):
        c = F.regexp_replace(c, rf"\b{source}\b", target)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def runs(tokens: Column | str, most: int) -> Column:
    """Structs (pos, first, run) of each token: its place, itself, and it with the ``most`` - 1 behind it, one blank apart.
    ``tokens`` should be a column, not a long expression: it is read for every token."""
    t = _col(tokens)
    return F.transform(t, lambda x, i: F.struct(i.alias("pos"), x.alias("first"), F.concat_ws(" ", x, *[F.get(t, i + k) for k in range(1, most)]).alias("run")))


def sentences(c: Column | str) -> Column:
    """Parts between line ends, bullets and full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), r"[\r\n•.]"), lambda s: F.trim(s)), lambda s: s != "")


def evidence(c: Column | str, keywords: Column | str, most: int = 4) -> Column:
    """The first sentences that hold one of the keywords, folded, anywhere in them."""
    told = lambda k: F.filter(sentences(c), lambda s: bound(fold(s), lambda f: F.exists(k, lambda w: F.contains(f, w))))
    return F.slice(bound(F.transform(_col(keywords), lambda w: fold(w)), told), 1, most)


def person_key(c: Column | str) -> Column:
    """The name's words in order of the alphabet; null of fewer than two."""
    words = F.array_sort(F.regexp_extract_all(fold(c), F.lit("[a-z]{2,}"), F.lit(0)))
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def keyword_lines(c: Column | str) -> Column:
    """Keywords, one a line, without bullets, blanks and a short heading line that calls them keywords."""
    lines = F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), BULLET, "")))
    heading = lambda x: fold(x).rlike(r"mots?[ -]?cles?|keyword") & (F.size(F.split(x, r"\s+")) <= 6)
    return F.filter(lines, lambda x: (x != "") & ~heading(x))


def join_keywords(c: Column | str) -> Column:
    return F.array_join(_col(c), ",")


def split_keywords(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: x != "")


def clean_lines(c: Column | str) -> Column:
    """Lines after cleaning: line ends unified, words cut by a hyphen joined, white space collapsed, bullets and soft
    hyphens gone, under two characters dropped, a line like the one before dropped, a long one kept twice at most. Each
    line is folded once, and counted."""
    t = F.regexp_replace(F.regexp_replace(_col(c), r"\r\n?", "\n"), r"(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, "■", "fi"), "­", "")
    bullet, blanks = re.compile(BULLET, re.ASCII), re.compile(r"[ \t ]+")

    def clean(text: str) -> list[str]:
        out, before, often = [], "", Counter()
        for line in text.split("\n"):
            x = blanks.sub(" ", bullet.sub("", line)).strip(" ")
            if len(x) < 2:
                before = ""
                continue
            key = folded(x)
            if key != before and (len(x) <= 20 or often[key] < 2):
                out.append(x)
                often[key] += 1
            before = key
        return out

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else clean(t) for x in texts], pa.list_(pa.string()))

    return run(t)


def folded(text: str) -> str:
    """fold() of a string."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def chunks(c: Column | str, size: int = 800, most: int | None = None) -> Column:
    """Windows of up to ``size`` characters that end behind the last line end, or else the last blank, in them, until
    nothing is left or, if ``most`` is given, after that many windows. Null texts give null."""

    def cut(text: str) -> list[str]:
        out, at, windows = [], 0, 0
        while at < len(text) and (most is None or windows < most):
            end = at + size
            if end < len(text):
                end = text.rfind("\n", at, at + size) + 1 or text.rfind(" ", at, at + size) + 1 or at + size
            piece = text[at:end].strip(" ")
            if piece:
                out.append(piece)
            at, windows = end, windows + 1
        return out

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else cut(t) for x in texts], pa.list_(pa.string()))

    return run(_col(c))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often ``f`` names it; null is bound too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def first_match(text: Column, patterns: dict[str, str]) -> Column:
    """The first label whose pattern occurs, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items()])


def words_pattern(words: list[str]) -> str:
    """A pattern of any of the words or phrases as whole words."""
    return r"\b(?:" + "|".join(words) + r")\b"


def token_slices(tokens: Column | str, budget: int) -> Column:
    """Parts of ``budget`` tokens, the last one shorter; none of no tokens."""
    t = _col(tokens)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(t) / budget).cast("int")), lambda i: F.slice(t, i * budget + 1, budget)) if budget > 0 else F.array(t)


def budget_pieces(tokens: Column | str, most: int = 512, special: int = 2) -> Column:
    """token_slices() for a model that takes ``most`` tokens, of which ``special`` are its own."""
    return F.filter(token_slices(tokens, max(1, most - special)), lambda x: F.size(x) > 0)


def all_matches(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose patterns occur, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items()]), lambda x: x.isNotNull())


def label(name: Column | str, path: Column | str) -> Column:
    """The trimmed name, or else the path's file name without its ending."""
    named = F.trim(_col(name))
    return F.coalesce(F.when(named != "", named), F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1))
