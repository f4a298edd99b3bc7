"""Skill dictionary: layered aliases, n-gram lookup, fuzzy words, partition and normalisation."""

from __future__ import annotations

import difflib
import functools
import itertools
import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchengine.functions.batches import small
from matchengine.functions.text import fold, replace_words, skill_tokens

MOST_ALIASES = 200_000  # rows of a dictionary that is sent to every task; a larger one is joined by hash
MOST_WORDS = 1 << 17  # whose resemblance a worker remembers
MOST_CHARACTERS = 4_000_000  # of its aliases: each is a node of the automaton at most, some 50 bytes


def layered(layers: DataFrame) -> DataFrame:
    """(alias, canonical) of (layer, canonical, alias): the lowest layer wins, then the first canonical. Aliases are
    brought to the form of a text's tokens; lower layers' ones of one character do not count."""
    key = F.array_join(skill_tokens("alias"), " ")
    rows = layers.withColumn("alias", key).filter((F.col("alias") != "") & ((F.col("layer") == 0) | (F.length("alias") >= 2)))
    w = Window.partitionBy("alias").orderBy("layer", "canonical")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("alias", "canonical")


@dataclass(frozen=True)
class Dictionary:
    """Aliases (alias, canonical), and the automaton that finds them in a row of tokens, sent to every task; None of a
    dictionary beyond MOST_ALIASES rows or MOST_CHARACTERS characters."""

    aliases: DataFrame
    sent: object | None


def compiled(aliases: DataFrame) -> Dictionary:
    """A dictionary that is compiled once and serves any number of searches. One job counts it and fetches it, if it is
    small enough to be sent."""
    rows = aliases.select("alias", "canonical").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES or sum(len(r.alias) for r in rows) > MOST_CHARACTERS:
        return Dictionary(aliases, None)
    named: dict[str, list[str]] = {}
    for alias, canonical in rows:
        named.setdefault(alias, []).append(canonical)
    trie = ahocorasick.Automaton()
    for alias, names in named.items():  # with blanks about them, aliases begin and end where tokens do
        trie.add_word(f" {alias} ", (alias.count(" ") + 1, len(alias) + 1, names))
    trie.make_automaton()
    return Dictionary(aliases, aliases.sparkSession.sparkContext.broadcast(trie if named else None))


def _best_runs(trie, tokens: str | None) -> dict[str, tuple[int, int]]:
    """(tokens, first token's number) of each canonical's longest alias among tokens one blank apart, the first of equal ones."""
    if not tokens or trie is None:
        return {}
    text = f" {tokens} "
    best: dict[str, tuple[int, int]] = {}
    for end, (n, size, names) in trie.iter(text):
        for name in names:
            if n > best.get(name, (0, 0))[0]:
                best[name] = n, end - size
    if not best:
        return best
    blanks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)  # folded tokens are ASCII
    place = np.searchsorted(blanks, [at for _, at in best.values()]).tolist()
    return {name: (n, p) for (name, (n, _)), p in zip(best.items(), place, strict=True)}


def _joined(docs: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """``docs`` with the tokens of each text in a string _t0, _t1, ..."""
    return docs.withColumns({f"_t{i}": F.array_join(skill_tokens(c), " ") for i, c in enumerate(texts)})


def find_skills(docs: DataFrame, aliases: DataFrame | Dictionary, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, canonical, n, pos): for each skill the first place of its longest run. Runs overlap freely."""
    return find_in_fields(docs, aliases, id_, (text,)).drop("field")


def find_in_fields(docs: DataFrame, aliases: DataFrame | Dictionary, id_: str, texts: tuple[str, ...]) -> DataFrame:
    """find_skills() over several columns in one pass: (id, field, canonical, n, pos).

    A compiled() dictionary walks each text once and sends on hits alone; a DataFrame is compiled first. One too large for
    that is joined by hash, whole runs of each length that it has, so that a frequent first word is no hot key."""
    known = aliases if isinstance(aliases, Dictionary) else compiled(aliases)
    best = F.max(F.struct("n", (-F.col("pos")).alias("back"))).alias("_b")
    found = _walked(docs, known.sent, id_, texts) if known.sent is not None else _by_hash(docs, known.aliases, id_, texts)
    return found.groupBy(id_, "field", "canonical").agg(best).select(id_, "field", "canonical", "_b.n", (-F.col("_b.back")).alias("pos"))


def _walked(docs: DataFrame, sent, id_: str, texts: tuple[str, ...]) -> DataFrame:
    names = [f"_t{i}" for i in range(len(texts))]
    rows = _joined(docs, texts).select(id_, *names)
    schema = T.StructType([rows.schema[id_], *(T.StructField(c, T.StringType()) for c in ("field", "canonical")), *(T.StructField(c, T.IntegerType()) for c in ("n", "pos"))])

    def run(batches):
        trie = sent.value
        for b in small(batches):
            row, out = [], []
            for k, field in enumerate(texts):
                for i, tokens in enumerate(b.column(k + 1).to_pylist()):
                    hits = _best_runs(trie, tokens)
                    row += [i] * len(hits)
                    out += [(field, name, n, p) for name, (n, p) in hits.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_, "field", "canonical", "n", "pos"])

    return rows.mapInArrow(run, schema)


def _by_hash(docs: DataFrame, aliases: DataFrame, id_: str, texts: tuple[str, ...]) -> DataFrame:
    keys = aliases.withColumn("_n", F.size(F.split("alias", " ")))
    lengths = sorted(r[0] for r in keys.select("_n").distinct().collect())  # a handful
    fields = F.array(*[F.struct(F.lit(c).alias("field"), skill_tokens(c).alias("t")) for c in texts])
    toks = docs.select(id_, F.explode(fields).alias("_f")).select(id_, "_f.field", F.col("_f.t").alias("_t"))
    rows = toks.select(id_, "field", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_m"), "_t")
    grams = F.transform("_t", lambda x, i: F.struct(i.alias("pos"), F.array_join(F.slice("_t", i + 1, F.col("_m")), " ").alias("run")))
    rows = rows.select(id_, "field", F.inline_outer(F.slice(grams, 1, F.greatest(F.size("_t") - F.col("_m") + 1, F.lit(0)))))
    return rows.join(keys, F.col("run") == F.col("alias")).select(id_, "field", "canonical", F.col("_n").alias("n"), "pos")


def with_lists(rows: DataFrame, known: Dictionary, names: dict[str, str], id_: str) -> DataFrame:
    """``rows`` with a column of the skills of each of the texts ``names``, in order of place, longer runs first. A sent
    dictionary does it row by row; a larger one's hits are joined back by ``id_``."""
    if known.sent is None:
        lists = field_lists(find_in_fields(rows, known, id_, tuple(names)), names, id_)
        out = rows.join(lists, id_, "left")
        return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names.values()})
    sent, own = known.sent, rows.columns
    joined = _joined(rows, tuple(names))
    schema = T.StructType([*rows.schema, *(T.StructField(n, T.ArrayType(T.StringType())) for n in names.values())])

    def run(batches):
        trie = sent.value
        for b in small(batches):
            lists = []
            for k in range(len(names)):
                found = [_best_runs(trie, t) for t in b.column(len(own) + k).to_pylist()]
                lists.append(pa.array([sorted(f, key=lambda c: (f[c][1], -f[c][0], c)) for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), *lists], [*own, *names.values()])

    return joined.mapInArrow(run, schema)


def with_whitelist(docs: DataFrame, hits: DataFrame, aliases: DataFrame, whitelist: list[str], id_: str = "doc_id", text: str = "text", synonyms: dict[str, str] | None = None, cutoff: float = 0.8) -> DataFrame:
    """Adds to hits of find_skills() the skills of a short list that the dictionary did not find: first those that stand
    in the text as words, then those of four characters and more that a word of it resembles by ``cutoff``. They come
    behind the text's tokens, in the list's order, those that stand in it first; n is 0."""
    terms = docs.sparkSession.createDataFrame([(i, w, w.lower()) for i, w in enumerate(whitelist) if w], "k int, term string, target string")
    wanted = terms.join(normalise(terms.select("term").distinct(), aliases), "term", "left").select("k", "target", F.coalesce("canonical", "term").alias("canonical"))
    plain = docs.select(id_, replace_words(F.col(text), synonyms or {}).alias("_x"), F.size(skill_tokens(text)).alias("_size"))
    both = _listed(plain, whitelist, id_, cutoff)
    first = both.join(F.broadcast(wanted), "k").groupBy(id_, "canonical").agg(F.min(F.struct("_pass", "k", "_size")).alias("_b"))  # the list's rows
    known = hits.select(id_, F.lower("canonical").alias("_c")).distinct()
    new = first.withColumn("_c", F.lower("canonical")).join(known, [id_, "_c"], "left_anti")
    place = F.row_number().over(Window.partitionBy(id_).orderBy("_b._pass", "_b.k"))
    return hits.select(id_, "canonical", "n", "pos").unionByName(new.select(id_, "canonical", F.lit(0).alias("n"), (F.col("_b._size") + place - 1).cast("int").alias("pos")))


def _listed(plain: DataFrame, whitelist: list[str], id_: str, cutoff: float, least: int = 4) -> DataFrame:
    """(id, _size, k, _pass) of texts _x: the numbers of the list's terms that stand in one as words, and in pass 1 of those
    of ``least`` characters and more that one of its words resembles, found by similarity_keys(). Both in one walk: a
    text's words are not sent on."""
    trie = ahocorasick.Automaton()
    for w in {w.lower() for w in whitelist if w}:
        trie.add_word(w, (len(w), [i for i, x in enumerate(whitelist) if x.lower() == w]))
    trie.make_automaton()
    sent = plain.sparkSession.sparkContext.broadcast(trie if len(trie) else None)
    schema = T.StructType([plain.schema[id_], *(T.StructField(c, T.IntegerType()) for c in ("_size", "k", "_pass"))])
    targets: dict[str, list[int]] = {}
    for i, w in enumerate(whitelist):
        if len(w) >= least:
            targets.setdefault(w.lower(), []).append(i)

    def run(batches):
        trie, word, of_word = sent.value, re.compile(r"[a-z0-9+.#]+"), re.compile(r"[A-Za-z0-9_]")
        keyed: dict[str, list[str]] = {}
        for target in targets:
            for key in similarity_keys(target, cutoff, False):
                keyed.setdefault(key, []).append(target)
        matcher = difflib.SequenceMatcher()

        @functools.lru_cache(MOST_WORDS)
        def near(w: str) -> tuple[int, ...]:
            out = []
            for target in {t for key in similarity_keys(w, cutoff, True) for t in keyed.get(key, ())}:
                matcher.set_seq2(target)
                matcher.set_seq1(w)
                if matcher.quick_ratio() >= cutoff and matcher.ratio() >= cutoff:
                    out += targets[target]
            return tuple(out)

        for b in small(batches):
            row, ks, late = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                x = x or ""
                inside = lambda at, x=x: 0 <= at < len(x) and of_word.match(x[at]) is not None
                stands = set()
                for end, (size, numbers) in trie.iter(x) if trie else ():
                    start = end - size + 1
                    if inside(start - 1) != inside(start) and inside(end) != inside(end + 1):
                        stands.update(numbers)
                alike = {k for w in set(word.findall(x)) for k in near(w)}
                row += [i] * (len(stands) + len(alike))
                ks += [*sorted(stands), *sorted(alike)]
                late += [0] * len(stands) + [1] * len(alike)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(ks, pa.int32()), pa.array(late, pa.int32())], [id_, "_size", "k", "_pass"])

    return plain.select(id_, "_x", "_size").mapInArrow(run, schema)


# the letters of words from rare to frequent; where two words have few letters apart, they share one of their rarest
RARE_FIRST = "qxzjkvwybgpfmhdculosrtnaie"


def _letters(word: str) -> list[str]:
    """A word's letters as different elements, the second "o" being another than the first, the rarest first."""
    seen: dict[str, int] = {}
    out = []
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        out.append((RARE_FIRST.find(c), -seen[c], c))
    return [f"{c}{-n}" for _, n, c in sorted(out)]


def similarity_keys(word: str, cutoff: float, first: bool) -> list[str]:
    """Keys of which two words that can have a Ratcliff-Obershelp ratio of ``cutoff`` share one.

    The ratio is 2 m / (a + b) for words of a and b characters with m matched ones, so m is cutoff * (a + b) / 2 at least,
    which bounds b by a; and as many letters are common. Of two sets with m common elements, in one order, the first
    a - m + 3 of one and b - m + 3 of the other share three, which are a key with both lengths; fewer if m is less."""
    a, letters, out = len(word), _letters(word), []
    for b in range(max(1, int(a * cutoff / (2 - cutoff))), int(a * (2 - cutoff) / cutoff) + 2):
        common = max(1, math.ceil(cutoff * (a + b) / 2 - 1e-9))
        if common <= min(a, b):
            pair = f"{a},{b}" if first else f"{b},{a}"
            many = min(3, common)
            out += [",".join((pair, *x)) for x in itertools.combinations(letters[: a - common + many], many)]
    return out


def resembling(words: DataFrame, targets: DataFrame, cutoff: float = 0.8, least: int = 4) -> DataFrame:
    """(word, target, ratio) of each distinct word and each distinct target of ``least`` characters and more whose
    Ratcliff-Obershelp ratio reaches the cutoff. They meet by similarity_keys() alone, and are compared where they meet."""
    return _compared(candidates(words, targets, cutoff, least), cutoff)


def candidates(words: DataFrame, targets: DataFrame, cutoff: float = 0.8, least: int = 4) -> DataFrame:
    """The (word, target) that share a key."""
    keys = lambda d, c, first: d.select(F.col(c)).distinct().filter(F.length(c) >= (0 if first else least)).mapInArrow(_keys(cutoff, first, c), f"{c} string, key string")
    return keys(words, "word", True).join(keys(targets, "target", False), "key").select("word", "target").distinct()


def _keys(cutoff: float, first: bool, name: str):
    def run(batches):
        for b in small(batches):
            own = [similarity_keys(w, cutoff, first) for w in b.column(0).to_pylist()]
            index = pa.array(np.repeat(np.arange(len(own)), [len(k) for k in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), pa.array([k for ks in own for k in ks], pa.string())], [name, "key"])

    return run


def _compared(pairs: DataFrame, cutoff: float) -> DataFrame:
    def run(batches):
        for b in small(batches):
            m, ratio, last = difflib.SequenceMatcher(), [], None
            for word, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if target != last:
                    m.set_seq2(target)
                    last = target
                m.set_seq1(word)
                ratio.append(m.ratio() if m.quick_ratio() >= cutoff else 0.0)
            r = pa.array(ratio, pa.float64())
            keep = pa.array([x >= cutoff for x in ratio], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), r], ["word", "target", "ratio"]).filter(keep)

    return pairs.repartition("target").sortWithinPartitions("target").mapInArrow(run, "word string, target string, ratio double")


def skill_lists(hits: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, skills) in order of place, longer runs first."""
    return hits.groupBy(id_).agg(_in_order().alias("skills"))


def _in_order(where: Column | None = None) -> Column:
    one = F.struct("pos", (-F.col("n")).alias("m"), "canonical")
    return F.transform(F.array_sort(F.collect_list(one if where is None else F.when(where, one))), lambda x: x["canonical"])


def field_lists(hits: DataFrame, names: dict[str, str], id_: str = "doc_id") -> DataFrame:
    """skill_lists() of find_in_fields(): a column for each field, named by ``names``."""
    return hits.groupBy(id_).agg(*[_in_order(F.col("field") == f).alias(c) for f, c in names.items()])


def fuzzy(words: DataFrame, targets: DataFrame, cutoff: float = 0.8, least: int = 4) -> DataFrame:
    """(word, target): for each distinct word of ``least`` characters and more its likeliest target, the last of equal
    ones, where the ratio reaches the cutoff."""
    near = resembling(words.filter(F.length("word") >= least), targets, cutoff, 1)
    return near.groupBy("word").agg(F.max(F.struct("ratio", "target")).alias("_b")).select("word", "_b.target")


def partition(skills: Column, soft: list[str], generic: list[str], languages: list[str]) -> tuple[Column, Column]:
    """(hard, soft): generic skills count as soft, languages as neither."""
    among = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    s = among([*soft, *generic])
    return F.array_except(F.array_except(skills, s), among(languages)), F.filter(F.array_except(skills, among(languages)), lambda x: F.array_contains(s, x))


def normalise(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, canonical): by the folded term; else, where it has slashes, the one skill on which its parts agree."""
    whole = terms.select("term", F.array_join(skill_tokens("term"), " ").alias("alias")).join(aliases, "alias", "left").select("term", F.col("canonical").alias("_whole"))
    parts = terms.filter(F.contains("term", F.lit("/"))).select("term", F.explode(F.split("term", "/")).alias("_p"))
    parts = parts.select("term", F.array_join(skill_tokens("_p"), " ").alias("alias")).join(aliases, "alias").groupBy("term").agg(F.collect_set("canonical").alias("_c"))
    out = whole.join(parts, "term", "left")
    return out.select("term", F.coalesce("_whole", F.when(F.size("_c") == 1, F.col("_c")[0])).alias("canonical"))


def repeated(terms: DataFrame, least: int = 3) -> DataFrame:
    """(id, canonical) typed ``least`` times or more."""
    return terms.groupBy("id", "canonical").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def word_in_text(term: Column, text: Column) -> Column:
    """Whether the folded term stands in the folded text between characters that are no words'."""
    pad = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.contains(pad(text), pad(term)) & (F.trim(pad(term)) != "")
