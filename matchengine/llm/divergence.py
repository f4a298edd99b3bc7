"""Divergence audit of sources: how far the term frequencies of each (lang, source) lie from its peers' and its language's.

Texts are taken as concatenated UTF-8 buffers: a lookup table of 256 bytes lowers ASCII letters and marks every other
ASCII byte as a boundary, xxhash groups the slices between boundaries and the bytes of each are held against its group's
first. Each task counts its own (lang, source, term) rows, Spark adds them up. Kept terms are dealt to blocks of about
``WIDTH`` and sources to blocks of ``HEIGHT``; a tile of two source blocks and a term block is a compressed sparse row
matrix whose divergences ``reduceat`` sums. What absent terms add depends on two totals alone, so that only counted terms
are visited. Tiles are bounded however many terms, sources and rows there are; the pairs of a language's sources are as
many as the result wants.

All arithmetic is in integers; ``share`` divides in three steps of a thousand, exact up to 9 * 10^15 terms in a group, and
fails beyond. Defined cases: null text, lang and source are empty ones; a group without kept terms has the share that
smoothing gives; without any kept term every value is 0; texts of any length are cut at boundaries into steps; equal rows
count each; ties go by UTF-8; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.bpe import pieces
from matchengine.llm.buffers import body_of, cut
from matchengine.llm.store import materialise

LEAST_DOCS = 10
SCALE = 1_000_000_000
MOST_TOTAL = 9 * 10**15  # share() holds remainders of a thousand times as much
TOP = 10
WIDTH, HEIGHT = 4096, 64
STEP = 4_000_000  # bytes of text cut into terms at a time
_bytes = np.arange(256, dtype=np.uint8)
_upper = (_bytes >= 65) & (_bytes <= 90)
LOWERED = np.where(_upper, _bytes + 32, np.where((_bytes >= 97) & (_bytes <= 122) | (_bytes >= 128), _bytes, 0)).astype(np.uint8)  # 0: a boundary


def grouped(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different terms, each occurrence's number among them, its first byte's place) of texts that begin at ``starts``."""
    low = LOWERED[data]
    begin, end = cut(low != 0, starts)
    if not len(begin):
        return [], np.zeros(0, np.int64), begin
    body, digest = low.tobytes(), xxhash.xxh3_64_intdigest
    keys = np.fromiter((digest(body[a:z]) for a, z in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    _, one, number = np.unique(keys, return_index=True, return_inverse=True)
    size = end - begin
    same = size == size[one[number]]
    checked = np.flatnonzero(same)
    many = size[checked]
    offset = np.cumsum(many) - many
    at = np.arange(int(many.sum())) - np.repeat(offset, many)
    differ = low[np.repeat(begin[checked], many) + at] != low[np.repeat(begin[one[number[checked]]], many) + at]
    if len(checked):
        same[checked] = ~np.logical_or.reduceat(differ, offset)
    terms = [body[a:z] for a, z in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
    if not same.all():  # other bytes under a group's hash: told apart by themselves
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            word = body[begin[i] : end[i]]
            if word not in known:
                known[word] = len(terms)
                terms.append(word)
            number[i] = known[word]
    return terms, number.astype(np.int64), begin


def _long(text: bytes) -> Iterator[bytes]:
    """A long text in steps that end at boundaries."""
    at = 0
    while at < len(text):
        to = min(len(text), at + STEP)
        while to < len(text) and LOWERED[text[to - 1]]:
            to += 1
        yield text[at:to]
        at = to


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text), to be added up; an empty term stands for the group itself."""

    def of_piece(code: np.ndarray, texts: pa.Array):
        """(group's code, term, n, docs) of texts of those groups."""
        data, starts = body_of(texts)
        if len(texts) == 1 and len(data) > STEP:
            total: dict[bytes, int] = {}
            for part in _long(data.tobytes()):
                terms, number, _ = grouped(np.frombuffer(part, np.uint8), np.zeros(1, np.int64))
                for t, n in zip(terms, np.bincount(number, minlength=len(terms)).tolist(), strict=True):
                    total[t] = total.get(t, 0) + n
            return np.full(len(total), code[0]), list(total), np.fromiter(total.values(), np.int64, len(total)), np.ones(len(total), np.int64)
        terms, number, begin = grouped(data, starts[:-1])
        if not terms:
            return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.searchsorted(starts, begin, "right") - 1
        cell, n = np.unique(doc * len(terms) + number, return_counts=True)  # rows of documents, columns of terms
        key = code[cell // len(terms)] * len(terms) + cell % len(terms)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        which = key[new] % len(terms)
        return key[new] // len(terms), [terms[i] for i in which.tolist()], np.add.reduceat(n, new), np.diff(np.append(new, len(key)))

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "text", STEP):
                names: dict[tuple[str, str], int] = {}
                code = np.array([names.setdefault(p, len(names)) for p in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)], np.int64)
                group, terms, n, many = of_piece(code, texts)
                every = list(names)
                group = np.concatenate([group, np.arange(len(every))])
                zero = np.zeros(len(every), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([p[k] for p in every], pa.string()).take(pa.array(group)) for k in (0, 1)), pa.array([*terms, *[b""] * len(every)], pa.binary()),
                        pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([many, zero])),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return whole.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), 0 <= n <= total; 1 where total is 0."""
    n, total = np.broadcast_arrays(np.asarray(n, np.int64), np.asarray(total, np.int64))
    if total.size and int(total.max()) > MOST_TOTAL:
        raise OverflowError(f"more than {MOST_TOTAL} terms in a group")
    total = np.maximum(total, 1)
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Of the rows indptr[i] to indptr[i + 1]; an empty row's sum is 0."""
    out = np.zeros(len(indptr) - 1, np.int64)
    some = np.flatnonzero(np.diff(indptr))
    if len(some):
        out[some] = np.add.reduceat(values, indptr[:-1][some])
    return out


def pair_sums(indptr: np.ndarray, col: np.ndarray, p: np.ndarray, rest: np.ndarray, width: int, left: np.ndarray, right: np.ndarray):
    """(a, b, sum) for rows a of ``left`` and b > a of ``right``: far() over the columns, less far() of the rows' rests.

    Row r has shares ``p`` in the columns ``col``, both from indptr[r] on, and the share rest[r] in all others."""
    dense = np.empty(width, np.int64)
    for a in left.tolist():
        b = right[right > a]
        if not len(b):
            continue
        mine = slice(indptr[a], indptr[a + 1])
        dense[:] = rest[a]
        dense[col[mine]] = p[mine]
        lo = int(b[0])
        theirs = slice(indptr[lo], indptr[b[-1] + 1])
        other = np.repeat(rest[lo : b[-1] + 1], np.diff(indptr[lo : b[-1] + 2]))
        x = dense[col[theirs]]
        both = sums(far(x, p[theirs]) - far(x, other), indptr[lo : b[-1] + 2] - indptr[lo])
        alone = np.zeros(len(b), np.int64)
        for at in range(mine.start, mine.stop, WIDTH):
            part = p[at : min(mine.stop, at + WIDTH)]
            alone += far(part[:, None], rest[b][None, :]).sum(0)
        alone -= (mine.stop - mine.start) * far(rest[a], rest[b])
        yield np.full(len(b), a), b, both + alone


def tile(table: pa.Table, height: int) -> pa.Table:
    """Partial rows (lang, part, source, item, value) of one tile; of terms the TOP of each source are enough."""
    i, j, block = (table.column(c)[0].as_py() for c in ("i", "j", "block"))
    place = table.column("place").to_numpy()
    words = table.column("term").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    code, terms = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    named = np.array([len(t) > 0 for t in terms], bool)[code]
    order = np.lexsort((code, place))
    place, code, named = place[order], code[order], named[order]
    n, every, total, terms_of_lang, whole = (table.column(c).to_numpy()[order] for c in ("n", "lang_n", "total", "terms", "lang_total"))
    head = np.flatnonzero(~named)  # the row of each source itself, in order of place
    places = place[head]
    smooth = 2 * terms_of_lang
    rest = share(2 * (smooth[head] > 0), total[head] + smooth[head])
    source = [table.column("source")[k].as_py() for k in order[head].tolist()]
    live = np.flatnonzero(named)
    p = share(n[live] + 2, total[live] + smooth[live])
    col = code[live]
    indptr = np.searchsorted(place[live], np.append(places, places[-1] + 1))
    left, right = np.flatnonzero(places // height == i), np.flatnonzero(places // height == j)
    out = []
    for a, b, value in pair_sums(indptr, col, p, rest, len(terms), left, right):
        if block == 0:  # what the terms that both lack would add, counted for all of the language's
            value = value + int(smooth[0]) // 2 * far(rest[a], rest[b])
        out += [("pair", source[x], source[y], v) for x, y, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True)]
    if i == j:
        q = share(every[live] + 2, whole[live] + smooth[live])
        more = np.flatnonzero(p > q)
        value = far(p[more], q[more])
        rank = np.empty(len(terms), np.int64)
        rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        row = np.searchsorted(indptr, more, "right") - 1
        best = np.lexsort((rank[col[more]], -value, row))
        row, value, more = row[best], value[best], more[best]
        new = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        nth = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        for k in np.flatnonzero(nth < TOP).tolist():
            out.append(("term", source[row[k]], terms[col[more[k]]].decode("utf-8", "replace"), int(value[k])))
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{c: pa.array(v, k) for c, v, k in zip(("part", "source", "item", "value"), cols, (pa.string(),) * 3 + (pa.int64(),), strict=True)}})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source of the language (``pair``) and the terms
    that mark the source most against its language (``term``, the first TOP)."""
    counts = materialise(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    none = F.octet_length("term") == 0
    kept = counts.filter(~none).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialise(kept, "kept")
    live = materialise(counts.filter(~none).select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "live")
    sums_ = live.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    groups = counts.filter(none).select("lang", "source").join(sums_, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["total", "terms", "lang_total"])
    places = Window.partitionBy("lang")
    groups = groups.withColumn("place", F.row_number().over(places.orderBy("source")) - 1).withColumn("tall", F.expr(f"(count(*) over (partition by lang) - 1) div {height}"))
    groups = materialise(groups.withColumn("wide", F.expr(f"greatest((terms + {width - 1}) div {width}, 1)")), "groups")
    rows = live.join(groups, ["lang", "source"]).withColumn("block", F.expr("pmod(xxhash64(term), wide)"))
    heads = groups.withColumn("term", F.lit(b"")).withColumn("n", F.lit(0).cast("long")).withColumn("lang_n", F.lit(0).cast("long")).withColumn("block", F.expr("explode(sequence(0L, wide - 1))"))
    both = rows.unionByName(heads.select(*rows.columns)).withColumn("other", F.expr("explode(sequence(0L, tall))"))
    own = F.expr(f"place div {height}")
    both = both.select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "block", "place", "source", "term", "n", "lang_n", "total", "terms", "lang_total")
    parts = materialise(both.groupBy("lang", "i", "j", "block").applyInArrow(lambda t: tile(t, height), "lang string, part string, source string, item string, value long"), "parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("o")), F.struct(F.col("item").alias("s"), F.col("source").alias("o")))
    pairs = pairs.select("lang", F.explode(ways).alias("w"), "value").select("lang", F.col("w.s").alias("source"), F.lit("pair").alias("part"), F.col("w.o").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", place).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", place).unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The contract's rows."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as c from w group by lang, term having count(distinct id) >= 10),
langs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
g as (select lang, source from d group by lang, source),
c as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join c on g.lang = c.lang and g.source = c.source group by all),
p as (select gn.lang, gn.source, kept.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (gn.n + 2 * langs.v)::hugeint as p,
    1 + (1000000000::hugeint * (kept.c + 2)) // (langs.n + 2 * langs.v)::hugeint as q
    from gn join langs on gn.lang = langs.lang join kept on kept.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from p x join p y on x.term = y.term and x.lang = y.lang
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source),
term as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= 10"""
