"""Removal of long repeated runs of words by matching statistics against suffix automata.

Every window of ``length`` words chooses an anchor, the least hash of its ``K``-word strings (the first of equal ones), so
that equal windows choose alike; neighbouring windows with one anchor form a piece, and equal pieces are one kind with a
weight. The kinds of repeated anchors are the reference. It is dealt to shards by anchor, which brings every place where a
window stands into one shard: a shard's suffix automaton, with the weighted number of places of each state, is built once
and all the documents' different pieces that could match are streamed through it. Where the longest suffix that stands
twice or more has ``length`` words, its maximal span goes.

An automaton is sent to no one but the task that streams its shard. To broadcast every shard to every document, as the
method is usually put, costs shards times documents; here each document meets only the shards that its anchors name, which
loses nothing. A shard holds ``SHARD`` words and at most one anchor more; an anchor with over ``CROWDED`` words of
different kinds (thousands of near copies around one passage) would not fit, so its kinds are parted into windows, and
equal windows are counted by Spark on their words, partly before they are shuffled.

Exact: hashes choose where pieces meet, and a 128-bit hash says which pieces are equal; words are compared by themselves.
Defined cases: a null text has no words; texts shorter than ``length`` keep all; equal rows are copies of each other; null
ids are told apart by their texts; windows are judged on the input; texts of any length are taken in overlapping steps; an
empty table gives no rows; other columns are kept by deduplicated(), whatever their names.
"""

from __future__ import annotations

import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.llm.bpe import pieces
from matchengine.llm.buffers import body_of, cut
from matchengine.llm.store import materialise

LENGTH = 35
K = 8
SHARD = 60_000  # words of an automaton: some 30 MB while it is used
CROWDED = 60_000  # words of one anchor's kinds, beyond which its windows are counted
STEP = 2_000_000  # bytes of text whose anchors are sought at a time
WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
FACTOR = np.uint64(0x9E3779B185EBCA87)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
KEY = ["_doc", "_tag"]


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and FACTOR ** -i modulo 2 ** 64 for i up to ``n``."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, f)])) for f in (FACTOR, INVERSE))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX[0]
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word data[begin:end]."""
    up, down = powers(1 << max(0, int(len(data)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mixed((total[end] - total[begin]) * down[begin])


def anchors(words: np.ndarray, text: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's hash) of each piece of the words with those hashes and numbers of texts."""
    n = len(words) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * FACTOR + words[i : i + len(h)]
    h = mixed(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, width = length - k + 1, 1
    while 2 * width <= wide:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if wide > width:
        key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the window that starts here
    whole = text[:n] == text[length - 1 :]
    same = (at[1:] == at[:-1]) & (text[1:n] == text[: n - 1])
    first = np.flatnonzero(whole & np.append(True, ~(same & whole[:-1])))
    last = np.flatnonzero(whole & np.append(~(same & whole[1:]), True))
    return first, last, h[at[first]]


def steps(texts: pa.Array, length: int):
    """(number of the first text, its word from which windows count, data, starts) of texts some STEP bytes at a time. A
    longer text comes in steps that overlap by length - 1 words."""
    data, offsets = body_of(texts)
    if len(data) <= 2 * STEP:
        yield 0, 0, data, offsets[:-1]
        return
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        begin, end = cut(WORD[data[a:z]], np.zeros(1, np.int64))
        word = 0
        while word == 0 or word + length <= len(begin):
            to = min(len(begin), max(word + length, int(np.searchsorted(begin, (begin[word] if len(begin) else 0) + STEP)) + length - 1))
            yield i, word, data[a + begin[word] : a + end[to - 1]] if to else data[:0], np.zeros(1, np.int64)
            word = to - length + 1 if to < len(begin) else len(begin) + 1


def pieces_of(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """(kmer, s1, s2, *KEY, lo, hi) of every piece of (*KEY, text): its anchor, a hash of its words, its windows. Without
    ``whole`` the anchor alone."""

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "text", STEP):
                for number, shift, data, starts in steps(texts, length):
                    inside = WORD[data]
                    begin, end = cut(inside, starts)
                    text = np.searchsorted(starts, begin, "right") - 1
                    first, last, kmer = anchors(hashed(data, begin, end), text, length, K)
                    kmers = pa.array(kmer.view(np.int64))
                    if not whole:
                        yield pa.RecordBatch.from_arrays([kmers], ["kmer"])
                        continue
                    body, a, z = spoken(data, inside, end - begin)
                    digest = xxhash.xxh3_128_digest
                    two = b"".join([digest(body[x:y]) for x, y in zip(a[first].tolist(), z[last + length - 1].tolist(), strict=True)])
                    two = np.frombuffer(two, np.int64).reshape(-1, 2)
                    own = text[first]
                    base = np.searchsorted(text, own) - shift  # the text's first word
                    index = pa.array(own + number)
                    yield pa.RecordBatch.from_arrays(
                        [kmers, *(pa.array(two[:, c].copy()) for c in (0, 1)), *(rows.column(c).take(index) for c in (0, 1)), *(pa.array((x - base).astype(np.int32)) for x in (first, last))],
                        ["kmer", "s1", "s2", *KEY, "lo", "hi"],
                    )

    return docs.select(*KEY, "text").mapInArrow(run, "kmer long, s1 long, s2 long, _doc long, _tag long, lo int, hi int" if whole else "kmer long")


def spoken(data: np.ndarray, inside: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space behind each, and where each begins and ends."""
    end = np.cumsum(size + 1) - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    return out.tobytes(), end - size, end


class Automaton:
    """The suffix automaton of weighted strings of words, with the longest suffix of each state that has two places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        self.numbers: dict[bytes, int] = {}

    def words(self, text: bytes) -> list[int]:
        number = self.numbers
        return [number.setdefault(w, len(number)) for w in text.split(b" ")]

    def add(self, words: list[int], weight: int) -> None:
        nxt, link, length, places = self.next, self.link, self.length, self.places
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is None:
                state = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                places.append(0)
                p = last
                while p >= 0:
                    if c in nxt[p]:
                        break
                    nxt[p][c] = state
                    p = link[p]
                if p >= 0:
                    link[state] = self._apart(p, c)
                last = state
            else:
                last = self._apart(last, c)
            places[last] += weight

    def _apart(self, p: int, c: int) -> int:
        """The state of p's longest string and ``c``, split off from that of longer ones if need be."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            return q
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.places.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def close(self) -> None:
        """Adds places up along the links; then ``twice`` has of each state with one place its longest suffix with two."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        link, places, length = self.link, self.places, self.length
        for v in reversed(order[1:]):
            places[link[v]] += places[v]
        places[0] = 2
        self.twice = twice = [0] * len(order)
        for v in order[1:]:
            twice[v] = length[v] if places[v] > 1 else twice[link[v]]

    def statistics(self, words: list[int]) -> list[int]:
        """For each word the length of the longest suffix up to it that has two places or more."""
        nxt, link, length, places, twice = self.next, self.link, self.length, self.places, self.twice
        v = held = 0
        out = []
        for c in words:
            q = nxt[v].get(c)
            while q is None and v:
                v = link[v]
                held = length[v]
                q = nxt[v].get(c)
            if q is None:
                held = 0
            else:
                v, held = q, held + 1
            out.append(held if places[v] > 1 else min(held, twice[v]))
        return out


def spans_of(found: list[int], length: int) -> list[dict]:
    """Runs (lo, hi) of the windows that end where ``found`` reaches the length."""
    out = []
    for e, n in enumerate(found):
        if n >= length:
            start = e - length + 1
            if out and out[-1]["hi"] == start - 1:
                out[-1]["hi"] = start
            else:
                out.append({"lo": start, "hi": start})
    return out


SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def stream_shards(length: int):
    """Of (kmer, s1, s2, n, data) in order of kmer: (kmer, s1, s2, spans), the windows of each kind that repeat."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        gc.disable()  # an automaton is some hundred thousand small objects without cycles
        a = Automaton()
        every = [a.words(t) for t in table.column("data").to_pylist()]
        for words, n in zip(every, table.column("n").to_pylist(), strict=True):
            a.add(words, n)
        a.close()
        spans = [spans_of(a.statistics(words), length) for words in every]
        gc.enable()
        some = pa.array([i for i, s in enumerate(spans) if s], pa.int64())
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(some) for c in ("kmer", "s1", "s2")), pa.array([s for s in spans if s], SPANS)], ["kmer", "s1", "s2", "spans"])

    def run(batches):
        held, words = [], 0
        for b in batches:
            kmer, size = b.column(0).to_numpy(), b.column(4).to_numpy()
            at = 0
            for i in range(b.num_rows):
                last = kmer[i - 1] if i else held[-1].column(0)[-1].as_py() if held else None
                if words >= SHARD and last != kmer[i]:
                    yield judge(pa.Table.from_batches([*held, b.slice(at, i - at)]))
                    held, words, at = [], 0, i
                words += int(size[i])
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """As stream_shards(), of anchors with very many kinds: equal windows are counted on their words."""

    def windows(batches):
        for b in batches:
            for r in b.to_pylist():
                words = r["data"].split(b" ")
                many = len(words) - length + 1
                one = [b" ".join(words[i : i + length]) for i in range(many)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]] * many, pa.int64()) for c in ("kmer", "s1", "s2", "n")), pa.array(range(many), pa.int32()), pa.array(one, pa.binary())], ["kmer", "s1", "s2", "n", "at", "win"])

    every = rows.select("kmer", "s1", "s2", "n", "data").mapInArrow(windows, "kmer long, s1 long, s2 long, n long, at int, win binary")
    twice = every.groupBy("kmer", "win").agg(F.sum("n").alias("n")).filter("n > 1").select("kmer", "win")
    hits = every.join(twice, ["kmer", "win"], "left_semi")
    one = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))
    return hits.groupBy("kmer", "s1", "s2").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with KEY: the id, a null as the least long, and a hash of the text, which tells texts of one id apart."""
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_tag", F.xxhash64("text"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(*KEY, spans) of (*KEY, text): for each text with repeats, the runs (lo, hi) of window starts that repeat."""
    texts = docs.select(*KEY, "text")
    # written before each join: Spark splits a hot key's rows only where no aggregate stands between shuffle and join
    twice = materialise(pieces_of(texts, length, False).groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1").select("kmer"), "anchors")
    found = materialise(pieces_of(texts, length, True).join(twice, "kmer", "left_semi"), "pieces")
    kinds = materialise(found.groupBy("kmer", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "hi")).alias("one")), "kinds")
    crowd = kinds.groupBy("kmer").agg(F.sum(F.col("one.hi") - F.col("one.lo") + length).alias("w")).filter(F.col("w") > CROWDED).select("kmer", F.lit(True).alias("crowded"))
    asked = kinds.join(crowd, "kmer", "left").select("one._doc", "one._tag", F.struct("kmer", "s1", "s2", "n", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("s"))
    asked = asked.groupBy(*KEY).agg(F.collect_list("s").alias("s"))

    def fetch(batches):
        for b in batches:
            for text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                inside = WORD[data]
                begin, end = cut(inside, np.zeros(1, np.int64))
                body, a, z = spoken(data, inside, end - begin)
                part = [body[a[x["lo"]] : z[x["hi"] + length - 1]] for x in s]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[c] for x in s], pa.int64()) for c in ("kmer", "s1", "s2", "n")), pa.array([x["hi"] - x["lo"] + length for x in s], pa.int32()), pa.array([x["crowded"] for x in s]), pa.array(part, pa.binary())],
                    ["kmer", "s1", "s2", "n", "words", "crowded", "data"],
                )

    bodies = texts.join(asked, KEY).dropDuplicates(KEY).select("text", "s").mapInArrow(fetch, "kmer long, s1 long, s2 long, n long, words int, crowded boolean, data binary")
    bodies = materialise(bodies, "bodies")
    plain = bodies.filter("not crowded").select("kmer", "s1", "s2", "n", "words", "data").repartition("kmer").sortWithinPartitions("kmer")
    spans = "kmer long, s1 long, s2 long, spans array<struct<lo:int,hi:int>>"
    judged = materialise(plain.mapInArrow(stream_shards(length), spans).unionByName(_crowded(bodies.filter("crowded"), length)), "spans")
    every = found.join(judged, ["kmer", "s1", "s2"]).select(*KEY, "lo", F.explode("spans").alias("s")).select(*KEY, (F.col("lo") + F.col("s.lo")).alias("lo"), (F.col("lo") + F.col("s.hi")).alias("hi"))
    return materialise(every.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")


def gone(words: int, spans: list, length: int) -> np.ndarray:
    """Which of ``words`` lie in a window that repeats."""
    edge = np.zeros(words + 1, np.int64)
    if spans:
        at = np.array([(s["lo"], s["hi"] + length) for s in spans])
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def kept_text(text: str, spans: list, length: int) -> tuple[bytes, int, int]:
    """(the words that stay, joined by spaces, number of words, number of those that go)."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = WORD[data]
    begin, end = cut(inside, np.zeros(1, np.int64))
    stay = ~gone(len(begin), spans, length)
    if not stay.any():
        return b"", len(stay), len(stay)
    size = end - begin
    body, _, _ = spoken(data, inside & np.repeat(stay, size)[np.minimum(np.cumsum(inside) - 1, int(size.sum()) - 1)], size[stay])
    return body[:-1], len(stay), int(len(stay) - stay.sum())


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` under the names c0, c1, ... with their ``spans``."""
    own = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    return own.select("_row", *KEY, "text").join(repeats(own, length), KEY, "left").select("_row", "text", "spans")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents; texts with repeats have the words that stay, one space between, and n_chars is counted anew."""

    def run(batches):
        for b in batches:
            out = [t if not s else kept_text(t, s, length)[0].decode() for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_row", "text"])

    both = _with_spans(docs, length)
    schema = both.select("_row", "text").schema
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return both.mapInArrow(run, schema).select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body, words, removed = kept_text(text or "", spans or [], LENGTH)
                out.append((words, removed, hashlib.sha256(body).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, LENGTH).select("_row.doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""with d as (select row_number() over () as id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select id, k, array_to_string(w[k:k + 34], ' ') as s from (select id, w, unnest(range(1, len(w) - 33)) as k from d)),
twice as (select s from win group by s having count(*) > 1),
hit as (select distinct id, unnest(range(k, k + 35)) as k from win semi join twice using (s)),
word as (select id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
kept as (select id, count(*) as n, string_agg(word, ' ' order by k) as text from word anti join hit using (id, k) group by id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (id)"""
