"""The divergence audit against a plain version in exact integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchengine.llm import divergence
from matchengine.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, least=10):
    count, seen, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = words(text)
        count[lang, source].update(w)
        seen[lang].update(set(w))
        total[lang].update(w)
    kept = {a: {t for t, n in c.items() if n >= least} for a, c in seen.items()}
    far = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(c, terms):
        n = sum(c[t] for t in terms)
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(terms)) for t in terms}

    out = []
    own = {g: shares(c, kept.get(g[0], set())) for g, c in count.items()}
    for (a, s), c in count.items():
        p, q = own[a, s], shares(total[a], kept.get(a, set()))
        pairs = [(-sum(far(p[t], own[a, o][t]) for t in p), o.encode()) for b, o in count if b == a and o != s]
        terms = [(-far(p[t], q[t]), t.encode()) for t in p if c[t] and p[t] > q[t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(a, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return Counter(out)


def rows(df):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_whole_table(spark, sf):
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert {p[2] for p in want} == {"pair", "term"}
    assert rows(QUERIES["op12_source_divergence"](spark, sf)) == want


ODD = [
    (None, None, None), ("", "", ""), ("42 _ [", "xx", "a"), (None, "xx", "b"), ("A aÉa", "en", None), ("B c", "en", "s0"), ("only here", "zz", "alone"), ("a" * 5000, "en", "s1"), ("\x00a\x7fb", "en", "s1"),
]


@pytest.mark.parametrize("least, width, height", [(10, 4096, 64), (1, 3, 2), (2, 1, 1)])
def test_tiles_of_every_size(spark, least, width, height):
    rng = np.random.default_rng(5)
    docs = ODD * 2 + [(" ".join(f"w{'xyzuv'[x]}" for x in rng.integers(0, 5, int(rng.integers(0, 30)))), "en", f"s{int(rng.integers(0, 7))}") for _ in range(150)]
    docs += [("the same line, one source", "en", "s1")] * 60
    d = spark.createDataFrame([(*r, *"abcdef") for r in docs], "text string, lang string, source string, place string, term string, n string, docs string, i string, total string")
    assert rows(divergence.audit(d.repartition(3), least, width, height)) == brute(docs, least)


def test_long_texts_and_collisions(monkeypatch):
    text = ("alpha bêta. " * 30 + "x" * 90 + " end").encode()
    monkeypatch.setattr(divergence, "STEP", 64)
    parts = list(divergence._long(text))
    assert b"".join(parts) == text and len(parts) > 4
    assert sum((words(p.decode()) for p in parts), []) == words(text.decode())
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 3)
    body = np.frombuffer(text + text[::-1].replace(b"\xaa\xc3", b"zz"), np.uint8)
    terms, number, _ = divergence.grouped(body, np.array([0, len(text)]))
    assert [terms[i].decode() for i in number] == words(text.decode()) + words(bytes(body[len(text) :]).decode())
    assert len(set(terms)) == len(terms)


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    total = rng.integers(1, divergence.MOST_TOTAL, 2000)
    n = (total * rng.random(2000)).astype(np.int64)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
    assert divergence.share(np.array([0]), np.array([0])).tolist() == [1]
    with pytest.raises(OverflowError):
        divergence.share(np.array([1]), np.array([10**16]))


def test_sums_of_empty_rows():
    assert divergence.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
