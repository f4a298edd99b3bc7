"""The language model's orders against a plain Kneser-Ney model."""

import math
import re
from collections import Counter, defaultdict

import pytest

from matchengine.llm import kneser_ney

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def plain(train, order):
    """log10 probability of a text, by dictionaries of tuples."""
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple((["<"] * (order - 1) + d)[i : i + order]) for d in train for i in range(len(d)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    less, after, tot = [None], [defaultdict(Counter) for _ in counts], [Counter() for _ in counts]
    for k in range(1, order + 1):
        less.append((0, *kneser_ney.discounts(*(sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)))))
        for g, c in counts[k].items():
            after[k][g[:-1]][min(c, 3)] += 1
            tot[k][g[:-1]] += c
    v = len(counts[1])

    def prob(g):
        low = prob(g[1:]) if len(g) > 1 else 1 / (v + 1)
        k, h = len(g), g[:-1]
        if not tot[k][h]:
            return low
        c, d = counts[k][g], less[k]
        return max(c - d[min(c, 3)], 0) / tot[k][h] + sum(d[i] * m for i, m in after[k][h].items()) / tot[k][h] * low

    return prob, lambda d: sum(math.log10(prob(tuple((["<"] * (order - 1) + d)[i : i + order]))) for i in range(len(d)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_every_order(spark, texts, order):
    rows = [(i, t, i % 5 == 0) for i, t, _ in texts if t is None or len(t) < 20_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    model = kneser_ney.fit(docs.filter("not held_out"), order)
    train = [tokens(t) for _, t, held in rows if not held]
    prob, score = plain(train, order)
    words = {w for d in train for w in d}
    for h in [("<",) * (order - 1), (None,) * (order - 1), tuple(max(train, key=len)[: order - 1])]:
        assert sum(prob((*h, w)) for w in words) + prob((*h, "unseen")) == pytest.approx(1)
    assert model.n == sum(map(len, train)) and model.v == len(words) and model.texts == len(train)
    want = sorted((i, len(tokens(t)), score(tokens(t))) for i, t, _ in rows)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in kneser_ney.score(docs, model).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    model = kneser_ney.fit(docs.filter("not held_out"), 3)
    assert {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in kneser_ney.score(docs, model).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}


def test_shards_grow_with_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i} c {i % 7} a b", i % 2 == 0) for i in range(300)], "doc_id long, text string, held_out boolean")
    few = kneser_ney.fit(docs, 3)
    monkeypatch.setattr(kneser_ney, "SHARD_TEXT", 40)
    many = kneser_ney.fit(docs, 3)
    assert (few.shards, few.spread) == (8, 8) and many.shards > 100 and many.spread > 8
    scores = [{r.doc_id: r.score for r in kneser_ney.score(docs, m).collect()} for m in (few, many)]
    assert scores[0] == pytest.approx(scores[1])
