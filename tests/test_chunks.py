"""Chunks against brute force, over long and unbroken texts."""

import random

import pytest
from pyspark.sql import functions as F

from matchengine.functions import text as T
from matchengine.plans.texts import h_chunk


def brute(text, size=800):
    out, rest = [], text
    while rest:
        window, at = rest[:size], len(rest)
        if len(rest) > size:
            at = size
            for mark in " \n":
                if mark in window:
                    at = len(window) - window[::-1].index(mark)
        piece, rest = rest[:at].strip(" "), rest[at:]
        out += [piece] if piece else []
    return out


def texts():
    rng = random.Random(5)
    yield ("See\n- " + "x" * 900) * 100
    yield ("a line of an ordinary text, of some words\n" * 18_000)[:755_000]
    yield "y" * 500_000
    yield " " * 5000 + "é\U0001f600" * 3000 + "\n" * 2000
    for _ in range(60):
        yield "".join(rng.choice(["\n", " ", "  ", "ab", "\t", "é", "z" * rng.randint(1, 1200)]) for _ in range(rng.randint(0, 200)))


def test_whole_texts_as_by_brute_force(spark):
    every = list(texts())
    d = spark.createDataFrame(list(enumerate(every)) + [(-1, None), (-2, ""), (-3, "   ")], "i int, x string")
    got = {r.i: r.y for r in d.select("i", T.chunks(F.col("x")).alias("y")).collect()}
    assert got == {**{i: brute(t) for i, t in enumerate(every)}, -1: None, -2: [], -3: []}
    for i, t in enumerate(every):
        assert "".join("".join(got[i]).split()) == "".join(t.split())


@pytest.mark.parametrize("most", [1, 3])
def test_cap_if_asked_for(spark, most):
    d = spark.createDataFrame([("word " * 2000,)], "x string")
    assert d.select(T.chunks("x", most=most)).first()[0] == brute("word " * 2000)[:most]


def test_registered_query(spark, tmp_path):
    every = list(texts())[:4]
    spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.pos, r.chunk) for r in h_chunk(spark, str(tmp_path)).collect())
    assert got == [(i, k, c) for i, t in enumerate(every) for k, c in enumerate(brute(t))]
