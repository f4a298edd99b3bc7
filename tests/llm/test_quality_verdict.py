"""The quality rules' verdict against a plain version, and what it makes of labelled documents."""

import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from matchengine.llm.queries import QUERIES
from tests.llm.test_operators import WORD, brute_quality

BUCKETS, ALPHA, SLACK, PRIOR = 16384, 50.0, 0.09, 20.0


def grams(text):
    """Buckets of the hashed words and word pairs."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [x % BUCKETS for x in h + two]


def test_verdict(spark, sf, texts):
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    raw, good = Counter(), Counter()
    for i, t, _ in texts:
        g = grams(t)
        raw.update(g)
        good.update(g if i in trusted else ())
    r, n = sum(raw.values()), sum(good.values())
    ratio = [math.log((good[b] * r / n + ALPHA) / (raw[b] + ALPHA)) for b in range(BUCKETS)]
    mean = sum(c * ratio[b] for b, c in good.items()) / n
    want = {}
    for i, t, _ in texts:
        g = grams(t)
        words, _, _, _, repeated = brute_quality(t)
        failed = words < 20 or 100 * repeated > 30 * words
        score = sum(ratio[b] for b in g) / (len(g) + PRIOR)
        want[i, words] = (failed, not failed and score >= mean - SLACK, score)
    got = QUERIES["op10_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    for x in got:
        failed, kept, score = want[x.doc_id, x.n_words]
        assert x.base_failed == failed and x.score == pytest.approx(score)
        assert x.kept == kept or abs(score - (mean - SLACK)) < 1e-9


def test_labelled_documents(spark):
    """Of all labelled documents of a table the trusted ones stay, and more of the others go."""
    d = "/root/testdata/sf0.01"
    judged = QUERIES["op10_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    print("kept of labelled documents by quality", share)
    assert share[1] > 0.95 and share[0] < share[1]
