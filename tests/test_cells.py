"""Vector search in cells and best matches of vector sets against numpy."""

import numpy as np
import pytest

from matchengine.operators import cells

SCHEMA = "vec_id long, embedding array<float>"


def clustered(rng, many, groups=30, size=16):
    centres = rng.normal(size=(groups, size))
    return centres[rng.integers(0, groups, many)] + 0.35 * rng.normal(size=(many, size))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(3)


def nearest(x, asked, k):
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    return {(q, int(i)) for q, row in zip(asked, s, strict=True) for i in np.argsort(-row, kind="stable")[:k]}


@pytest.mark.parametrize("queries, products", [(1024, 1 << 22), (3, 1), (8, 1 << 12)])
def test_exact_in_tiles(spark, monkeypatch, queries, products):
    monkeypatch.setattr(cells, "QUERIES", queries)
    monkeypatch.setattr(cells, "PRODUCTS", products)
    x = clustered(np.random.default_rng(0), 700)
    e = frame(spark, x)
    got = {(r.query_id, r.id) for r in cells.exact(e.filter("vec_id % 20 = 0"), e, 10).collect()}
    assert got == nearest(x, list(range(0, 700, 20)), 10)


def test_index_recall_and_pruning(spark, tmp_path):
    x = clustered(np.random.default_rng(1), 6000)
    e = frame(spark, x)
    c = cells.fit(e, sample=2000)
    assert len(c.centres) == 77
    cells.build(e, c, str(tmp_path / "index"))
    index = cells.index(spark, str(tmp_path / "index"))
    assert index.count() == 6000
    asked = e.filter("vec_id % 100 = 0")
    probes = cells.probes_for(e, c, 10, 0.95)
    assert probes < len(c.centres) / 3
    found = cells.search(asked, index, c, 10, probes)
    truth = nearest(x, list(range(0, 6000, 100)), 10)
    hits = {(r.query_id, r.id) for r in found.collect()}
    share = len(hits & truth) / len(truth)
    print("recall of the exact ten", share)
    assert share >= 0.9 and len(hits) == len(truth)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    every = cells.search(asked, index, c, 10, probes=len(c.centres))
    assert {(r.query_id, r.id) for r in every.collect()} == truth
    r = cells.recall(found, cells.exact(asked, e, 10)).first()
    assert (r.queries, r.recall) == (60, pytest.approx(share))


def test_empty_and_odd_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, [0.0, 0.0]), (100, [1.0, 0.0]), (101, [2.0, 0.0]), (102, [0.0, 1.0])], SCHEMA)
    assert cells.exact(none, one, 3).count() == cells.exact(one, none, 3).count() == 0
    assert len(cells.fit(none).centres) == 1
    got = [(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in cells.exact(one.filter("vec_id = 100"), one, 5).orderBy("rank").collect()]
    assert got == [(100, 101, 1.0, 1), (100, 0, 0.0, 2), (100, 102, 0.0, 3)]


@pytest.mark.parametrize("most", [1000, 3])
def test_best_matches(spark, most):
    rng = np.random.default_rng(2)
    x = clustered(rng, 200)
    own = rng.integers(0, 12, 200)
    own[:60] = 3  # a set with a third of all
    rows = spark.createDataFrame([(int(s), f"k{i}", [float(v) for v in r]) for i, (s, r) in enumerate(zip(own, x, strict=True))], "set int, item string, vec array<float>")
    sets = cells.vector_sets(rows, "set", "item", "vec", most)
    pairs = [(a, b) for a in range(12) for b in range(12) if (a + b) % 3 == 0 or 3 in (a, b)]
    got = {(r.a, r.item, r.b): r.similarity for r in cells.best_matches(spark.createDataFrame(pairs + pairs[:5], "a int, b int"), sets, sets).collect()}
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(int(own[i]), f"k{i}", b): max(u[i] @ u[j] for j in np.flatnonzero(own == b)) for i in range(200) for a, b in pairs if own[i] == a and (own == b).any()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
