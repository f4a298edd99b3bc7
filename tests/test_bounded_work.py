"""Work that must not grow with a batch's, a text's or a set's size squared."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchengine.functions import text
from matchengine.functions.batches import small
from matchengine.operators import cells, skills


def test_small_parts_of_a_batch():
    b = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["x" * 1000] * 1000})
    parts = list(small([b, b.slice(0, 0)], 10_000))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([b])
    assert len(parts) >= 100 and max(p.num_rows for p in parts) <= 10
    assert [p.num_rows for p in small([b], 10)] == [1] * 1000


def test_a_walk_sends_small_batches(spark, monkeypatch):
    """What is found in a batch of many rows leaves the worker in parts."""
    sizes = []
    known = skills.compiled(spark.createDataFrame([("a", "A"), ("b", "B")], "alias string, canonical string"))
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "_t0": ["a b " * 500] * 3000})

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, _t0 string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            sizes.extend(p.num_rows for p in run(iter([rows])))

    monkeypatch.setattr(skills, "_joined", lambda docs, texts: Rows())
    skills._walked(None, known.sent, "doc_id", ("text",))
    assert sum(sizes) == 6000 and max(sizes) < 3000


def test_clean_lines_of_a_long_text(spark):
    lines = [f"{i} Une ligne accentuée assez longue" for i in range(4000)]
    odd = ["x", "• Point", "Point", "-", "Point", " a \t b ", "cut-", "ting", "■n", "中文", "", "中文字"]
    twice = ["The same line of over twenty", "other", "the same LINE of over twenty", "another", "The same line of over twenty"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, "\r\n".join(odd)), (3, "\n".join(twice)), (4, None), (5, "")], "id int, text string")
    at = time.time()
    got = {r.id: r.out for r in d.select("id", text.clean_lines("text").alias("out")).collect()}
    assert time.time() - at < 20
    assert got == {1: lines, 2: ["Point", "Point", "a b", "cutting", "fin", "中文"], 3: twice[:4], 4: None, 5: []}


def test_a_whitelist_sends_no_words(spark):
    docs = spark.createDataFrame([(1, "some pithon code and java"), (2, "nothing here")], "doc_id long, text string")
    aliases = spark.createDataFrame([("java", "Java")], "alias string, canonical string")
    out = skills.with_whitelist(docs, skills.find_skills(docs, aliases), aliases, ["Python", "Java"])
    assert sorted((r.doc_id, r.canonical) for r in out.collect()) == [(1, "Java"), (1, "Python")]
    assert "word#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_best_matches_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(cells, "HELD", 80)
    monkeypatch.setattr(cells, "COLUMNS", 3)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 4))
    rows = spark.createDataFrame([(i % 3, i, x.tolist()) for i, x in enumerate(v)], "set int, item long, vec array<double>")
    sets = cells.vector_sets(rows, "set", "item", "vec", 4)
    got = {(r.a, r.item, r.b): r.similarity for r in cells.best_matches(spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "a int, b int"), sets, sets).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, i, b): max(float(u[i] @ u[j]) for j in range(90) if j % 3 == b) for a, b in ((0, 1), (0, 2), (1, 1)) for i in range(90) if i % 3 == a}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_matches_send_a_set_a_few_times(spark):
    """Rows that meet in tiles: a few for each row of the sets, not one for each pair of them."""
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("set"), F.col("id").alias("item"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    sets = cells.vector_sets(rows, "set", "item", "vec", 10)
    n = sets.count()
    tiles = spark.createDataFrame([(0, 1)], "a int, b int")
    seen = []
    monkey = type(tiles).mapInArrow
    try:
        type(tiles).mapInArrow = lambda self, run, schema, **k: (seen.append(self.count()), monkey(self, run, schema, **k))[1]
        cells.best_matches(tiles, sets, sets)
    finally:
        type(tiles).mapInArrow = monkey
    assert seen and seen[0] <= (cells.COLUMNS + 1) * n


def test_forms_of_a_line_are_computed_once(spark):
    from matchengine.operators import profile, sections

    d = spark.createDataFrame([("a. b", 1.0, 2)], "t string, s double, y int")
    plan = lambda c: d.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(sections.section_of(F.col("t"))).count(r"\(.*?\)") == 1
    words = F.split("t", " ")
    assert plan(profile.explanation(words, words, F.col("s"), F.col("y"), F.col("y"), F.col("t"))).count("•") == 1
