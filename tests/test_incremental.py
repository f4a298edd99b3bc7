"""Recomputed scores, spans through folding, pages behind a cursor, and boxes in a grid."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchengine.functions import text as T
from matchengine.operators import annotations, backfill, pairs, skills
from matchengine.sources import files
from tests.test_golden import each


def test_provisional_scores_do_not_replace_complete_ones(spark):
    schema = "cv_id int, job_id int, cv_hash string, job_hash string, score double, provisional boolean"
    old = spark.createDataFrame([(1, 1, "a", "x", 90.0, False), (2, 1, "b", "x", 80.0, False), (3, 1, "c", "x", 0.3, True), (4, 1, "d", "x", 70.0, False), (6, 1, None, "x", 60.0, False)], schema)
    new = spark.createDataFrame([(1, 1, "a", "x", 0.9, True), (2, 1, "B", "x", 0.8, True), (3, 1, "c", "x", 75.0, False), (5, 1, "e", "x", 0.5, True), (6, 1, None, "x", 0.1, True)], schema)
    got = {r.cv_id: (r.cv_hash, r.score, r.provisional) for r in pairs.merged(old, new).collect()}
    assert got == {1: ("a", 90.0, False), 2: ("B", 0.8, True), 3: ("c", 75.0, False), 4: ("d", 70.0, False), 5: ("e", 0.5, True), 6: (None, 60.0, False)}
    assert {tuple(r) for r in pairs.merged(pairs.merged(old, new), new).collect()} == {tuple(r) for r in pairs.merged(old, new).collect()}


def test_spans_are_places_in_the_text(spark):
    aliases = [(0, "ETL", "etl"), (0, "Data", "data science"), (0, "Fi", "fin"), (0, "Go", "go"), (0, "C++", "c++"), (0, "Été", "été")]
    known = skills.compiled(skills.layered(spark.createDataFrame(aliases, "layer int, canonical string, alias string")))
    texts = ["Jean Dupont\nDATA  Sciénce et ﬁn, É.T.L? etl (C++)", "½ go, ÉTÉ́ en Master", None, "", "2 ans, Ingénieur a@b.fr", "ﬁﬁn ﬁn"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = annotations.annotated(d, known).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in rows)
    assert {(r.doc_id, r.label, r.value) for r in rows if r.label in ("SKILL", "DEGREE", "PERSON_CANDIDATE")} == {
        (0, "PERSON_CANDIDATE", "Jean Dupont"), (0, "SKILL", "DATA  Sciénce"), (0, "SKILL", "ﬁn"), (0, "SKILL", "etl"), (0, "SKILL", "C++"), (1, "SKILL", "go"), (1, "SKILL", "ÉTÉ"),
        (1, "DEGREE", "Master"), (4, "DEGREE", "Ingénieur"), (5, "SKILL", "ﬁn"),
    }
    for i in {r.doc_id for r in rows}:
        own = sorted((r.start, r.end) for r in rows if r.doc_id == i)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_folding_with_places_is_the_column_functions(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["ﬁ½ É́ 日本 ⅷ", ""]
    got = [annotations.fold_with_places(t) for t in docs]
    assert [g[0] for g in got] == each(spark, T.fold, docs)
    for t, (folded, place) in zip(docs, got, strict=True):
        assert len(place) == len(folded)
        assert all(c in unicodedata.normalize("NFKD", t[p]).lower() for c, p in zip(folded[:300], place[:300], strict=True))


def test_an_interrupted_backfill_ends_with_the_same_rows(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"k{r.randrange(20):02}", i, float(i)) for i in range(237)]
    d = spark.createDataFrame(rows, "key string, id long, x double").repartition(4)
    work = lambda page: page.withColumn("y", F.col("x") * 2)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    assert backfill.backfill(d, whole, ["key", "id"], work, 50) == 5
    assert backfill.backfill(d, broken, ["key", "id"], work, 50, pages=2) == 2

    calls = []

    def fails(page):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return work(page)

    with pytest.raises(RuntimeError):
        backfill.backfill(d, broken, ["key", "id"], fails, 50)
    torn = tmp_path / "broken" / "page=3"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"torn")  # a page without its mark of success
    backfill.backfill(d, broken, ["key", "id"], work, 50)
    want = sorted((*t, t[2] * 2) for t in rows)
    assert sorted(map(tuple, backfill.filled(spark, whole).collect())) == want == sorted(map(tuple, backfill.filled(spark, broken).collect()))
    pages = [sorted((q.key, q.id) for q in spark.read.parquet(f"{broken}/page={n}").collect()) for n in range(5)]
    assert sum(pages, []) == sorted((k, i) for k, i, _ in rows)


@pytest.mark.parametrize("cell", [100.0, 7.5, 5000.0])
def test_boxes_in_a_grid(spark, cell):
    r = random.Random(3)
    box = lambda: (x := r.uniform(-50, 500), x + r.uniform(0, 300), y := r.uniform(-50, 700), y + r.uniform(0, 200))
    lines = [(i, i % 3, i % 4, *box()) for i in range(300)] + [(900, None, 1, 1.0, 2.0, 1.0, 2.0), (901, 1, 1, None, 2.0, 1.0, 2.0)]
    boxes = [(r.randrange(3), r.randrange(4), *box()) for _ in range(25)] + [(1, 1, 50.0, 10.0, 0.0, 5.0)]
    l = spark.createDataFrame(lines, "id int, doc_id int, page int, x0 double, x1 double, y0 double, y1 double")  # noqa: E741
    b = spark.createDataFrame(boxes, "doc_id int, page int, x0 double, x1 double, y0 double, y1 double")
    inside = lambda t: None not in t and any(t[1:3] == q[:2] and q[2] <= (t[3] + t[4]) / 2 <= q[3] and q[4] <= (t[5] + t[6]) / 2 <= q[5] for q in boxes)
    assert {x.id for x in files.outside_tables(l, b, cell).collect()} == {t[0] for t in lines if not inside(t)}
