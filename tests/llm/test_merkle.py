"""The Merkle manifest against a plain tree over real and odd rows, at several block sizes."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchengine.llm import merkle
from matchengine.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf string, pos long, many long, tree string, hash string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return h(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))


def tree(nodes):
    """Levels from the nodes up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(levels, i):
    for level in levels[:-1]:
        j = i ^ 1
        yield (level[j] if j < len(level) else ""), i % 2
        i //= 2


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda a: (a is not None, (a or "").encode()))
    own = {a: sorted((r for r in rows if r.lang == a), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for a in langs}
    trees = {a: tree([leaf(r) for r in own[a]]) for a in langs}
    top = tree([trees[a][-1][0] for a in langs]) if langs else []
    out = Counter()
    for k, a in enumerate(langs):
        for i, r in enumerate(own[a]):
            way = [*steps(trees[a], i), *steps(top, k)]
            bad = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, int(bad))
            for s, left in way:
                node = h(s, node) if left else h(node, s)
            out[r.doc_id, leaf(r), trees[a][-1][0], top[-1][0], h(*(s for s, _ in way)), node, node == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("bits", [10, 1, 3])
def test_whole_table(spark, sf, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    want = brute(spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = Counter(tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf).collect())
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a", None, None, None), (None, None, "en", "x", 1), (7, "b", "", "", 2), (7, "b", "", "", 2), (7, "c", "", "", None), (-5, "", "é", "x", 0), (9, "z" * 200_000, "en", "x", 1)]
    rows += [(i, "same", "en", "x", 4) for i in (100, 100, 100)]
    spark.createDataFrame([(*r, *"abcdefg") for r in rows], DOCS.replace("pos long, many long", "pos string, many string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert Counter(tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()) == want


def test_one_document_and_one_language(spark, tmp_path):
    for n in (1, 2, 3):
        d = f"{tmp_path}/{n}"
        spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
        want = brute(spark.read.parquet(f"{d}/documents.parquet").collect())
        assert Counter(tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, d).collect()) == want


def test_clashing_columns_come_back(spark):
    names = ["doc_id", "lang", "leaf", "pos", "many", "tree", "hash", "part", "c0"]
    d = spark.createDataFrame([(i, "en" if i % 3 else None, h(str(i)), *"abcdef") for i in range(40)], "doc_id long, lang string, leaf string, pos string, many string, tree string, hash string, part string, c0 string")
    got = merkle.manifest(d, "lang", ["doc_id"])
    assert got.columns == [*names, "subroot", "root", "path"]
    assert Counter(got.select(*names).collect()) == Counter(d.collect())


def test_a_later_reading_is_verified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    found = merkle.manifest(docs.select("doc_id", "lang", merkle.leaf().alias("leaf")), "lang", ["doc_id"])
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))).select("doc_id", merkle.leaf().alias("leaf"))
    new = spark.createDataFrame([(10**9, h("new"))], "doc_id long, leaf string")
    got = {r.doc_id: r.verified for r in merkle.verified(found, changed.unionByName(new), "doc_id").collect()}
    assert {i for i, ok in got.items() if not ok} == {3, 10**9}
