"""Columns of documents that are named as helper columns or results come back as they are from every stage."""

from collections import Counter

import pytest

import corpus_pipeline
from matchengine.llm import mixing, near_copies, simhash, substring_dedup, suffix_dedup

NAMES = [
    "row", "spans", "blocks", "passes", "score", "kept", "node", "group", "id", "hi", "lo", "fp", "rep", "component", "tag", "size", "nb", "key", "shard", "quota", "position", "taken", "target", "occurrence", "tie", "block",
    "base_failed", "n_words", "c0", "c1", "_d", "_g", "_fd", "_fg", "_t", "_n", "_id", "_tie", "_shard", "_at", "_o", "_words", "_copy", "_piece", "_w", "_h1", "_row", "_doc", "_tag", "kmer", "bands",
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40).collect()
    rows = [(*r, *(f"{n} of {r.doc_id}" for n in NAMES)) for r in base]
    rows += [(9000, base[3].text, "en", "src1", base[3].n_chars, *("copy" for _ in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def held(df):
    return Counter((r.doc_id, r.text, *(r[n] for n in NAMES)) for r in df.collect())


def plain(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


STAGES = {
    "quality": lambda d: corpus_pipeline.keep_quality(d.sparkSession, d, "/root/testdata/sf0.001"),
    "near copies": near_copies.deduplicated,
    "simhash": simhash.deduplicated,
    "suffix": suffix_dedup.deduplicated,
    "substring": substring_dedup.deduplicated,
    "mixing": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", STAGES)
def test_stage(docs, name):
    got = STAGES[name](docs)
    assert got.columns == docs.columns
    assert plain(got) == plain(STAGES[name](docs.select("doc_id", "text", "lang", "source", "n_chars")))
    own = {r.doc_id: tuple(r[n] for n in NAMES) for r in docs.collect()}
    assert all(row[2:] == own[row[0]] for row in held(got))
