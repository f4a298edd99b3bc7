import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kmer string, target string"
ODD = [
    (900001, None, None, None), (900002, "", "en", "web"), (900003, " \t\n ", "en", "web"), (900004, "one", "en", None), (900005, "Two  words", None, "zoo"),
    (900006, "été \U0001f600 " * 400, "fr", "zoo"), (900007, "a b c d e f g h i j " * 300, "en", "zoo"), (900008, "x" * 50_000, "en", "zoo"), (900009, "same text " * 40, "en", "web"),
    (900009, "same text " * 40, "en", "web"), (900010, "same text " * 40, "en", "web"), (900011, "[UNK] <s> </s> [PAD] <|endoftext|>", "en", "web"),
]


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of small tables: real rows, odd ones, and columns whose names clash with those of results."""
    d = str(tmp_path_factory.mktemp("sf"))
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    every = [(i, t, a, s, None if t is None else len(t), 7, "k", "t") for i, t, a, s in rows + ODD]
    spark.createDataFrame(every, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def texts(spark, sf):
    """(doc_id, text, source) of every row."""
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d
