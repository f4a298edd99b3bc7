"""Vectors: means, hybrid search and label lookup; cells.py has the searches themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.operators import cells


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean_vectors(rows: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(key, vector): element-wise means of vectors of the right length, brought to length one."""
    rows = rows.filter(F.size(vector) == size) if size else rows
    parts = rows.select(key, F.posexplode(vector).alias("_p", "_x")).groupBy(key, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("_v"))
    length = norm(F.col("_v"))
    return whole.select(key, F.when(length > 0, F.transform("_v", lambda x: x / length)).otherwise(F.col("_v")).alias(vector))


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest by cosine in all of the corpus, ties by id; see cells.exact()."""
    return cells.exact(queries, corpus, k, id_, vector, itself)


def with_documents(hits: DataFrame, docs: DataFrame, id_: str = "id", doc_id: str = "doc_id") -> DataFrame:
    """Hits with their documents' columns; those without a document are gone."""
    return hits.join(docs, hits[id_] == docs[doc_id]).drop(docs[doc_id])


def lexical_share(asked: Column, words: Column) -> Column:
    """How many of a hundred of the query's different words a document has; 0 of a query without words."""
    return F.when(F.size(asked) > 0, 100.0 * F.size(F.array_intersect(asked, words)) / F.size(asked)).otherwise(0.0)


def search(hits: DataFrame, lexical: Column, wv: float = 0.3, wl: float = 0.7, min_score: float | None = None) -> DataFrame:
    """Hybrid scores of hits in vector order; min_score filters after the top-k, as it was ranked by distance."""
    from matchengine.functions.scoring import hybrid_score, vector_score

    out = hits.withColumn("vector_score", vector_score(1 - F.col("score"))).withColumn("lexical_score", lexical)
    out = out.withColumn("hybrid_score", hybrid_score(F.col("vector_score"), F.col("lexical_score"), wv, wl))
    return out.filter(F.col("hybrid_score") >= min_score) if min_score is not None else out


def shortlist(ranked: DataFrame, k: int) -> DataFrame:
    """stage 'full' for the first k of each query, 'vector' for the rest."""
    return ranked.withColumn("stage", F.when(F.col("rank") <= k, "full").otherwise("vector"))


def label_lookup(terms: DataFrame, labels: DataFrame, hits: DataFrame, k: int = 5, least: float = 0.55) -> DataFrame:
    """(term, uri, score, rank): an exact label, lower-cased, scores 1; else the nearest labels; one row a uri."""
    exact = terms.join(labels.select(F.lower("label").alias("_l"), "uri"), F.lower("term") == F.col("_l")).select("term", "uri", F.lit(1.0).alias("score"))
    near = hits.filter(F.col("score") >= least).select("term", "uri", "score").join(exact.select("term").distinct(), "term", "left_anti")
    one = exact.unionByName(near).groupBy("term", "uri").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), "uri"))).filter(F.col("rank") <= k)
