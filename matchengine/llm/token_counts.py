"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Workers encode whole texts and send only (length, documents) pairs, so what is shuffled does not grow with the text.
The suffix sums run in blocks of lengths: sums within a block, then over the short list of blocks.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives an empty
histogram; a very long text is encoded on its own; columns besides the text are not looked at.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.store import materialise

BLOCK = 1024
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """A tiktoken encoding of a file of ranks, once a worker process."""
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): one row for each length that occurs."""

    def count(batches):
        from collections import Counter

        encode = encoding(path, pattern).encode_ordinary
        for b in batches:
            seen = Counter(len(encode(t or "")) for t in b.column(0).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    part = docs.select(text).mapInArrow(count, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds, for each length L: docs_from and tokens_from (of documents of L tokens or more), truncated_total (tokens left
    if all are cut to L) and quantile (share of documents of at most L tokens)."""
    h = hist.withColumn("_b", F.floor(F.col("n_tokens") / block)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    within = Window.partitionBy("_b").orderBy(F.col("n_tokens").desc())
    h = h.withColumn("_d0", F.sum("n_docs").over(within)).withColumn("_t0", F.sum("_t").over(within))
    above = Window.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a block of lengths
    zero = F.lit(0).cast("long")
    blocks = h.groupBy(F.col("_b").alias("_k")).agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    blocks = blocks.select(
        "_k",
        F.coalesce(F.sum("_bd").over(above), zero).alias("_d1"),
        F.coalesce(F.sum("_bt").over(above), zero).alias("_t1"),
        F.sum("_bd").over(Window.partitionBy()).alias("_docs"),
        F.sum("_bt").over(Window.partitionBy()).alias("_tokens"),
    )
    out = h.join(blocks, h["_b"] == blocks["_k"]).withColumn("docs_from", F.col("_d0") + F.col("_d1")).withColumn("tokens_from", F.col("_t0") + F.col("_t1"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) of rows of suffix_sums() (or of a histogram), for any limits, between lengths too.

    The longest length within a limit and the shortest beyond it have all that is asked for: shorter documents are whole
    (all tokens less those from the next length on), and each of the next length's docs_from is cut to the limit."""
    sums = sums if "docs_from" in sums.columns else suffix_sums(sums)
    all_tokens = F.max(F.col("truncated_total") - F.col("n_tokens") * F.col("docs_from") + F.col("tokens_from"))
    answers = []
    for i, x in enumerate(limits):
        beyond = F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_from", "tokens_from")))
        zero = F.lit(0).cast("long")
        cut = F.coalesce(beyond["docs_from"], zero)
        total = F.coalesce(all_tokens, zero) - F.coalesce(beyond["tokens_from"], zero) + x * cut
        answers.append(F.struct(F.lit(x).cast("long").alias("context_limit"), total.alias("truncated_total"), cut.alias("docs_cut")).alias(f"_{i}"))
    return sums.agg(*answers).select(F.inline(F.array(*[f"_{i}" for i in range(len(limits))])))


def at_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least a share of all documents does not exceed; null of no documents."""
    answers = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")).alias(f"_{i}") for i, q in enumerate(shares)]
    return sums.agg(*answers).select(F.inline(F.array(*[f"_{i}" for i in range(len(shares))])))


def op1_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Histogram and suffix sums of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = histogram(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return suffix_sums(materialise(counted, "lengths"))  # written, for the sums read it twice: a row a length, no text is encoded again
