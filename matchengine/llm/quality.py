"""Quality rules: rule counts, and hashed n-gram log-likelihood ratio of a trusted and the raw corpus.

Only DataFrame functions: every count comes from arrays of 64-bit word hashes within a row, so no text is
shuffled and no group of rows meets in one task.

Defined cases: a null or blank text has no words and fails the base rules; labels without a trusted document make
every ratio zero, so that the base rules alone decide; repeated rows are judged alike; columns besides the text and
the id are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def word_array(text: Column) -> Column:
    """Words between ASCII white space; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def _pairs(h: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` further on. ``h`` is named twice, so its value is not computed anew."""
    short = F.slice(h, 1, F.greatest(F.size(h) - gap, F.lit(0)))
    return F.transform(short, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _w (words), _h1 (word hashes) and _h2 (hashes of two words each)."""
    return (
        docs.withColumn("_w", word_array(F.col(text)))
        .withColumn("_h1", F.when(F.size("_w") > 0, F.transform("_w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_h2", _pairs(F.col("_h1"), 1))
    )


@dataclass(frozen=True)
class Model:
    """ratio: a log ratio for each bucket; mean: the trusted corpus's mean over its grams; slack, prior: see fit()."""

    ratio: list[float]
    mean: float
    slack: float
    prior: float


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = 16384, alpha: float = 50.0, slack: float = 0.09, prior: float = 20.0) -> Model:
    """Multinomials over hashed words and word pairs of all ``docs`` and of those that ``labels`` trusts (quality 1).

    alpha: counts added on either side, the trusted ones brought to the raw corpus's size first: rare grams say little.
    The driver gets ``buckets`` numbers, whatever the corpus's size. slack: how far, in nats a gram, a document may lie
    below the trusted mean. prior: grams of ratio zero added to each document, so that few words can't condemn.
    """
    trusted = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_id"), "left").withColumn("_t", F.col("_id").isNotNull().cast("long"))
    grams = hashed(marked).select("_t", F.explode(F.concat("_h1", "_h2")).alias("_g"))
    counts = grams.groupBy(F.pmod("_g", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("_t").alias("good"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    total = every.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "good", "raw"))).alias("c"), F.sum("good").alias("t"), F.sum("raw").alias("r")
    )
    ratio = total.select(
        F.when(
            F.col("t") > 0,
            F.transform("c", lambda x: F.log((x["good"] * F.col("r") / F.col("t") + alpha) / (x["raw"] + alpha))),
        ).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("ratio"),
        "c",
        F.greatest("t", F.lit(1)).alias("t"),
    ).select("ratio", (F.aggregate(F.arrays_zip("c", "ratio"), F.lit(0.0), lambda a, x: a + x["c"]["good"] * x["ratio"]) / F.col("t")).alias("mean"))
    row = ratio.first()
    return Model(list(row["ratio"]), float(row["mean"]), slack, prior)


def _windows(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words within windows of eight words that the text has twice or more."""
    out = docs.withColumn("_h4", _pairs(F.col("_h2"), 2)).withColumn("_h8", _pairs(F.col("_h4"), 4)).drop("_h4")
    out = out.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h8")) < F.size("_h8"),
            F.sort_array(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    ).drop("_h8")
    same = lambda x, i: F.coalesce(x["h"] == F.get("_s", i)["h"], F.lit(False))
    out = out.withColumn(
        "_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))
    ).drop("_s")
    width = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))).drop("_p")


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept to every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.drop(*[c for c in docs.columns if c in RESULTS])
    out = out.withColumn("_lines", lines).withColumn("word_chars", F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    out = hashed(out, text).withColumn("n_words", F.size("_w").cast("long")).drop("_w")
    table = F.split(F.lit(",".join(map(repr, model.ratio))), ",").cast("array<double>")  # folded to a constant
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(table, F.pmod(x, F.lit(len(model.ratio))).cast("int")))
    out = out.withColumn("score", (total(F.col("_h1")) + total(F.col("_h2"))) / (F.size("_h1") + F.size("_h2") + F.lit(model.prior)))
    out = _windows(out).drop("_h1", "_h2")
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    verdict = ~F.col("base_failed") & (F.col("score") >= F.lit(model.mean - model.slack))
    # a row's number is never under 0: it keeps a filter on the result from moving below, where the optimizer would put the
    # arrays' definitions in the place of their names, and have them computed anew for every element
    return out.withColumn("kept", verdict & (F.monotonically_increasing_id() >= 0))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
