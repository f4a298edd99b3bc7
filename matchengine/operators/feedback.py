"""Feedback analytics and the carry-forward of omitted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("accept", "reject", "review")


def by_decision(feedback: DataFrame) -> DataFrame:
    """Count, share in per cent and mean rating of each decision; null ratings do not count."""
    g = feedback.groupBy("decision").agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating"))
    return g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def mean_of_means(feedback: DataFrame) -> DataFrame:
    return by_decision(feedback).agg(F.avg("avg_rating").alias("rating"))


def component_means(rows: DataFrame, components: list[str]) -> DataFrame:
    return rows.groupBy("decision").agg(*[F.avg(c).alias(c) for c in components])


def domain_table(rows: DataFrame) -> DataFrame:
    """Per domain: total, a count for each decision, and the mean score of the accepted ones alone."""
    is_ = lambda d: F.col("decision") == d
    out = rows.filter("domain is not null").groupBy("domain")
    return out.agg(F.count("*").alias("total"), *[F.count(F.when(is_(d), 1)).alias(d) for d in DECISIONS], F.avg(F.when(is_("accept"), F.col("score"))).alias("avg_score"))


def weight_hints(rows: DataFrame, components: list[str]) -> DataFrame:
    """(component, delta): accepted mean less rejected mean of each component that has both."""
    means = rows.filter(F.col("decision").isin("accept", "reject")).agg(
        *[F.avg(F.when(F.col("decision") == d, F.col(c))).alias(f"{c}_{d}") for c in components for d in ("accept", "reject")]
    )
    pairs = ", ".join(f"'{c}', {c}_accept - {c}_reject" for c in components)
    return means.select(F.expr(f"stack({len(components)}, {pairs}) as (component, delta)")).filter("delta is not null")


def carried(feedback: DataFrame) -> DataFrame:
    """Each row with the match's last known rating (1 to 5) where its own is missing."""
    w = Window.partitionBy("match_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("rating").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.col("rating"))))
    return feedback.withColumn("rating", F.last(given, ignorenulls=True).over(w))
