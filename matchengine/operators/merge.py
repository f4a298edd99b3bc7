"""Sinks over plain tables: upserts as full-outer rewrites, retention, purges and cascades, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the last by ``order``; among equal ones, or without an order, the one with the largest hash."""
    last = [F.col(order).desc_nulls_last()] if order else []
    w = Window.partitionBy(*keys).orderBy(*last, F.xxhash64(*rows.columns).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of the same key; columns of keep_if_null stay where the new row has none. Keys that are
    not unique pair up as in any join: bring ``new`` to its latest() rows first, whose partitioning serves the join."""
    o = old.withColumn("_o", F.lit(True)).alias("o")
    n = new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null else F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def changed_only(old: DataFrame, new: DataFrame, key: str, hash_: str = "content_hash") -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or whose hash differs, nulls compared as values."""
    o = old.select(key, F.col(hash_).alias("_h"), F.lit(True).alias("_o"))
    return new.join(o, key, "left").filter(F.col("_o").isNull() | ~F.col(hash_).eqNullSafe(F.col("_h"))).drop("_h", "_o")


def invalidated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Extraction upsert: the profile's hash is cleared when the content or the method changes."""
    o = old.select(key, F.col("content_hash").alias("_h"), F.col("method").alias("_m"), "profile_hash")
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("method").eqNullSafe(F.col("_m"))
    return new.join(o, key, "left").withColumn("profile_hash", F.when(same, F.col("profile_hash"))).drop("_h", "_m")


def retain(rows: DataFrame, as_of, days: int, ts: str = "created_at") -> DataFrame:
    """Rows not older than ``days``; nothing goes where days is not positive."""
    return rows if days <= 0 else rows.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def orphans(docs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind): documents without a file and files without a document."""
    a = docs.join(files.select(key), key, "left_anti").select(key, F.lit("document").alias("kind"))
    return a.unionByName(files.join(docs.select(key), key, "left_anti").select(key, F.lit("file").alias("kind")))


def cascade(gone: DataFrame, matches: DataFrame, feedback: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Matches and feedback that stay once the documents ``gone`` (id) are deleted."""
    stay = matches.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    return stay, feedback.join(stay.select(F.col("id").alias("match_id")), "match_id", "left_semi")


def csv_rows(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """Lists joined by "; ", at most ``most`` rows, the best first."""
    out = rows.orderBy(F.col("score").desc(), "id").limit(most)
    return out.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder with a byte order mark before the header's first name."""
    out = csv_rows(rows)
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
