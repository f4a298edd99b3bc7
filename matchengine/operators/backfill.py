"""Work over a large table in pages behind a cursor, which an interrupted run takes up where its output ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pages(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the pages that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(root):
        return []
    done = [s.getPath().getName() for s in store.listStatus(root) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("page=")) for n in done if n.startswith("page="))


def cursor(spark: SparkSession, path: str, keys: list[str]) -> tuple[tuple | None, int]:
    """(the last keys that the output has, number of the next page)."""
    done = _pages(spark, path)
    if not done:
        return None, 0
    last = spark.read.parquet(*[f"{path}/page={n}" for n in done]).agg(F.max(F.struct(*keys)).alias("k")).first().k
    return (None if last is None else tuple(last)), done[-1] + 1


def backfill(rows: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], size: int, pages: int | None = None) -> int:
    """Writes work(page) of all rows in order of ``keys``, which are unique and not null, ``size`` a page, below ``path``;
    the number of pages written. ``work`` keeps the keys and gives a row for each of the page's.

    The state is the output: the next page holds the smallest keys behind the largest of all whole pages, so rows that come
    or go in between shift no page, as an offset's would. A page that was broken off has no mark of success and is written
    again. ``pages`` stops after so many."""
    spark, written = rows.sparkSession, 0
    while pages is None or written < pages:
        at, number = cursor(spark, path, keys)
        here = rows if at is None else rows.filter(F.struct(*keys) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, at, strict=True)]))
        page = here.orderBy(*keys).limit(size)
        out = f"{path}/page={number}"
        work(page).write.mode("overwrite").parquet(out)
        written += 1
        if spark.read.parquet(out).limit(size).count() < size:
            return written
    return written


def filled(spark: SparkSession, path: str) -> DataFrame:
    """What the whole pages hold."""
    return spark.read.parquet(*[f"{path}/page={n}" for n in _pages(spark, path)])
