"""Event streams: debouncing, rate windows, routing, retries and idempotent upserts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchengine.operators.merge import latest, upsert


def leading(events: DataFrame, keys: list[str], gap_s: float, ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """The batch form of the leading edge: an event passes if ``gap_s`` has gone by since the last that passed; what is
    held back does not start the time anew. Null keys are keys of their own; ties of time go by id.

    Each task walks its rows in order of key and time, batch by batch, and carries one time, so that a key of any number of
    events takes no more memory than one batch."""
    gap = int(gap_s * 1_000_000)
    rows = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(id_).alias("_i"))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.toDF(*names, "_t", "_i")
    schema = rows.select(*names, "_i").schema

    def run(batches):
        before, last = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(len(keys)).to_numpy()
            change = np.zeros(b.num_rows, bool)
            for k in range(len(keys)):
                code = pc.fill_null(b.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            one = lambda i, b=b: tuple(b.column(k)[i].as_py() for k in range(len(keys)))
            change[0] = before is None or one(0) != before
            starts = np.flatnonzero(change) if change[0] else np.append(0, np.flatnonzero(change))
            passed = []
            for s, e in zip(starts.tolist(), np.append(starts[1:], b.num_rows).tolist(), strict=True):
                at = s
                if not change[s]:  # the key goes on from the batch before
                    at = s + int(np.searchsorted(t[s:e], last + gap))
                while at < e:
                    last = int(t[at])
                    passed.append(at)
                    at += max(1, int(np.searchsorted(t[at:e], last + gap)))
            before = one(b.num_rows - 1)
            yield b.select([*names, "_i"]).take(pa.array(passed, pa.int64()))

    walked = rows.repartition(*names).sortWithinPartitions(*names, "_t", "_i").mapInArrow(run, schema)
    return walked.toDF(*keys, id_)


def leading_stream(events: DataFrame, keys: list[str], gap_s: float, ts: str = "ts", id_: str = "event_id", late: str = "0 seconds") -> DataFrame:
    """The streaming form: a state of one time a key, which is forgotten once the watermark, ``late`` behind the newest
    event, has passed it by the gap; rows of a batch in order of time."""
    import pandas as pd

    schema = events.select(*keys, id_).schema
    gap = int(gap_s * 1_000_000)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([ts, id_])
        last = state.get[0] if state.exists else None
        out = []
        for t, i in zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[id_], strict=True):
            if last is None or t - last >= gap:
                last = t
                out.append((*key, i))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, id_])

    marked = events.withWatermark(ts, late)
    return marked.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", "EventTimeTimeout")


def trailing(events: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """One row a burst: events no further apart than the gap. For streams, put a watermark on ``ts`` before."""
    s = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(*keys, s.alias("w")).agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def rate_limited(requests: DataFrame, who: str, limit: int, window_s: int, ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Adds ``allowed``: among the first ``limit`` of its fixed window."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (window_s * 1_000_000))
    w = Window.partitionBy(who, "_w").orderBy(ts, id_)
    return requests.withColumn("_w", slot).withColumn("allowed", F.row_number().over(w) <= limit).drop("_w")


def rate_counts(requests: DataFrame, who: str, window: str, ts: str = "ts") -> DataFrame:
    """Requests of each identity in each fixed window; fit for streams with a watermark."""
    return requests.groupBy(who, F.window(F.col(ts).cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), "n")


def route(event_type: Column, path: Column, exists: Column) -> Column:
    """What an event leads to."""
    known = F.lower(path).rlike(r"\.(pdf|docx|txt)$")
    return F.when(~exists | (event_type == "deleted"), "cleanup").when(~known, "skip").when(event_type.isin("structure", "rescore"), event_type).otherwise("process")


def attempts(base: float = 0.5, most: float = 10.0, retries: int = 3) -> list[float]:
    """Waits before each further attempt."""
    return [min(base * 2**i, most) for i in range(retries)]


def with_dead_letters(work, retries: int = 3, sleep=lambda s: None):
    """A foreachBatch function: ``work(df, id)`` with retries; a batch that still fails goes to dead(df, id, error)."""

    def run(df: DataFrame, batch: int, dead=None):
        for i, wait in enumerate([0.0, *attempts(retries=retries)]):
            sleep(wait)
            try:
                return work(df, batch)
            except Exception as e:
                if i == retries:
                    if dead is None:
                        raise
                    return dead(df, batch, e)

    return run


def upsert_batches(path: str, keys: list[str], keep_if_null: tuple[str, ...] = (), order: str | None = None, buckets: int = 64):
    """A foreachBatch function that merges the latest() rows of each batch, by ``order``, into the table below ``path``,
    which upserted() reads.

    The table is dealt to ``buckets`` by its keys. A batch reads and writes those alone that its rows fall into, in a folder
    of its own, and then a pointer table of the batch that says for each bucket in which batch's folder it lies; the others'
    files stay as they are. Readers follow a whole pointer table, so they see all of a batch or nothing. A batch that is run
    again starts from the pointers before it and writes the same folders again."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        dealt = latest(df, keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        dealt = dealt.persist()  # a stream's batch is not read twice
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # ``buckets`` at most
        held = _pointers(spark, path, batch)
        old = _read(spark, path, {b: v for b, v in held.items() if b in touched}, df.schema)
        new = upsert(old, dealt.drop("_bucket"), keys, keep_if_null).select(*df.columns)
        new = new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/data/v={batch}")
        rows = sorted((held | dict.fromkeys(touched, batch)).items())
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/batch={batch}")
        dealt.unpersist()

    return run


def _pointers(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket after the last whole batch, or after the last one before a batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(folder):
        return {}
    names = [s.getPath().getName() for s in store.listStatus(folder) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if before is None or n < before]
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/pointers/batch={max(done)}").collect()} if done else {}


def _read(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/v={v}/_bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upserted(spark: SparkSession, path: str, schema, batch: int | None = None) -> DataFrame:
    """The table that upsert_batches() keeps, as it is now or was after ``batch``."""
    return _read(spark, path, _pointers(spark, path, None if batch is None else batch + 1), schema)
