"""Debouncing, bucketed upserts and folder events."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from matchengine.sources import folder_events
from matchengine.streaming import events as S
from tests.test_golden import _stream


def brute_leading(rows, gap):
    last, out = {}, set()
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or t - last[key] >= gap:
            last[key] = t
            out.add((*key, i))
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_leading_walks_over_batches(spark, batch):
    rng = random.Random(4)
    rows = [((rng.choice(["a", "b", None, ""]), rng.choice([1, None, 2])), rng.randrange(0, 4000), i) for i in range(900)] + [(("hot", 1), t % 500, 10_000 + t) for t in range(1500)]
    e = spark.createDataFrame([(*k, t, i) for k, t, i in rows], "k string, n int, s long, event_id long").select("k", "n", F.timestamp_seconds("s").alias("ts"), "event_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {tuple(r) for r in S.leading(e, ["k", "n"], 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_leading(rows, 60)


def test_a_stream_forgets_idle_keys(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1.7e9 + s)
    parts = [[(1, 1, at(0)), (2, 2, at(1))], [(3, 1, at(20)), (4, 3, at(5000))], [(5, 3, at(5001)), (6, 9, at(5100))], [(7, 1, at(9000))], [(8, 1, at(9001))]]
    stream = S.leading_stream(_stream(spark, tmp_path, parts, schema), ["user_id"], 50)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 6, 7]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 3  # users 2 and 3, long idle, are gone


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    schema, path = "id int, v string, w string", str(tmp_path / "t")
    run = S.upsert_batches(path, ["id"], keep_if_null=("w",), buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    run(frame([(i, "a", "w") for i in range(100)]), 3)
    first = files_of(path)
    run(frame([(7, "b", None), (500, "n", None)]), 5)
    second = files_of(path)
    assert first.items() <= second.items() and 1 <= len(second) - len(first) <= 2
    want = {(i, "b" if i == 7 else "a", "w") for i in range(100)} | {(500, "n", None)}
    assert {tuple(r) for r in S.upserted(spark, path, schema).collect()} == want
    assert S.upserted(spark, path, schema, 3).count() == 100
    run(frame([(7, "b", None), (500, "n", None)]), 5)  # run again after a failure
    assert {tuple(r) for r in S.upserted(spark, path, schema).collect()} == want
    assert first.items() <= files_of(path).items()
    run(frame([]), 6)
    assert S.upserted(spark, path, schema).count() == 101


def put(folder, name, text, at):
    p = folder / name
    p.write_text(text)
    os.utime(p, (at, at))


def test_folder_events_of_all_kinds_and_restart(spark, tmp_path):
    spark.dataSource.register(folder_events.FolderEvents)
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def once():
        q = folder_events.changes(spark, str(folder), str(state)).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
        q.awaitTermination()
        rows = spark.read.schema("event_type string, path string, old_path string, observed_at timestamp, size long").parquet(out).collect()
        return sorted((r.event_type, os.path.basename(r.path), r.old_path and os.path.basename(r.old_path)) for r in rows)

    put(folder, "a.txt", "one", 1000)
    put(folder, "b.TXT", "two", 1001)
    put(folder, "c.docx", "three", 1002)
    put(folder, "skip.tmp", "x", 1003)
    seen = [("created", "a.txt", None), ("created", "b.TXT", None), ("created", "c.docx", None)]
    assert once() == seen
    assert once() == seen  # nothing new, nothing again
    put(folder, "a.txt", "changed", 2000)
    (folder / "b.TXT").rename(folder / "moved.txt")
    (folder / "c.docx").unlink()
    put(folder, "new.pdf", "%PDF", 2001)
    seen = sorted([*seen, ("modified", "a.txt", None), ("moved", "moved.txt", "b.TXT"), ("deleted", "c.docx", None), ("created", "new.pdf", None)])
    assert once() == seen
    assert once() == seen
