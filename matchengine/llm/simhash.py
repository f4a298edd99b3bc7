"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints that differ in at most two bits agree in two of four 16-bit blocks at least, so six tables keyed by two
blocks find every link. A bucket's fingerprints lie as bit planes; one word operation advances 64 distances, which
carry-save counters hold as far as "more than two", and a block of 64 is abandoned once all are beyond. Of a bucket
only the links of a spanning forest leave the task. A bucket with very many different fingerprints is split by two
of four 8-bit blocks of what its key leaves open, which again loses no link; 65,536 is then the most it can hold.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; texts under three words are
one shingle; repeated rows fall together; an empty table gives no rows; texts of any length are hashed a
shingle at a time; deduplicated() gives other columns back as they are, whatever their names. Rows with a
null id are linked like any other, and a group of nothing else is kept as one row; rows that share an id but not the
text are separate rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.columns import renamed
from matchengine.llm.components import components
from matchengine.llm.store import materialise

RADIUS = 2
SEED = 42
CROWDED = 4096  # different fingerprints in a bucket, beyond which it is split
ITEMS = 1 << 18  # 64-wide comparisons held at a time


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each 1 if set in over half the shingles' hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    total = np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """[64, ceil(n / 64)]: word w of plane b has bit b of the fingerprints 64 w to 64 w + 63."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")  # n, 64
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(plane: np.ndarray, query: np.ndarray, row: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each item, the lanes of word ``row`` of the planes within ``radius`` (under 4) bits of ``query``."""
    assert radius == RADIUS
    alive = np.arange(len(query))
    out = np.zeros(len(query), np.uint64)
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    for b in range(64):
        x = plane[b, row[alive]] ^ (np.uint64(0) - ((query[alive] >> np.uint64(b)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            beyond = over | (ones & twos)
            keep = beyond != ~np.uint64(0)
            if b < 63 and not keep.all():
                alive, ones, twos, over = alive[keep], ones[keep], twos[keep], over[keep]
    out[alive] = ~(over | (ones & twos))
    return out


def forest(fps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The index of each fingerprint's root; those of a bucket (a run from each start) within RADIUS share one."""
    sizes = np.diff(np.append(starts, len(fps)))
    label = np.arange(len(fps))
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    for at in range(0, len(small), ITEMS // 64):
        part = small[at : at + ITEMS // 64]
        plane = np.concatenate([planes(fps[starts[i] : starts[i] + sizes[i]]) for i in part], axis=1)
        row = np.repeat(np.arange(len(part)), sizes[part])
        first = np.repeat(starts[part], sizes[part])
        me = first + (np.arange(len(row)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]))
        mask = within(plane, fps[me], row)
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits[np.arange(64)[None, :] >= np.repeat(sizes[part], sizes[part])[:, None]] = 0
        item, lane = np.nonzero(bits)
        a, b = me[item], first[item] + lane
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            if (label == before).all():
                break
    for i in np.flatnonzero(sizes > 64):
        own = np.arange(starts[i], starts[i] + sizes[i])
        plane = planes(fps[own])
        many = plane.shape[1]
        left, stay = np.ones(many * 64, bool), np.zeros(many * 64, bool)
        stay[: len(own)] = True
        left &= stay
        for seed in range(len(own)):
            if not left[seed]:
                continue
            left[seed] = False
            front = np.array([seed])
            while len(front):
                some, front = front[: max(1, ITEMS // many)], front[max(1, ITEMS // many) :]
                mask = within(plane, np.repeat(fps[own[some]], many), np.tile(np.arange(many), len(some))).reshape(len(some), many)
                hit = np.unpackbits(np.bitwise_or.reduce(mask, axis=0).astype("<u8").view(np.uint8), bitorder="little").astype(bool) & left
                new = np.flatnonzero(hit)
                left[new] = False
                label[own[new]] = own[seed]
                front = np.concatenate([front, new])
    return label


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): representatives of linked fingerprints, of (fp, rep); a spanning forest of every bucket."""
    block = lambda c, i, width: F.shiftrightunsigned(c, i * width).bitwiseAND(F.lit((1 << width) - 1))
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), (block(F.col("fp"), i, 16) * 65536 + block(F.col("fp"), j, 16)).alias("key")) for t, (i, j) in enumerate(pairs)])
    rows = distinct.select("fp", "rep", F.inline(tables))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("t", "key"))).filter("n > 1")
    rest = F.lit(None).cast("long")
    for t, (i, j) in enumerate(pairs):
        k, m = sorted({0, 1, 2, 3} - {i, j})
        rest = F.when(F.col("t") == t, block(F.col("fp"), k, 16) * 65536 + block(F.col("fp"), m, 16)).otherwise(rest)
    rows = rows.withColumn("rest", rest)
    parts = F.array(*[F.xxhash64("t", "key", F.lit(s), block(F.col("rest"), i, 8), block(F.col("rest"), j, 8)) for s, (i, j) in enumerate(pairs)])
    rows = rows.select("fp", "rep", F.explode(F.when(F.col("n") > CROWDED, parts).otherwise(F.array(F.xxhash64("t", "key")))).alias("bucket"))

    def compare(batches):
        held = None

        def found(table: pa.Table):
            bucket, fps, reps = (table.column(c).to_numpy() for c in ("bucket", "fp", "rep"))
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            label = forest(fps.view(np.uint64), starts)
            other = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(reps[label[other]]), pa.array(reps[other])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = table.column("bucket").to_numpy()
            cut = int(np.flatnonzero(np.append(True, last[1:] != last[:-1]))[-1])  # the last bucket may go on
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield found(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp", "rep").mapInArrow(compare, "a long, b long")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``row``, a hash of all their columns; only wholly equal rows share it."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("row", F.xxhash64(*every, *[c.isNull() for c in every]))


def components_of(prints: DataFrame) -> DataFrame:
    """(fp, group) of the different ``fp``: equal groups are linked. No id takes part, so null ids lose no link."""
    distinct = materialise(prints.select("fp").distinct(), "fingerprints")
    found = components(links(distinct.withColumn("rep", F.col("fp"))))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"))


def groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach; null if all of them are null."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(components_of(prints).join(least, "fp"), "fingerprints")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The row of the smallest id of each group, of (row, id, group), with all its columns; null ids come last, and of
    rows with one id that of the smallest hash is taken. Wholly equal rows give a single one."""
    keep = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("o")).select(F.col("o.row").alias("row"))
    inner, own = renamed(docs)
    return keyed(inner).join(keep, "row", "left_semi").select(*own.values()).distinct().toDF(*own)


def deduplicated(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each group. Two texts under one id are two rows, each in its own group."""
    inner, own = renamed(docs)
    rows = keyed(inner)
    prints = materialise(fingerprints(rows.select(F.col("row").alias("doc_id"), F.col(own["text"]).alias("text")), words), "fingerprints")
    ids = rows.select("row", F.col(own["doc_id"]).cast("long").alias("id")).distinct()
    named = prints.withColumnRenamed("doc_id", "row").distinct().join(components_of(prints), "fp")
    return one_of_each(docs, named.join(ids, "row").select("row", "id", "group"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
