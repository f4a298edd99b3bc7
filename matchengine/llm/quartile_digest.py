"""Document fingerprints: quartile bucket digests.

Six byte triplets of every window of five bytes are hashed into 256 buckets; each bucket's count becomes the number
of the quartile it lies in, two bits; a length class and the quartiles' ratios go before. Two digests are compared by
a difference that is cut at that of unrelated digests, and read as a likeness from 0 to 1.

Defined cases: a null text is empty; texts under five bytes count nothing, their length class tells them apart;
equal texts have equal digests; rows of one id are ordered by their texts; a single row is its own next; null ids
come last in descending order; a text longer than STEP is digested on its own; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
BOUND = 1.625 * BUCKETS  # mean difference of independent quartiles
STEP = 4_000_000  # bytes digested at a time
NULL_ID = -(1 << 63)


def counts(bodies: list[bytes]) -> np.ndarray:
    """[texts, BUCKETS]: how many triplets of each text fall into each bucket."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    out = np.zeros(len(bodies) * BUCKETS, np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint32)
    if len(data) < 5:
        return out.reshape(-1, BUCKETS)
    text = np.repeat(np.arange(len(bodies), dtype=np.int64), sizes)
    inside = text[4:] == text[:-4]
    base = (text[4:] * BUCKETS)[inside]
    for salt, (a, b, c) in enumerate(TRIPLETS):
        n = len(data) - 4
        h = data[4 - a : 4 - a + n] * np.uint32(0x9E3779B1) + data[4 - b : 4 - b + n] * np.uint32(0x85EBCA77) + data[4 - c : 4 - c + n] * np.uint32(0xC2B2AE3D)
        h += np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(base + (h[inside] >> np.uint32(24)), minlength=len(out))
    return out.reshape(-1, BUCKETS)


def digests(bodies: list[bytes]) -> np.ndarray:
    """[texts, 3 + BUCKETS] of length class, two ratios of quartiles (16 levels each), and each bucket's quartile 0-3."""
    c = counts(bodies)
    q = np.sort(c, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    body = (c > q[:, :1]).astype(np.uint8) + (c > q[:, 1:2]) + (c > q[:, 2:])
    sizes = np.fromiter(map(len, bodies), np.float64, len(bodies))
    length = np.minimum(255, np.floor(np.log1p(sizes) / np.log(1.1))).astype(np.uint8)
    top = np.maximum(q[:, 2], 1)
    return np.column_stack([length, 15 * q[:, 0] // top, 15 * q[:, 1] // top, body]).astype(np.uint8)


def text_of(digest: np.ndarray) -> str:
    """Hexadecimal: length class, the two ratios, and four buckets a byte."""
    four = digest[3:].reshape(-1, 4)
    return bytes([digest[0], digest[1] << 4 | digest[2], *(four @ np.array([64, 16, 4, 1], np.uint8)).tolist()]).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 of equal digests, 0 of ones as far apart as unrelated ones. Opposite quartiles count double."""
    d = np.abs(a[:, 3:].astype(np.int16) - b[:, 3:])
    body = np.where(d == 3, 6, d).sum(1)
    length = np.abs(a[:, 0].astype(np.int16) - b[:, 0])
    ratios = np.abs(a[:, 1:3].astype(np.int16) - b[:, 1:3]).sum(1)
    return 1 - np.minimum(BOUND, body + np.where(length > 1, 2.0 * (length - 1), length) + np.where(ratios > 2, 2.0 * (ratios - 2), 0)) / BOUND


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, text): ranges of descending doc_id; each range also gets, as guests, the rows that the
    next range begins with, so that every text can be compared with the next. The driver gets one id a range."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    share = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(1.0))
    row = rows.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", share, 10 * parts).alias("q")).first()
    heads = np.array(sorted({row.top, *row.q} if row.top is not None else set()), np.int64)  # ids that occur

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            part = (len(heads) - 1 - np.searchsorted(heads, ids)).astype(np.int32)
            first = np.flatnonzero(ids == heads[len(heads) - 1 - part])
            guests = b.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(ids), bool)), b.column(0), b.column(1)], ["part", "guest", "doc_id", "text"])
            yield pa.RecordBatch.from_arrays([pa.array((part[first] - 1) % len(heads)).cast(pa.int32()), pa.array(np.ones(len(first), bool)), guests.column(0), guests.column(1)], ["part", "guest", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, guest boolean, doc_id long, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").desc(), "text")


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(rows: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [after]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        bodies = [t.encode() for t in changed]
        own, new = digests([t.encode() for t in texts]), digests(bodies)
        ids = [None if d == NULL_ID else d for d, _ in rows]
        values = [ids, [len(t) for _, t in rows], [hashlib.sha256(b).hexdigest() for b in bodies], [text_of(d) for d in own[:-1]], [text_of(d) for d in new], likeness(own[:-1], new), likeness(own[:-1], own[1:])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches):
        part, held, size, closed = None, [], 0, True
        for b in batches:
            for p, guest, d, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if guest:
                    if not closed:
                        yield block(held, text)
                        held, size, closed = [], 0, True
                    continue
                if p != part:
                    part, closed = p, False
                if size > STEP:
                    yield block(held, text)
                    held, size = [], 0
                held.append((d, text))
                size += len(text)

    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for every document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
