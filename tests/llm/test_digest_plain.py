"""Quartile digests against a second, plain version written from their description, and against edits of known size."""

import hashlib
import math
import random
from collections import Counter

import pytest

from matchengine.llm.queries import QUERIES

CHOSEN = ("abc", "abd", "acd", "ace", "abe", "ade")  # of the five bytes abcde, a being the last of a window
MASK = (1 << 32) - 1


def bucket(x, y, z, salt):
    h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D + 0x27D4EB2F * (salt + 1)) & MASK
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & MASK
    return h >> 24


def digest(text):
    """(length class, two ratios, 256 quartile numbers)."""
    body = text.encode()
    count = Counter()
    for i in range(len(body) - 4):
        window = dict(zip("edcba", body[i : i + 5], strict=True))
        for salt, names in enumerate(CHOSEN):
            count[bucket(*(window[n] for n in names), salt)] += 1
    every = [count[b] for b in range(256)]
    low, mid, high = (sorted(every)[k] for k in (63, 127, 191))
    top = max(high, 1)
    return min(255, math.floor(math.log1p(len(body)) / math.log(1.1))), (15 * low // top & 255, 15 * mid // top & 255), [sum(c > q for q in (low, mid, high)) for c in every]


def shown(d):
    length, (one, two), quartiles = d
    fours = [quartiles[i] << 6 | quartiles[i + 1] << 4 | quartiles[i + 2] << 2 | quartiles[i + 3] for i in range(0, 256, 4)]
    return "".join(f"{x:02x}" for x in [length, one << 4 | two, *fours])


def likeness(a, b):
    far = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[2], b[2], strict=True))
    length, ratios = abs(a[0] - b[0]), sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True))
    far += 2 * (length - 1) if length > 1 else length
    far += 2 * (ratios - 2) if ratios > 2 else 0
    return 1 - min(far, 1.625 * 256) / (1.625 * 256)


def test_against_a_plain_version(spark, tmp_path):
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 3000][:60]
    rows = [*base, (70001, None), (70002, ""), (70003, "abcd"), (70004, "é" * 40), (70005, "x" * 5000), (70005, "x" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        new = t[: len(t) - k] + n[:k]
        a, b, c = digest(t), digest(new), digest(n)
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), shown(a), shown(b), round(likeness(a, b), 9), round(likeness(a, c), 9)] += 1
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = Counter(tuple(round(r[n], 9) if n.startswith("near") else r[n] for n in names) for r in QUERIES["op6_fingerprints"](spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("share, least", [(0.02, 0.85), (0.1, 0.6)])
def test_small_edits_stay_near(share, least):
    r = random.Random(1)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ken", "lu") for b in ("sa", "ver", "po", "ni", "x")]
    text = [r.choice(words) for _ in range(900)]
    other = [r.choice(["quo", "zat", "bif", "wug", "hjo"]) for _ in range(900)]
    new = [r.choice(words) if r.random() < share else w for w in text]
    near, far = likeness(digest(" ".join(text)), digest(" ".join(new))), likeness(digest(" ".join(text)), digest(" ".join(other)))
    assert near >= least > far
