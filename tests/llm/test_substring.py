"""Substring removal by suffix automata against brute force over windows of words."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from matchengine.llm import substring_dedup as m
from matchengine.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length=35):
    """(words, which of them go) of each text."""
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for w in docs:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((w, gone))
    return out


def kept(w, gone):
    return " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_whole_table(spark, sf, texts):
    want = Counter()
    for (i, _, _), (w, gone) in zip(texts, brute([t for _, t, _ in texts]), strict=True):
        want[i, len(w), int(gone.sum()), hashlib.sha256(kept(w, gone).encode()).hexdigest()] += 1
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in QUERIES["op13_substring_dedup"](spark, sf).collect()) == want


def planted():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50, n)]
    shared = [word(n) for n in (34, 35, 36, 80, 300)]
    docs = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 60))) for _ in range(3)]
        at = int(rng.integers(0, 40))
        docs.append((i, " ".join(parts[0] + shared[i % 5] + parts[1] + shared[(i * 7 + 1) % 5][at : at + int(rng.integers(20, 120))] + parts[2])))
    near = word(120)  # near copies of one text
    docs += [(100 + i, " ".join(near[: i + 3] + ["new"] + near[i + 4 :])) for i in range(60)]
    return docs + [(300, "a " * 300), (301, "b " * 35 + "c"), (302, None), (303, ""), (None, " ".join(shared[3])), (None, "\t".join(shared[3]) + "\n x"), (304, "z" * 3000), (305, " ".join(word(34)))]


@pytest.mark.parametrize("crowded", [m.CROWDED, 0, 3000])
def test_planted_passages(spark, monkeypatch, crowded):
    monkeypatch.setattr(m, "CROWDED", crowded)
    docs = planted()
    d = spark.createDataFrame([(*r, 7, *"abcdefg") for r in docs], "doc_id long, text string, n_chars long, spans string, _doc string, _tag string, _row string, kmer string, lo string, s1 string")
    got = m.deduplicated(d.repartition(3))
    assert got.columns == d.columns
    want = Counter()
    for (i, t), (w, gone) in zip(docs, brute([t for _, t in docs]), strict=True):
        new = kept(w, gone) if gone.any() else t
        want[i, new, None if new is None else len(new)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == want
    assert {tuple(r)[3:] for r in got.collect()} == {tuple("abcdefg")}


def test_no_passage_repeats(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for i in range(20)], "doc_id long, text string")
    assert Counter(map(tuple, m.deduplicated(d).collect())) == Counter(map(tuple, d.collect()))


def places(strings, part):
    return sum(n for s, n in strings for i in range(len(s) - len(part) + 1) if s[i : i + len(part)] == part)


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(40):
        strings = list({tuple(rng.integers(0, 3, int(rng.integers(1, 14))).tolist()): int(rng.integers(1, 3)) for _ in range(6)}.items())
        a = m.Automaton()
        for s, n in strings:
            a.add(list(s), n)
        a.close()
        for asked in [*[s for s, _ in strings], tuple(rng.integers(0, 4, 20).tolist())]:
            want = [max((n for n in range(1, e + 2) if places(strings, asked[e + 1 - n : e + 1]) > 1), default=0) for e in range(len(asked))]
            assert a.statistics(list(asked)) == want


@pytest.mark.parametrize("shard", [1, 200, 10**6])
def test_shards_end_between_anchors(monkeypatch, shard):
    monkeypatch.setattr(m, "SHARD", shard)
    rng = np.random.default_rng(8)
    rows = sorted((int(k), i, 0, int(rng.integers(1, 3)), rng.integers(0, 2, 9).tolist()) for i, k in enumerate(rng.integers(0, 12, 200)))
    cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array([9] * len(rows), pa.int32()), pa.array([" ".join(map(str, r[4])).encode() for r in rows], pa.binary())], ["kmer", "s1", "s2", "n", "words", "data"])
    got = {}
    for b in m.stream_shards(9)([batch.slice(i, 7) for i in range(0, len(rows), 7)]):
        got |= {r["s1"]: r["spans"] for r in b.to_pylist()}
    alone = lambda r: sum(n for k, _, _, n, w in rows if w == r[4] and (k == r[0] or shard > 10**5)) > 1
    if shard != 200:
        assert set(got) == {r[1] for r in rows if alone(r)}
    assert all(s == [{"lo": 0, "hi": 0}] for s in got.values())
    assert {r[1] for r in rows if sum(n for k, _, _, n, w in rows if w == r[4] and k == r[0]) > 1} <= set(got)


def test_steps_overlap(monkeypatch):
    """A text longer than a step has the windows that it has in one step, each once."""
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 9000, 3000))
    texts = pa.array(["x y", text, "z " * 40])

    def windows():
        out = []
        for number, shift, data, starts in m.steps(texts, 35):
            inside = m.WORD[data]
            begin, end = m.cut(inside, starts)
            part = np.searchsorted(starts, begin, "right") - 1
            first, last, kmer = m.anchors(m.hashed(data, begin, end), part, 35, m.K)
            base = np.searchsorted(part, part[first]) - shift
            out += [(int(part[f]) + number, w - int(b), int(k)) for f, z, b, k in zip(first, last, base, kmer, strict=True) for w in range(f, z + 1)]
        return out

    want = windows()
    assert len(want) == 3000 - 34 + 40 - 34
    monkeypatch.setattr(m, "STEP", 900)
    got = windows()
    assert sorted(got) == sorted(want)
