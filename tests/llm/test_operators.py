"""Every operator against a brute-force version over real and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchengine.llm import kneser_ney, quartile_digest, simhash, suffix_dedup, token_counts, token_store
from matchengine.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_token_counts(spark, sf, texts):
    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sizes = [len(e.encode_ordinary(t or "")) for _, t, _ in texts]
    got = rows(QUERIES["op1_token_counts"](spark, sf))
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(sizes)
    for r in got:
        n = r["n_tokens"]
        assert (r["docs_from"], r["tokens_from"]) == (sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert r["truncated_total"] == sum(min(s, n) for s in sizes) and r["quantile"] == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    at = rows(token_counts.at_limits(token_counts.histogram(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), [0, 50, 10**7]))
    assert [(r["truncated_total"], r["docs_cut"]) for r in at] == [(sum(min(s, x) for s in sizes), sum(s > x for s in sizes)) for x in (0, 50, 10**7)]


def brute_print(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """{(id, fp): smallest id} by comparing all."""
    todo, out = set(prints), {}
    while todo:
        seen, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            seen.add(x)
            near = {y for y in todo if (x[1] ^ y[1]).bit_count() <= 2}
            todo -= near
            front += near
        least = min(i for i, _ in seen)
        out.update({x: least for x in seen})
    return out


def test_simhash(spark, sf, texts):
    want = brute_groups([(i, brute_print(t)) for i, t, _ in texts])
    got = rows(QUERIES["op2_simhash"](spark, sf))
    assert len(got) == len(texts)
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got} == want
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)


def test_simhash_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 8)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 5)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (60, 2))}
    fps |= {int(rng.integers(0, 1 << 16)) for _ in range(300)}
    prints = list(enumerate(sorted(fps)))
    d = spark.createDataFrame([(f, i) for i, f in prints], "fp long, rep long")
    found = {r.node: r.component for r in simhash.components(simhash.links(d)).collect()}
    assert {p: found.get(p[0], p[0]) for p in prints} == brute_groups(prints)


@pytest.fixture(scope="module")
def word_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, sf, texts, word_bpe):
    want = Counter()
    for i, t, _ in texts:
        ids = word_bpe.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(word_bpe.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(QUERIES["op4_bpe"](spark, sf))) == want


def test_mixing(spark, sf, texts):
    got = rows(QUERIES["op5_mixing"](spark, sf))
    assert len(got) == len(texts)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in texts)
    own = defaultdict(int)
    for _, t, s in texts:
        own[s] += len(WORD.findall(t or ""))
    names = sorted(s for s in own if s is not None) + ([None] if None in own else [])
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(own.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * own[s]}
        for s in full or open_:
            target[s] = 3.0 * own[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    source = {i: s for i, _, s in texts}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == own[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(64, 0.05 * target[s])
    assert sorted(map(repr, got)) == sorted(map(repr, rows(QUERIES["op5_mixing"](spark, sf))))


def test_fingerprints(spark, sf, texts):
    order = sorted(((i, t or "") for i, t, _ in texts), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = quartile_digest.edited(t, n)
        d = quartile_digest.digests([t.encode(), e.encode(), n.encode()])
        near = quartile_digest.likeness(d[:1].repeat(2, 0), d[1:])
        want[i, len(t), sha(e.encode()), quartile_digest.text_of(d[0]), quartile_digest.text_of(d[1]), near[0], near[1]] += 1
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = rows(QUERIES["op6_fingerprints"](spark, sf))
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    long = [r for r in got if r["n_chars"] > 2000]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.1
    assert quartile_digest.edited("abcdefghi", "xy") == "abcdefxy"


def test_fingerprint_counts():
    text = b"the quick brown fox"
    assert quartile_digest.counts([text, b"abc", b""]).sum(1).tolist() == [6 * (len(text) - 4), 0, 0]
    many = [bytes(np.random.default_rng(i).integers(97, 123, 500, np.uint8)) for i in range(4)]
    assert (quartile_digest.digests(many) == np.concatenate([quartile_digest.digests([m]) for m in many])).all()


def brute_removed(bodies, length=200):
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_suffix_dedup(spark, sf, texts):
    bodies = [(t or "").encode() for _, t, _ in texts]
    want = Counter()
    for (i, _, _), b, gone in zip(texts, bodies, brute_removed(bodies), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())] += 1
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in rows(QUERIES["op7_suffix_dedup"](spark, sf))) == want


@pytest.mark.parametrize("crowded", [8000, 0])
def test_suffix_dedup_shared_passages(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(x) for x in rng.integers(97, 101, n))
    shared = [word(n) for n in (199, 200, 201, 450, 900)]
    docs = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 300))) for _ in range(3)]
        docs.append((i, parts[0] + shared[i % 5] + parts[1] + shared[(i * 7 + 1) % 5][: int(rng.integers(150, 460))] + parts[2]))
    docs += [(60, "z" * 1000), (61, "q" * 201), (62, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bodies = [(t or "").encode() for _, t in docs]
    want = {i: np.frombuffer(b, np.uint8)[~g].tobytes().decode() for (i, _), b, g in zip(docs, bodies, brute_removed(bodies), strict=True)}
    assert {r.doc_id: r.text or "" for r in suffix_dedup.deduplicated(d).collect()} == want


def test_lm_score(spark, sf, texts):
    """At whatever order the query takes."""
    from tests.llm.test_orders import plain

    tokens = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [tokens(t) for i, t, _ in texts if not held(i)]
    one = Counter(w for d in train for w in d)
    n, v_ = sum(one.values()), len(one)
    order = kneser_ney.ORDER
    prob, score = plain(train, order)
    for h in [("<",) * (order - 1), (None,) * (order - 1), tuple(train[0][: order - 1])]:
        assert sum(prob((*h, w)) for w in one) + prob((*h, "unseen")) == pytest.approx(1)
    got = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in rows(QUERIES["op8_lm_score"](spark, sf))}
    for i, t, _ in texts:
        d = tokens(t)
        r = got[i, len(d), sum(one[w] > 0 for w in d)]
        assert r["held_out"] == held(i) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v_ + 1))) for w in d))
        assert r["score"] == pytest.approx(score(d))
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_token_ids(spark, sf, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want, at = [], 0
    for i, text, _ in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(QUERIES["op9_token_ids"](spark, sf)))
    assert got == want


def test_token_files_have_page_indexes(spark, sf, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_store.write(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "o"), public_tokenizers.path("byte_bpe_50k.json"))
    for f in glob.glob(str(tmp_path / "o/*.parquet")):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            c = m.row_group(g).column(0)
            assert c.has_offset_index and c.has_column_index


def test_selective_token_reads(spark, sf, tmp_path):
    """Few documents and the metadata alone are read without the rest of the files."""
    import glob
    import os

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 900000").dropDuplicates(["doc_id"])
    docs = docs.withColumn("ids", F.lit("own")).withColumn("part", F.col("lang"))
    out = str(tmp_path / "o")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write(docs.coalesce(1), out, path, metadata=("lang", "n_chars", "ids", "part"), **{"parquet.block.row.count.limit": "20", "parquet.block.size": "20000", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "10"})
    kinds = {"lang": "string", "n_chars": "long", "own": "string", "part": "string"}
    t = Tokenizer.from_file(path)
    t.no_truncation()
    want = {r.doc_id: ([*t.encode(r.text or "", add_special_tokens=False).ids, 0], r.lang, r.n_chars, "own", r.lang) for r in docs.collect()}
    few = token_store.selected(spark, out, [3, 77, 150], kinds)
    got = {r.doc_id: (list(r.ids), r.lang, r.n_chars, r.own, r.part) for r in few.collect()}
    assert got == {i: want[i] for i in (3, 77, 150)}
    scan = next(x for x in few._jdf.queryExecution().explainString(few._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if x.startswith("PushedFilters"))
    assert "In(doc_id, [" in scan and all(str(i) in scan for i in (3, 77, 150))
    light = token_store.selected(spark, out, metadata=kinds, tokens=False)
    assert "ids:array" not in light._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.n_tokens, r.lang) for r in light.collect()} == {(i, len(v[0]), v[1]) for i, v in want.items()}
    groups = pages = 0
    import pyarrow.parquet as pq

    for f in glob.glob(f"{out}/*.parquet"):
        m = pq.ParquetFile(f).metadata
        groups += m.num_row_groups
        hit = [g for g in range(m.num_row_groups) if any(m.row_group(g).column(0).statistics.min <= i <= m.row_group(g).column(0).statistics.max for i in (3, 77, 150))]
        pages += sum(m.row_group(g).num_rows for g in hit)
        assert os.path.getsize(f) > 0
    assert groups > 6 and pages < 0.7 * len(want)  # statistics leave whole row groups out


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, sf, texts):
    got = rows(QUERIES["op10_quality_rules"](spark, sf))
    want = Counter((i, *brute_quality(t)) for i, t, _ in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_pipeline(spark, sf, word_bpe):
    import corpus_pipeline
    from matchengine.llm import mixing
    from matchengine.llm.store import materialise
    from tests.llm.test_pipeline_stages import brute_near_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(materialise(stage(spark, outs[-1], sf), "stage"))
    key = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    assert all(o.columns == docs.columns for o in outs[:-1])
    kept = Counter(r["doc_id"] for r in rows(QUERIES["op10_quality_rules"](spark, sf)) if r["kept"])
    assert Counter(i for i, _ in key(outs[1]).elements()) == kept
    groups = brute_near_groups([(r.doc_id, r.text) for r in outs[1].collect()])  # by five words and 0.8, as the stage promises
    assert sorted(r.doc_id for r in outs[2].collect()) == sorted(min(i for i, _ in g) for g in groups)
    second = outs[2].collect()
    bodies = [(r.text or "").encode() for r in second]
    cut = {r.doc_id: np.frombuffer(b, np.uint8)[~g].tobytes().decode(errors="ignore") for r, b, g in zip(second, bodies, brute_removed(bodies), strict=True)}
    assert {r.doc_id: r.text for r in outs[3].collect()} == {i: t for i, t in cut.items() if t.strip(" ")}
    taken = Counter()
    for r in outs[4].collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mix(outs[3]).collect() if r.taken})
    want = Counter()
    for (i, t), n in key(outs[4]).items():
        ids = word_bpe.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(word_bpe.decode(ids, skip_special_tokens=False).encode())] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in outs[5].collect()) == want
