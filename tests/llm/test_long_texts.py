"""Texts longer than the steps in which operators work, and words that parts of a step share."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from matchengine.llm import bpe, suffix_dedup, token_counts
from matchengine.llm.bpe import ByteEncoder, tokenizer
from tests.llm.test_operators import brute_removed


def test_repeats_in_texts_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(x) for x in rng.integers(97, 123, n))
    shared = word(900)
    docs = [(i, word(int(rng.integers(0, 2500))) + shared[int(rng.integers(0, 500)) :] + word(int(rng.integers(0, 2500)))) for i in range(12)] + [(12, ""), (13, "ab" * 3000), (14, None)]
    bodies = [(t or "").encode() for _, t in docs]
    for length in (200,):
        kmers = [suffix_dedup._found(np.frombuffer(b, np.uint8), np.array([0, len(b)]), length) for b in bodies if len(b) >= length]
        assert sum(int((last - first + 1).sum()) for found in kmers for _, first, last, _ in found) == sum(max(0, len(b) - length + 1) for b in bodies)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = {i: np.frombuffer(b, np.uint8)[~g].tobytes().decode() for (i, _), b, g in zip(docs, bodies, brute_removed(bodies), strict=True)}
    assert {r.doc_id: r.text or "" for r in suffix_dedup.deduplicated(d).collect()} == want


def test_pieces_of_words_give_the_texts_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = tokenizer(path), ByteEncoder(path)
    assert encode.table.plain
    texts = ["", " ", "a", "don't stop, it's'", "x\ny z\n\nw \n v", "é.\nÀ!!", "\n", "a\n", "a\n b", " lead", "tab\tx", "a  b", "end ", "½ ²x 12a a1", "日本 語", "a­b ́x", "<|endoftext|> q", "q.\n", "x\r\ny"]
    texts += ["a\x00b c\x00", "it'll I've\nwe're", "z'\ns", "a\n'tis", "\x85 k", "nbsp\xa0x y", "shout!!! %%% a&&&\nB***", "a.b c", "Ünï.\nçà?! x", "l m n", "e.g. i.e.,\nAnd"]
    for turn in (texts, texts[::-1], texts):
        ids, counts = encode(pa.array(turn))
        ends = np.cumsum(counts)
        assert [ids[z - n : z].tolist() for z, n in zip(ends, counts, strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in turn]


def test_limits_and_quantiles_from_suffix_sums(spark):
    sizes = [0, 0, 3, 3, 3, 10, 700, 5000, 5000, 90000]
    hist = spark.createDataFrame([(n, sizes.count(n)) for n in set(sizes)], "n_tokens long, n_docs long")
    sums = token_counts.suffix_sums(hist, 1000)
    limits = [0, 1, 3, 4, 699, 700, 4999, 5000, 90000, 10**6]
    assert [(r.truncated_total, r.docs_cut) for r in token_counts.at_limits(sums, limits).collect()] == [(sum(min(s, x) for s in sizes), sum(s > x for s in sizes)) for x in limits]
    assert [r.n_tokens for r in token_counts.at_quantiles(sums, [0.0, 0.2, 0.5, 0.6, 0.95, 1.0]).collect()] == [0, 0, 3, 10, 90000, 90000]
    assert [tuple(r) for r in token_counts.at_limits(sums.limit(0), [5]).collect()] == [(5, 0, 0)]
