"""Every stage of the corpus pipeline against a plain version on its own input; near copies by 5 words and 0.8."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from matchengine.llm import mixing, near_copies
from matchengine.llm.queries import QUERIES
from matchengine.llm.store import materialise
from tests.llm.test_operators import WORD, brute_removed, sha


def brute_near_groups(rows):
    """Lists of the (id, text) that similarities of 0.8 or more connect."""
    sets = [near_copies.shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both >= 0.8 * (len(x) + len(sets[j]) - both):
                group[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def test_stages(spark, sf):
    import public_tokenizers

    word_bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word_bpe.no_truncation()
    word_bpe.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(materialise(stage(spark, outs[-1], sf), "stage"))
    assert all(o.columns == docs.columns for o in outs[:-1])
    pairs = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    kept = Counter(r.doc_id for r in QUERIES["op10_quality_rules"](spark, sf).filter("kept").collect())
    assert Counter(i for i, _ in pairs(outs[1])) == kept
    groups = brute_near_groups(pairs(outs[1]))
    second = outs[2].collect()
    # no group loses all, none is kept twice: on this table every link is proposed
    assert sorted(r.doc_id for r in second) == sorted(min(i for i, _ in g) for g in groups)
    assert any(len({t for _, t in g}) > 1 for g in groups)
    bodies = [(r.text or "").encode() for r in second]
    cut = {r.doc_id: np.frombuffer(b, np.uint8)[~g].tobytes().decode(errors="ignore") for r, b, g in zip(second, bodies, brute_removed(bodies), strict=True)}
    assert dict(pairs(outs[3])) == {i: t for i, t in cut.items() if t.strip(" ")}
    taken = Counter()
    for r in outs[4].collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mix(outs[3]).collect() if r.taken})
    want = Counter()
    for i, t in pairs(outs[4]):
        ids = word_bpe.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(word_bpe.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in outs[5].collect()) == want
