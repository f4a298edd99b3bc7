"""How much disk the language model's blocks and files take, and that nothing is lost in them."""

import numpy as np

from matchengine.llm import kneser_ney


def test_a_file_takes_few_bytes_a_key_and_tells_all_keys_apart():
    rng = np.random.default_rng(5)
    n = 400_000
    keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    keys[1::2] = keys[::2][: len(keys) // 2] + np.uint64(1)  # neighbours differ in their last bit
    columns = [np.minimum(rng.zipf(2.5, len(keys)), 1 << 20).astype(np.int64) for _ in range(2)] + [rng.integers(0, 2, len(keys)) for _ in range(3)]
    data = kneser_ney.shard_file(keys, *columns)
    assert len(data) < 10 * len(keys)
    shard = kneser_ney.Shard.of(np.frombuffer(data, np.uint8), 5)
    mixed = rng.permutation(len(keys))
    hit, at = shard.find(keys[mixed])
    assert hit.all() and all((got == c[mixed]).all() for got, c in zip(shard.columns(at), columns, strict=True))
    others = keys + np.uint64(7)
    assert (shard.find(others)[0] == np.isin(others, keys)).all()


def test_keys_of_pairs_are_exact():
    rng = np.random.default_rng(6)
    for bits in (2, 9, 22, 32):
        pairs = np.unique(rng.integers(0, 1 << bits, (50_000, 2), np.uint64), axis=0)
        assert len(np.unique(kneser_ney.gram_keys([pairs[:, 0], pairs[:, 1]], bits))) == len(pairs)


def test_blocks_take_few_bytes_a_gram():
    """A block of rare words held each word's hash before."""
    rng = np.random.default_rng(7)
    words = (rng.zipf(1.2, 200_000) % 3_000_000 + 2).astype(np.uint64)
    grams = kneser_ney.grams(words, np.full(400, 500), 3)
    blocks = dict(kneser_ney.dealt(grams, [np.ones(len(words), np.int64)], 8, 8, 22))
    back = [kneser_ney.unpack(b, "wwwi") for b in blocks.values()]
    got = {(int(u), int(v), int(w)): int(c) for vs, us, ws, cs in back for v, u, w, c in zip(vs, us, ws, cs, strict=True)}
    want: dict = {}
    for g in zip(*(x.tolist() for x in grams), strict=True):
        want[g] = want.get(g, 0) + 1
    assert got == want and sum(map(len, blocks.values())) < 6 * len(want)


def test_frequent_words_have_small_numbers(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i % 7}" for i in range(700)) + " " + " ".join(f"rare{i}" for i in range(300)),)], "text string")
    from matchengine.llm.store import shared_dir

    path = shared_dir(spark, "numbered")
    end = kneser_ney.numbered(docs, path, 8)
    import pyarrow as pa

    number = kneser_ney.shards_of(path).numbering(8, end)
    w, _ = kneser_ney.tokens(pa.array(["w0 w1 w2 w3 w4 w5 w6", " ".join(f"rare{i}" for i in range(300)), "unseen"]), number)
    assert max(w[:7]) < 2 + 8 * 7 and len(set(w.tolist())) == 7 + 300 + 2 and max(w[8:308]) < end and w[-2] == end
