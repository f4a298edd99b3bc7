"""Counts of the language model, and the workers' table of its files."""

import numpy as np

from matchengine.llm import kneser_ney


def test_counts_beyond_32_bits_are_kept(tmp_path):
    keys = np.array([3, 9, 1 << 47], np.uint64)
    counts, few = np.array([1, (1 << 32) + 5, 1 << 40], np.int64), np.array([1, 0, 2], np.int64)
    w, c, d = kneser_ney.unpack(kneser_ney.pack(keys, counts, few), "wii")
    assert (w == keys).all() and (c == counts).all() and (d == few).all()
    for name, columns in (("pairs-0", (counts, few)), ("words-0", (few, few))):
        (tmp_path / name).write_bytes(kneser_ney.shard_file(keys, *columns))
        found = kneser_ney.shards_of(f"file://{tmp_path}").find(name[:-2], np.zeros(4, np.int64), np.array([9, 3, 5, 1 << 47], np.uint64), 2)
        assert [list(f) for f in found] == [[int(x[1]), int(x[0]), 0, int(x[2])] for x in columns]
    assert kneser_ney.shards_of(f"file://{tmp_path}") is kneser_ney.shards_of(f"file://{tmp_path}")
