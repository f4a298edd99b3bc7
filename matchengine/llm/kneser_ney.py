"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order, counted in Spark.

A first pass counts words and numbers them: rank by count within a shard of words, times the shards, and the shard, so that
frequent words have small numbers. Workers reduce their texts to distinct n-grams of these numbers, sent as compressed
blocks to shards. Each shard adds up its n-grams and writes them as sorted arrays of keys and counts; what it learns about
shorter grams (as contexts and as continuations) goes on to the shards of the next lower order, which do the same, down to
single words. Scoring memory-maps these files in every worker: the operating system holds the pages in use, no worker holds
the model. Only a few dozen totals reach the driver.

Grams meet at the word before the last, spread by the one next to it, so that a word before very many others is dealt
over many shards. Shards grow in number with the bytes of text, the spread with the square root of the shards.

Words are told by 64-bit hashes: two of V different words are taken for one with a chance of V squared in 2^65, one in
seventy at a billion. Keys of pairs are exact up to 2^32 words, those of longer grams 64-bit hashes within their shard.
A text is preceded by as many starts as a context has words.

Defined cases: a null text is empty: one token, the end. A null id counts as held out. With nothing to learn from,
every score is that of the uniform model over one word. Repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.llm.bpe import pieces
from matchengine.llm.store import filesystem, local_path, put, shared_dir

ORDER = 3
SPREAD = 8  # least number of shards over which the words behind one word are spread
SHARD_TEXT = 16_000_000  # bytes of text a shard
START, END = 0, 1  # words are numbered from two
BLOCK = 3_000_000  # n-grams times order over two, reduced at a time
MAPPED = 2048  # files of a model that a worker holds open; Linux allows a process 65,530 mappings


def tokens(texts: pa.Array, number=lambda hashes: hashes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all texts, each text followed by the end, number of tokens of each text). ``number`` gets
    hashes of words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    which = coded.indices.to_numpy()
    real = np.array([w != "" for w in names], bool)[which] if names else np.zeros(0, bool)
    offsets = parts.offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    words = number(hashes)[which[real]] if names else np.zeros(0, np.uint64)
    return np.insert(words, ends[1:], np.uint64(END)), np.diff(ends) + 1


def before(words: np.ndarray, counts: np.ndarray, start: int = START) -> np.ndarray:
    """What stands before each, the start at the beginning of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    if len(words):
        out[np.cumsum(counts) - counts] = start
    return out


def grams(words: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, first word first."""
    out = [words]
    for _ in range(order - 1):
        out.insert(0, before(out[0], counts))
    return out


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = v * np.uint64(0x9E3779B185EBCA87) + w
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_keys(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Spread over 64 bits; one or two words of at most 32 ``bits`` are told apart by them."""
    if len(words) > 2 or bits > 32:
        keys = gram_keys(words[:2], bits) if bits <= 32 else words[0]
        for w in words[2 if bits <= 32 else 1 :]:
            keys = pair_keys(keys, w)
        return keys
    low = 64 - bits * len(words)  # bits that stay zero
    h = np.zeros(len(words[0]), np.uint64)
    for i, w in enumerate(words):
        h |= w << np.uint64(64 - bits * (i + 1))
    h *= np.uint64(0x9E3779B185EBCA87)
    h ^= h >> np.uint64(32) >> np.uint64(low) << np.uint64(low)
    return h * np.uint64(0xD6E8FEB86659FD93)


def gram_shard(words: list[np.ndarray], shards: int, spread: int) -> np.ndarray:
    """Of longer grams by the word before the last and the one next to it."""
    mix = lambda x: (x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
    if len(words) == 1:
        return (mix(words[0]) % np.uint64(shards)).astype(np.int64)
    by, then = words[-2], words[-3] if len(words) > 2 else words[-1]
    return (mix(by) % np.uint64(shards // spread) * np.uint64(spread) + mix(then) % np.uint64(spread)).astype(np.int64)


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    """Of hashes; rises with them."""
    return ((w >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def total(order: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the columns' sums for each."""
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [first, keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in columns)]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is). np.unique() sorts in a slower, stable way."""
    order = np.argsort(keys)
    names = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = names[1:] != names[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return names[new], order[new], which


def width(c: np.ndarray) -> int:
    """Bytes that hold every number of a column."""
    return max(1, -(-int(c.max()).bit_length() // 8)) if len(c) else 1


def planes(c: np.ndarray, wide: int) -> bytes:
    """The low bytes of a column, byte by byte."""
    return bytes([wide]) + np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Compressed columns: words (unsigned), whose rows are in order, as differences where all words before are the same as
    in the row before, then counts (signed)."""
    out, same = [len(columns[0]).to_bytes(8, "little")], np.ones(len(columns[0]), bool)
    for c in columns:
        if c.dtype == np.uint64:
            rise = np.where(same, np.diff(c, prepend=np.uint64(0)), c)
            same[:1] = False
            same[1:] &= c[1:] == c[:-1]
            c = rise
        out.append(planes(c, width(c)))
    return zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """Columns as pack() got them; ``w`` stands for words, ``i`` for counts."""
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n, at, out = int(data[:8].view("<u8")[0]), 8, []
    same = np.ones(n, bool)
    for k in kinds:
        wide, at = int(data[at]), at + 1
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :wide] = data[at : at + wide * n].reshape(wide, n).T
        at += wide * n
        c = whole.view("<u8" if k == "w" else "<i8").ravel()
        if k == "w":
            first = np.flatnonzero(~same)
            rise, c = c, np.cumsum(c, dtype=np.uint64)
            if len(first):  # sums begin anew there
                c -= np.repeat(c[first] - rise[first], np.diff(np.append(first, n)))
            same[:1] = False
            same[1:] &= c[1:] == c[:-1]
        out.append(c)
    return out


TOP = 16  # bits of a key that its place tells


def shard_file(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys and their columns. Of a key, the first 16 bits are told by where each run of keys begins, the next 32 and
    the last 16 are arrays, the last one of bytes or left out where its low bits are zeros. Of columns, each different row is
    held once, frequent ones first, and an entry has its row's number in a byte, 255 where it is larger and in a list."""
    n, low = len(keys), keys & np.uint64(0xFFFF)
    low_bytes = 2 if (low & np.uint64(255)).any() else 1 if low.any() else 0
    starts = np.searchsorted(keys >> np.uint64(64 - TOP), np.arange((1 << TOP) + 1, dtype=np.uint64))
    which, kinds = np.zeros(n, np.int64), 1
    for c in columns:  # numbers of different rows, made small again before they overflow
        most = int(c.max()) + 1 if n else 1
        if kinds * most >> 62:
            names, _, which = distinct(which)
            kinds = len(names)
        if kinds * most >> 62:
            names, _, c = distinct(c)
            most = len(names)
        which, kinds = which * most + c, kinds * most
    _, first, which = distinct(which)
    by = np.argsort(-np.bincount(which, minlength=len(first)), kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    which, rows = rank[which], [c[first[by]] for c in columns]
    more = np.flatnonzero(which > 254)
    wide = 8 if max((int(r.max()) for r in rows if len(r)), default=0) >> 32 else 4
    out = [np.array([n, low_bytes, len(more), len(by), wide], "<u8"), *(r.astype(f"<u{wide}") for r in rows), starts.astype("<u4")]
    out += [more.astype("<u4"), which[more].astype("<u4"), (keys >> np.uint64(16)).astype("<u4")]
    out += [(low if low_bytes == 2 else low >> np.uint64(8)).astype(f"<u{low_bytes}")] if low_bytes else []
    return b"".join(x.tobytes() for x in [*out, np.minimum(which, 255).astype(np.uint8)])


@dataclass(frozen=True)
class Shard:
    """A mapped file of shard_file()."""

    starts: np.ndarray
    middle: np.ndarray
    low: np.ndarray | None
    small: np.ndarray  # 255 of larger ones
    places: np.ndarray  # of larger ones, rising
    large: np.ndarray
    rows: list[np.ndarray]

    @staticmethod
    def of(data: np.ndarray, columns: int) -> Shard:
        n, low_bytes, more, kinds, wide = data[:40].view("<u8").tolist()
        sizes = [wide * kinds] * columns + [4 * ((1 << TOP) + 1), 4 * more, 4 * more, 4 * n, low_bytes * n, n]
        cuts = 40 + np.cumsum([0, *sizes])
        part = [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = [x.view(f"<u{wide}") for x in part[:columns]]
        starts, places, large, middle = (x.view("<u4") for x in part[columns : columns + 4])
        return Shard(starts, middle, part[-2].view(f"<u{low_bytes}") if low_bytes else None, part[-1], places, large, rows)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its place)."""
        top = (keys >> np.uint64(64 - TOP)).astype(np.int64)
        want = (keys >> np.uint64(16)).astype(np.uint32)
        at, end, last = self.starts[top].astype(np.int64), self.starts[top + 1].astype(np.int64), len(self.middle) - 1
        to = end.copy()
        while (some := at < to).any():
            half = (at + to) >> 1
            less = some & (self.middle[np.minimum(half, last)] < want)
            at, to = np.where(less, half + 1, at), np.where(some & ~less, half, to)
        rest = keys & np.uint64(0xFFFF)
        found = np.zeros(len(keys), bool)
        look = np.flatnonzero(at < end)
        while len(look):  # of equal middles the one with the same end
            look = look[self.middle[at[look]] == want[look]]
            own = np.uint64(0) if self.low is None else self.low[at[look]].astype(np.uint64) << np.uint64(0 if self.low.itemsize == 2 else 8)
            hit = own == rest[look]
            found[look[hit]] = True
            look = look[~hit]
            at[look] += 1
            look = look[at[look] < end[look]]
        return found, at

    def columns(self, at: np.ndarray) -> list[np.ndarray]:
        row = self.small[at].astype(np.int64)
        more = np.flatnonzero(row == 255)
        if len(more):
            row[more] = self.large[np.searchsorted(self.places, at[more])]
        return [c[row].astype(np.int64) for c in self.rows]


@dataclass(frozen=True)
class Model:
    """path: the shared folder of shards; the totals of the training tokens. Tuples have one entry an order, from one on."""

    path: str
    order: int
    shards: int
    spread: int
    words: int  # numbers of words are below it, START and END included
    n: int  # training tokens
    v: int  # distinct
    texts: int
    bigrams: int  # distinct
    discounts: tuple[tuple[float, float, float], ...]
    word_kinds: tuple[int, int, int]  # words behind one, two, and more different words

    @property
    def bits(self) -> int:
        """That hold each word's number and the one that stands for unknown words."""
        return self.words.bit_length()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three; a half, one and one and a half where the counts of counts are empty."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def dealt(words: list[np.ndarray], counts: list[np.ndarray], shards: int, spread: int, bits: int):
    """(shard, its block of distinct grams with their counts added up) of grams and counts."""
    shard = gram_shard(words, shards, spread).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    sorting = packed(words)
    together = max(1, 64 // bits)
    keys = []
    for i in range(0, len(sorting), together):
        key = sorting[i]
        for c in sorting[i + 1 : i + together]:
            key = key << np.uint64(bits) | c
        keys.append(key)
    order = np.argsort(keys[-1])
    for key in [*keys[-2::-1], shard]:
        order = order[np.argsort(key[order], kind="stable")]
    new = np.ones(len(order), bool)
    shard = shard[order]
    new[1:] = shard[1:] != shard[:-1]
    for c in keys:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    sorting, shard = [c[order[first]] for c in sorting], shard[first]
    counts = [np.add.reduceat(c[order], first) if len(first) else c for c in counts]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, np.int64)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[a]), pack(*(c[a:z] for c in sorting), *(c[a:z] for c in counts))


def packed(words: list[np.ndarray]) -> list[np.ndarray]:
    """The order of columns in blocks: of a gram's words the last but one comes first, which is nearly constant in a shard."""
    return [*words[-2::-1], words[-1]] if len(words) > 1 else words


def unpacked(blobs: list[bytes], order: int, columns: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(words, counts) of blocks."""
    parts = [np.concatenate(x) for x in zip(*(unpack(b, "w" * order + "i" * columns) for b in blobs), strict=True)]
    return [*parts[: order - 1][::-1], parts[order - 1]], parts[order:]


def numbered(docs: DataFrame, path: str, shards: int) -> int:
    """Numbers the words of ``docs`` in files of hashes and ranks; one more than the largest number."""

    def count(batches):
        held, size = [], 0

        def merged():
            hashes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            _, hashes, counts = total(np.argsort(hashes), hashes, counts)
            return hashes, counts

        def blocks():
            hashes, counts = merged()
            held.clear()
            ends = np.searchsorted(word_shard(hashes, shards), np.arange(shards + 1))
            part = [(p, pack(hashes[a:z], counts[a:z])) for p, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["shard", "block"])

        for batch in batches:
            for _, texts in pieces(batch, "text"):
                hashes, counts = np.unique(tokens(texts)[0], return_counts=True)
                real = hashes != END
                held.append((hashes[real], counts[real]))
                size += len(held[-1][0])
                if size >= BLOCK:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size >= BLOCK // 2:
                        yield blocks()
                        size = 0
        if size:
            yield blocks()

    def rank(batches):
        for p, blobs in by_shard(batches):
            hashes, counts = (np.concatenate(x) for x in zip(*(unpack(b, "wi") for b in blobs), strict=True))
            _, hashes, counts = total(np.argsort(hashes), hashes, counts)
            ranks = np.empty(len(hashes), np.uint32)
            ranks[np.argsort(-counts, kind="stable")] = np.arange(len(hashes), dtype=np.uint32)
            put(f"{path}/words-{p}", hashes.astype("<u8").tobytes() + ranks.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([(len(hashes) - 1) * shards + p + 3], pa.int64())], ["most"])

    found = docs.select("text").mapInArrow(count, "shard int, block binary")
    most = found.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(rank, "most long").agg(F.max("most").alias("most")).first().most
    return most or 2


def by_shard(batches, sums=None):
    """(shard, its blocks), of rows in order of shard; adds up the rows' other columns."""
    now, held = None, []
    for b in batches:
        if sums is not None:
            sums += [pc.sum(b.column(i)).as_py() or 0 for i in range(2, 2 + len(sums))]
        for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(block)
    if held:
        yield now, held


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Learns grams of up to ``order`` words, two or more, from every row of ``docs``."""
    if order < 2:
        raise ValueError("the order has to be two or more")
    path = shared_dir(docs.sparkSession, "kneser-ney")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first().size
    need = max(SPREAD, -(-size // SHARD_TEXT))
    spread = max(SPREAD, math.isqrt(need))
    shards = -(-need // spread) * spread
    words_end = numbered(docs, path, shards)
    bits = words_end.bit_length()
    stats = [f"n{k}_{i}" for k in range(2, order + 1) for i in (1, 2, 3, 4)]  # grams of k words found i times

    def count(batches):
        held, size, number = [], 0, shards_of(path).numbering(shards, words_end)

        def blocks():
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            part = list(dealt(words, [np.ones(len(words[0]), np.int64)], shards, spread, bits))
            kinds = [pa.array(np.zeros(len(part), np.int64)) for _ in stats]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary()), *kinds], names)

        for batch in batches:
            for _, texts in pieces(batch, "text"):
                held.append(grams(*tokens(texts, number), order))
                size += len(held[-1][0])
                if size >= 2 * BLOCK // order:
                    yield blocks()
                    size = 0
        if size:
            yield blocks()

    def add(k):
        """Grams of k words, k above one, into a file, and what they say of shorter ones."""

        def run(batches):
            kinds = np.zeros(len(stats), np.int64)
            for p, blobs in by_shard(batches, kinds):
                words, counts = unpacked(blobs, k, 1 if k == order else 6)
                by = np.argsort(keys := gram_keys(words, bits))
                first, keys, *counts = total(by, keys, *counts)
                by = by[first]
                words = [w[by] for w in words]
                put(f"{path}/{k}-{p}", shard_file(keys, *counts[:5]))
                c, raw = counts[0], counts[0] if k == order else counts[5]
                kinds[4 * (k - 2) : 4 * (k - 1)] += [int((c == i).sum()) for i in (1, 2, 3, 4)]
                zero, real = np.zeros(len(c), np.int64), c > 0
                heads = [zero, c, *(x.astype(np.int64) for x in (c == 1, c == 2, c > 2)), raw if k == order else zero]
                tails = [real.astype(np.int64), zero, zero, zero, zero, zero if k == order else raw]
                for part in (dealt(words[:-1], heads, shards, spread, bits), dealt(words[1:], tails, shards, spread, bits)):
                    for q, block in part:
                        yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([block], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in kinds)], names)
                        kinds[:] = 0

        return run

    def add_words(batches):
        kinds = np.zeros(len(stats), np.int64)
        for q, blobs in by_shard(batches, kinds):
            words, counts = unpacked(blobs, 1, 6)
            by = np.argsort(keys := gram_keys(words, bits))
            first, keys, *counts = total(by, keys, *counts)
            w = words[0][by[first]]
            put(f"{path}/1-{q}", shard_file(keys, *counts))
            cont, raw = counts[0], counts[5]
            row = [int(raw.sum()), int((cont > 0).sum()), int(raw[w == START].sum()), int(cont.sum()), *(int((cont == i).sum()) for i in (1, 2, 3, 4)), int((cont > 2).sum()), *kinds.tolist()]
            kinds[:] = 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], [*totals, *stats])

    names = ["shard", "block", *stats]
    totals = ["n", "v", "texts", "bigrams", "c1", "c2", "c3", "c4", "more"]
    longs = lambda columns: ", ".join(f"{x} long" for x in columns)
    found = docs.select("text").mapInArrow(count, f"shard int, block binary, {longs(stats)}")
    at_shard = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    for k in range(order, 1, -1):
        found = at_shard(found).mapInArrow(add(k), found.schema)
    t = at_shard(found).mapInArrow(add_words, longs([*totals, *stats])).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in [*totals, *stats]]).first()
    less = [discounts(t.c1, t.c2, t.c3, t.c4), *(discounts(*(t[f"n{k}_{i}"] for i in (1, 2, 3, 4))) for k in range(2, order + 1))]
    return Model(path, order, shards, spread, words_end, t.n, t.v, t.texts, t.bigrams, tuple(less), (t.c1, t.c2, t.more))


class Shards:
    """The model's files, mapped when first asked for; of a store that is not mounted they are read into memory. The last
    MAPPED ones are held, so that neither mappings nor memory grow with the model."""

    def __init__(self, path: str):
        self.path, self.open = path, OrderedDict()

    def held(self, name: str, read):
        """What ``read`` makes of a file's bytes; None of a shard that has nothing."""
        if name in self.open:
            self.open.move_to_end(name)
        else:
            where = local_path(f"{self.path}/{name}")
            if where is None:
                store, inside = filesystem(f"{self.path}/{name}")
                data = None
                if store.get_file_info(inside).is_file:
                    with store.open_input_stream(inside) as src:
                        data = np.frombuffer(src.read(), np.uint8)
            else:
                data = np.asarray(np.memmap(where, np.uint8, "r")) if os.path.exists(where) else None
            self.open[name] = None if data is None else read(data)
            while len(self.open) > MAPPED:
                self.open.popitem(last=False)
        return self.open[name]

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """The columns of each key, zeros of one that is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        for p, part in parted(shard):
            found = self.held(f"{kind}-{p}", lambda data: Shard.of(data, columns))
            if found is None:
                continue
            hit, at = found.find(keys[part])
            for o, c in zip(out, found.columns(at[hit]), strict=True):
                o[part[hit]] = c
        return out

    def numbering(self, shards: int, unknown: int):
        """A function from word hashes to numbers."""

        def number(hashes: np.ndarray) -> np.ndarray:
            out = np.full(len(hashes), unknown, np.uint64)
            for p, part in parted(word_shard(hashes, shards)):
                found = self.held(f"words-{p}", lambda data: (data[: len(data) // 12 * 8].view("<u8"), data[len(data) // 12 * 8 :].view("<u4")))
                if found is None:
                    continue
                at = np.minimum(np.searchsorted(found[0], hashes[part]), len(found[0]) - 1)
                hit = found[0][at] == hashes[part]
                out[part[hit]] = found[1][at[hit]].astype(np.uint64) * np.uint64(shards) + np.uint64(p + 2)
            return out

        return number


def parted(shard: np.ndarray):
    """(shard, places that have it)."""
    order = np.argsort(shard.astype(np.uint16), kind="stable") if len(shard) and shard.max() < 1 << 16 else np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), part


_SHARDS: dict[str, Shards] = {}


def shards_of(path: str) -> Shards:
    """One a worker process and model. Named by a nested function, _SHARDS itself would be sent, empty, with every task."""
    if path not in _SHARDS:
        _SHARDS[path] = Shards(path)
    return _SHARDS[path]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of docs (doc_id, text, held_out)."""
    m = model

    def discount(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(c, 3)]

    def run(batches):
        shards = shards_of(m.path)
        number = shards.numbering(m.shards, m.words)
        rest = sum(k * d for k, d in zip(m.word_kinds, m.discounts[0], strict=True)) / m.bigrams if m.bigrams else 1.0
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                w, counts = tokens(texts, number)
                at = np.cumsum(counts) - counts
                words, keys = [w], gram_keys([w], m.bits)
                for k in range(1, m.order + 1):
                    # the key and words of the starts come last: the context of every text's first token
                    opening = gram_keys([np.array([START], np.uint64)] * k, m.bits)
                    names, first, which = distinct(np.append(keys, opening))
                    some = [np.append(x, np.uint64(START))[first] for x in words]
                    found = shards.find(str(k), gram_shard(some, m.shards, m.spread), names, 1 if k == m.order else 6 if k == 1 else 5)
                    here = which[:-1]
                    less, c = m.discounts[k - 1], found[0]
                    if k == 1:
                        c1 = np.where(some[0] == START, 0, np.where(some[0] == END, m.texts, found[5]))
                        prob = (np.maximum(c - discount(c, less), 0) / max(m.bigrams, 1) + rest / (m.v + 1))[here]
                        known, base = (c1 > 0)[here], np.log10((c1 + 0.1) / (m.n + 0.1 * (m.v + 1)))[here]
                    else:
                        seen = tot[context]
                        prob = np.where(seen > 0, np.maximum(c - discount(c, less), 0)[here] / np.maximum(seen, 1), 0) + back[context] * prob
                    if k < m.order:
                        _, tot, k1, k2, k3 = found[:5]
                        d = m.discounts[k]
                        back = np.where(tot > 0, (d[0] * k1 + d[1] * k2 + d[2] * k3) / np.maximum(tot, 1), 1.0)
                        context = before(here, counts, which[-1])
                        words = grams(w, counts, k + 1)
                        keys = gram_keys(words, m.bits) if k == 1 else pair_keys(names[context], w)
                add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(counts.astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(prob)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document, with its perplexity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    out = score(docs, model).withColumn("train_tokens", F.lit(model.n).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
