"""Suffix-array removal of long repeated byte strings, with deep-shallow sorting.

Every window of ``length`` bytes chooses an anchor, the least hash of its ``K``-byte strings (the first of equal
ones), so equal windows choose alike. Neighbouring windows with one anchor form a segment. Only anchors that occur
twice or more go on. Segments found twice or more are repeats as a whole; where an anchor has different segments,
their windows' suffixes are sorted together: multikey sorting by eight-byte characters to a shallow depth, then
blind tries, which look at branching bytes only, order what is still together; leaves that agree over the whole
length are repeats. An anchor with very many different segments (a passage that a third of all texts share) is not
sorted in one task: its windows meet by a 128-bit hash, partly counted before they are shuffled.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; equal rows are copies of each other;
strings are judged on the input; an empty table gives no rows; other columns are kept by
deduplicated(), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.llm.bpe import pieces
from matchengine.llm.columns import renamed
from matchengine.llm.store import materialise

LENGTH = 200
K = 24
SHALLOW = 3  # characters of eight bytes sorted before the tries
CROWDED = 8000  # different segments of an anchor (1.4 million suffixes), beyond which its windows meet by hash
BLOCK = 400_000  # suffixes sorted at a time, or one anchor's
STEP = 1_000_000  # bytes whose anchors are sought at a time: about eighty bytes of memory each
MIX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; the same memory, seen at every offset."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data.tobytes() if not data.flags.c_contiguous else data.data, strides=(1,))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text's number, first window, last window, anchor's hash) of each segment of the texts data[starts:ends]."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    w = words_at(data).astype(np.uint64)
    n = len(data) - K + 1
    h = w[:n] * MIX[0]
    h ^= h >> np.uint64(29)
    h += w[8 : 8 + n] * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[2]
    h += w[16 : 16 + n] * MIX[3]
    h ^= h >> np.uint64(31)
    h *= MIX[1]
    h ^= h >> np.uint64(30)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    wide, width = length - K + 1, 1
    while 2 * width <= wide:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = wide - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    text = np.searchsorted(ends, np.arange(len(at)), "right")
    good = np.arange(len(at)) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new & good)
    last = np.append(np.flatnonzero(new[1:]), len(at) - 1)  # ends of all runs
    last = last[np.searchsorted(last, first)]
    last = np.minimum(last, ends[text[first]] - length)
    return text[first], first, last, h[at[first]]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _found(data: np.ndarray, offsets: np.ndarray, length: int):
    """anchors() of texts data[offsets], some STEP bytes at a time; a longer text's last segment of a step ends there."""
    if len(data) <= 2 * STEP:
        yield anchors(data, offsets[:-1], offsets[1:], length)
        return
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, z - length + 1), STEP):
            part = data[at : min(z, at + STEP + length - 1)]
            number, first, last, kmer = anchors(part, np.zeros(1, np.int64), np.array([len(part)]), length)
            yield number + i, first + at, last + at, kmer


def segments(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """(kmer, seg, doc_id, tag, lo, hi) of every segment; without ``whole`` the kmer alone."""

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "text", STEP):
                yield from of_texts(rows, *_bytes(texts))

    def of_texts(rows, data, offsets):
        # empty texts share an end with the one before; searchsorted on the right end passes them over
        for number, first, last, kmer in _found(data, offsets, length):
            kmers = pa.array(kmer.view(np.int64))
            if not whole:
                yield pa.RecordBatch.from_arrays([kmers], ["kmer"])
                continue
            body = data.tobytes()
            seg = np.fromiter((xxhash.xxh3_64_intdigest(body[a : z + length], (z - a)) for a, z in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
            base, index = offsets[:-1][number], pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [kmers, pa.array(seg.view(np.int64)), rows.column(0).take(index), rows.column(2).take(index), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                ["kmer", "seg", "doc_id", "tag", "lo", "hi"],
            )

    return docs.mapInArrow(run, "kmer long, seg long, doc_id long, tag long, lo int, hi int" if whole else "kmer long")


def same_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the suffixes at ``at`` agree over ``length`` bytes with another of their group."""
    words = words_at(data)
    out = np.zeros(len(at), bool)
    live, gid = np.arange(len(at)), group.astype(np.int64)

    def split(keys: np.ndarray) -> None:
        """Sorts what is live by group and key, numbers the new groups, lets go of what is alone."""
        nonlocal live, gid
        order = np.lexsort((keys, gid))
        live, gid, keys = live[order], gid[order], keys[order]
        new = np.append(True, (gid[1:] != gid[:-1]) | (keys[1:] != keys[:-1])) if len(live) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(live) else new
        live, gid = live[keep], number[keep]

    for depth in range(min(SHALLOW, length // 8)):
        split(words[at[live] + 8 * depth].astype(np.uint64))
        if not len(live):
            return out
    while len(live):
        start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        size = np.diff(np.append(start, len(gid)))
        first = np.repeat(live[start], size)
        common = np.full(len(live), length)  # bytes in which each agrees with its group's first
        open_ = np.arange(len(live))
        for depth in range(0, length, 8):
            width = min(8, length - depth)
            where = at[live[open_]] + depth + width - 8, at[first[open_]] + depth + width - 8
            differ = words[where[0]].astype(np.uint64) ^ words[where[1]].astype(np.uint64)
            apart = differ != 0
            if apart.any():
                high = differ[apart]
                byte = np.stack([(high >> np.uint64(8 * (7 - j))) & np.uint64(255) for j in range(8)], 1) != 0
                common[open_[apart]] = depth + width - 8 + byte.argmax(1)
                open_ = open_[~apart]
            if not len(open_):
                break
        branch = np.repeat(np.minimum.reduceat(common, start), size)
        done = branch >= length
        out[live[done]] = True
        live, gid, branch = live[~done], gid[~done], branch[~done]
        split(data[at[live] + branch].astype(np.uint64))
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def sort_segments(length: int):
    """Of (kmer, doc_id, tag, lo, alone, data) in order of kmer: (doc_id, tag, lo, hi), runs of windows that repeat."""

    def judge(table: pa.Table):
        kmer = table.column("kmer").to_numpy()
        bodies = table.column("data").to_pylist()
        data = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        begin, many = np.cumsum(sizes) - sizes, sizes - length + 1
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        flags = same_suffixes(data, at, np.repeat(np.cumsum(np.append(0, kmer[1:] != kmer[:-1])), many), length)
        ids, tags, lows, alone = (table.column(c).to_pylist() for c in ("doc_id", "tag", "lo", "alone"))
        out, z = [], 0
        for i, n in enumerate(many.tolist()):
            if alone[i]:
                out += [(ids[i], tags[i], lows[i] + a, lows[i] + b) for a, b in runs(flags[z : z + n])]
            z += n
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tag", "lo", "hi"])

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) * 150 < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            kmer = table.column("kmer").to_numpy()
            cut = int(np.flatnonzero(np.append(True, kmer[1:] != kmer[:-1]))[-1])  # the last anchor may go on
            at, step = 0, max(1, BLOCK // 150)
            change = np.append(np.flatnonzero(kmer[1:] != kmer[:-1]) + 1, len(kmer))
            while at < cut:
                to = min(cut, int(change[min(len(change) - 1, np.searchsorted(change, at + step))]))
                yield judge(table.slice(at, to - at))
                at = to
            held = table.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield judge(pa.Table.from_batches(held))

    return run


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """As sort_segments() for anchors with very many segments: windows meet by a 128-bit hash."""

    def windows(batches):
        for b in batches:
            for r in b.to_pylist():
                n = len(r["data"]) - length + 1
                h = [xxhash.xxh3_128_digest(r["data"][i : i + length]) for i in range(n)]
                two = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array([r["doc_id"]] * n, pa.int64()), pa.array([r["tag"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32) + r["lo"]), pa.array([r["alone"]] * n)],
                    ["h1", "h2", "doc_id", "tag", "lo", "alone"],
                )

    every = rows.mapInArrow(windows, "h1 long, h2 long, doc_id long, tag long, lo int, alone boolean")
    twice = every.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    return every.filter("alone").join(twice, ["h1", "h2"]).select("doc_id", "tag", "lo", F.col("lo").alias("hi"))


def _key(docs: DataFrame) -> DataFrame:
    """doc_id (a null as the least long), text, tag: tells texts with one id apart; equal rows are judged alike."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text", tag("text").alias("tag"))


def tag(text: str) -> Column:
    return F.xxhash64(F.col(text))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, spans): for each text with repeats, the runs (lo, hi) of window starts that repeat."""
    keyed = _key(docs)
    # written first: Spark splits a hot anchor's rows in a join only where no aggregate stands between shuffle and join
    twice = materialise(segments(keyed, length, False).groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1").select("kmer"), "anchors")
    found = materialise(segments(keyed, length, True).join(twice, "kmer", "left_semi"), "segments")
    kinds = found.groupBy("kmer", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "lo", "hi")).alias("one"))
    kinds = materialise(kinds, "kinds")
    copies = found.join(kinds.filter("n > 1").select("kmer", "seg"), ["kmer", "seg"], "left_semi").select("doc_id", "tag", "lo", "hi")
    mixed = kinds.groupBy("kmer").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("kmer", "c")
    asked = kinds.join(mixed, "kmer").select("one.doc_id", "one.tag", F.struct("kmer", "one.lo", "one.hi", (F.col("n") == 1).alias("alone"), (F.col("c") > CROWDED).alias("crowded")).alias("s"))
    asked = asked.groupBy("doc_id", "tag").agg(F.collect_list("s").alias("s"))

    def fetch(batches):
        for b in batches:
            for text, d, t, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                body = (text or "").encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["kmer"] for x in s], pa.int64()), pa.array([d] * len(s), pa.int64()), pa.array([t] * len(s), pa.int64()), pa.array([x["lo"] for x in s], pa.int32()),
                        pa.array([x["alone"] for x in s]), pa.array([x["crowded"] for x in s]), pa.array([body[x["lo"] : x["hi"] + length] for x in s], pa.binary()),
                    ],
                    ["kmer", "doc_id", "tag", "lo", "alone", "crowded", "data"],
                )

    once = keyed.join(asked, ["doc_id", "tag"]).select("text", "doc_id", "tag", "s").mapInArrow(fetch, "kmer long, doc_id long, tag long, lo int, alone boolean, crowded boolean, data binary")
    bodies = materialise(once, "bodies")
    sorted_ = bodies.filter("not crowded").repartition("kmer").sortWithinPartitions("kmer").select("kmer", "doc_id", "tag", "lo", "alone", "data").mapInArrow(sort_segments(length), "doc_id long, tag long, lo int, hi int")
    every = copies.union(sorted_).union(_crowded(bodies.filter("crowded"), length))
    return materialise(every.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")


def covered(size: int, spans: list, length: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a window that repeats."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        at = np.array([(s["lo"], s["hi"] + length) for s in spans])
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` as renamed() does, with ``spans``."""
    inner, names = renamed(docs)
    own = inner.withColumn("_d", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(-(1 << 63)))).withColumn("_g", tag(names["text"]))
    found = repeats(docs, length).select(F.col("doc_id").alias("_fd"), F.col("tag").alias("_fg"), "spans")
    return own.join(found, (F.col("_d") == F.col("_fd")) & (F.col("_g") == F.col("_fg")), "left").drop("_d", "_g", "_fd", "_fg")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without the bytes that repeat; of a character cut in two the rest goes as well. n_chars is counted anew."""
    inner, own = renamed(docs)
    names, text_ = list(own.values()), own["text"]

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(text_).to_pylist(), b.column("spans").to_pylist(), strict=True):
                if spans:
                    body = np.frombuffer(text.encode(), np.uint8)
                    text = body[~covered(len(body), spans, length)].tobytes().decode(errors="ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_ else b.column(c) for c in names], names)

    out = _with_spans(docs, length).mapInArrow(run, inner.schema)
    return out.select(*[(F.length(text_).cast("long") if n == "n_chars" else F.col(c)).alias(n) for n, c in own.items()])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = np.frombuffer((text or "").encode(), np.uint8)
                if not spans:
                    out.append((len(body), 0, 0, hashlib.sha256(body.tobytes()).hexdigest()))
                    continue
                gone = covered(len(body), spans, LENGTH)
                out.append((len(body), int(gone.sum()), len(runs(gone)), hashlib.sha256(body[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, LENGTH).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
