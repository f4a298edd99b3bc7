"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the bytes cuts every text where the content says so, so that texts with a passage in common have
chunks in common. Texts are dealt out by their smallest chunk hash, which brings near copies together; Spark splits
a partition that grows too large, at the price of encoding its chunks once in each part. A worker encodes a chunk
once and keeps the result in bounded memory. A word that two chunks share is joined and encoded anew, together with
its neighbours; where that wider encoding does not agree with the joined one, the whole text is encoded again.

Defined cases: a null text is empty and gives no tokens; repeated rows are encoded alike; special tokens' strings in
a text are special tokens, as the library has it; an empty table gives no rows; a null id stays null; a very long text
is cut into chunks like any other; columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.llm.bpe import MEMORY, pieces, tokenizer

MASK, LEAST, MOST = 1023, 256, 16384  # bytes of a chunk: about 1,300 on average
CHUNK_MEMORY = 40_000_000  # bytes of encoded chunks that a worker keeps
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint32)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Positions behind which a chunk may end: a hash of the 32 bytes before has its low bits clear."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        n = h.copy()
        n[k:] += h[:-k] << np.uint32(k)
        h = n
    return np.flatnonzero((h & np.uint32(MASK << 20)) == 0) + 1


def cut(data: np.ndarray, possible: list[int], start: int, end: int) -> list[int]:
    """The ends of the chunks of data[start:end], on character boundaries."""
    out, last = [], start

    def add(at: int) -> int:
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
        if at < end:
            out.append(at)
        return at

    for at in possible:
        while at - last > MOST:
            last = add(last + MOST)
        if at - last >= LEAST and at < end:
            last = add(at)
    while end - last > MOST:
        last = add(last + MOST)
    out.append(end)
    return out


def chunk_ends(texts: pa.Array) -> tuple[bytes, list[list[int]], np.ndarray]:
    """(all bytes, ends of the chunks of each text, starts of the texts)."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    possible = boundaries(data)
    at = np.searchsorted(possible, offsets, "right")
    cuts = [cut(data, possible[a:z].tolist(), int(s), int(e)) if e > s else [] for a, z, s, e in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)]
    return data.tobytes(), cuts, offsets


class ChunkEncoder:
    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        assert self.tokenizer.decoder is None, "made for tokenizers that decode by joining tokens with blanks"
        self.words: dict[str, tuple[str, str, int]] = {}
        self.chunks: dict[int, tuple] = {}
        self.size = 0

    def _entry(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids)

    def learn(self, words: list[str]) -> None:
        known = self.words
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = self._entry(e.ids)

    def encode_chunks(self, new: dict[int, str]) -> None:
        """Keeps, for each chunk: its first two and last two words, what lies between the first and the last, and
        whether white space begins and ends it."""
        texts = list(new.values())
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn(names)
        found = [self.words[w] for w in names]
        which = coded.indices.to_numpy().astype(np.int64)
        real = np.array([w != "" for w in names], bool)[which] if names else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        which = which[real]
        many = np.array([f[2] for f in found], np.int64)[which] if names else np.zeros(0, np.int64)
        inner = many > 0
        starts, stops = ends[:-1], ends[1:]
        some = stops > starts
        inner[starts[some]] = False
        inner[stops[some] - 1] = False
        sums = np.concatenate([[0], np.cumsum(inner)])[ends].astype(np.int32)
        total = np.concatenate([[0], np.cumsum(np.where(inner, many, 0))])[ends]
        joined = []
        for k in (0, 1):
            values = pc.take(pa.array([f[k] for f in found], pa.string()), pa.array(which[inner]))
            joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(sums), values), " ").to_pylist())
        for i, (key, text) in enumerate(new.items()):
            a, z = int(starts[i]), int(stops[i])
            if z == a:
                entry = (0, "", "", "", "", "", "", 0, True, True)
            else:
                w = lambda j: names[which[j]]  # noqa: E731, B023
                entry = (z - a, w(a), w(a + 1) if z - a > 1 else "", w(z - 2) if z - a > 1 else "", w(z - 1), joined[0][i], joined[1][i], int(total[i + 1] - total[i]), text[0] in " \t\n\r\x0b\x0c", text[-1] in " \t\n\r\x0b\x0c")
            self.chunks[key] = entry
            self.size += 300 + len(entry[5]) + len(entry[6])

    def __call__(self, texts: pa.Array) -> list[tuple[str, str, int]]:
        """(ids joined by blanks, decoded text, number of ids) of each text."""
        if len(self.words) > MEMORY:
            self.words = {}
        if self.size > CHUNK_MEMORY:
            self.chunks, self.size = {}, 0
        data, cuts, offsets = chunk_ends(texts)
        keys, new = [], {}
        for start, ends in zip(offsets[:-1].tolist(), cuts, strict=True):
            own = []
            for end in ends:
                part = data[start:end]
                key = xxhash.xxh3_128_intdigest(part)
                own.append(key)
                if key not in self.chunks and key not in new:
                    new[key] = part.decode()
                start = end
            keys.append(own)
        if new:
            self.encode_chunks(new)
        plans = [self.join([self.chunks[k] for k in own]) for own in keys]
        self.learn(list({w for plan, _ in plans for w in plan if w.__class__ is str}))
        windows = {}
        for i, (_, checks) in enumerate(plans):
            for words in checks:
                windows.setdefault(words, []).append(i)
        wrong = set()
        asked = list(windows)
        self.learn([w for words in asked for w in words])
        for words, e in zip(asked, self.tokenizer.encode_batch_fast([" ".join(w) for w in asked], add_special_tokens=False), strict=True):
            if " ".join(map(str, e.ids)) != " ".join([self.words[w][0] for w in words if self.words[w][2]]):
                wrong.update(windows[words])
        out = []
        for i, (plan, _) in enumerate(plans):
            if i in wrong:
                out.append(self._entry(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids))
                continue
            got = [self.words[w] if w.__class__ is str else w for w in plan]
            got = [g for g in got if g[2]]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum(g[2] for g in got)))
        return out

    @staticmethod
    def join(chunks: list[tuple]) -> tuple[list, list[tuple[str, ...]]]:
        """(words and encoded runs in order, word windows about the joins that have to be checked)."""
        plan, checks, pending, before = [], [], "", ""
        for many, first, second, penult, last, ids, decoded, n, blank_before, blank_after in chunks:
            if not many or blank_before:
                if pending:
                    plan.append(pending)
                head = first
            else:
                head = pending + first
                if pending:
                    checks.append(tuple(w for w in (before, head, second if many > 1 and (many > 2 or blank_after) else "") if w))
            pending = ""
            if not many:
                continue
            if many == 1:
                if blank_after:
                    plan.append(head)
                else:
                    pending = head
                continue
            plan += [head, (ids, decoded, n)]
            before = penult if many > 2 else head
            if blank_after:
                plan.append(last)
            else:
                pending = last
        if pending:
            plan.append(pending)
        return plan, checks


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One a worker process. Named by a nested function, _ENCODERS itself would be sent, empty, with every task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, nearby): dealt out by the smallest hash of a text's chunks."""

    def near(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                data, cuts, offsets = chunk_ends(texts)
                least = []
                for start, ends in zip(offsets[:-1].tolist(), cuts, strict=True):
                    best = 1 << 63
                    for end in ends:
                        best = min(best, xxhash.xxh3_64_intdigest(data[start:end]) >> 1)
                        start = end
                    least.append(best if best < 1 << 63 else 0)
                yield pa.RecordBatch.from_arrays([rows.column(0), texts, pa.array(least, pa.int64())], ["doc_id", "text", "nearby"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(near, "doc_id long, text string, nearby long").hint("rebalance", F.col("nearby"))


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array), decoded (text); with digests their SHA-256 instead."""

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                done = encoder(path)(texts)
                if digests:
                    ids, decoded = ([hashlib.sha256(d[k].encode()).hexdigest() for d in done] for k in (0, 1))
                    columns = [pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                else:
                    columns = [pa.array([list(map(int, d[0].split())) for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([d[2] for d in done], pa.int64()), *columns], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("string", "string") if digests else ("array<int>", "string")
    return clustered(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")


def op4_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The contract's digest of every document."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("word_bpe_49k.json"), digests=True)
