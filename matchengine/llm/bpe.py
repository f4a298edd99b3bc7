"""Byte-pair encoding of whole texts by way of their distinct words.

A text is cut before every blank that a character other than white space follows; no token of the tokenizers used
here spans such a cut, so the words' tokens in order are the text's. Words are found and numbered column-wise by
Arrow; the tokenizers library sees each distinct word once for as long as the bounded memory holds it.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WIDE_SPACE = "\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
IRREGULAR = f"[ ][\\t-\\r {WIDE_SPACE}]|[ ]$"
MEMORY = 300_000  # words, or pieces of words
# letters before U+0250, and marks that are neither letters, digits nor white space
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\x{24f}"
MARKS = "!-/:-@\\[-`{-~\\xa1-\\xa9\\xab\\xac\\xae-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf\\xd7\\xf7"
PARTS = f"^(?P<a> ?[{LETTERS}]+)(?P<b>[{MARKS}]*)(?:(?P<c>\\n)(?P<d>[{LETTERS}]+)(?P<e>[{MARKS}]*))?$"
# the characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
STEP = 6_000_000  # bytes of text worked on at a time


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(batch: pa.RecordBatch, text: str, step: int = STEP) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows with about ``step`` bytes of text; nulls are empty."""
    whole = batch.column(batch.schema.get_field_index(text))
    whole = pc.fill_null(whole.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + step)))
        yield batch.slice(at, to - at), whole.slice(at, to - at)
        at = to


def _shown(pieces: list[str]) -> list[str]:
    """Pieces without null characters as byte-level vocabularies write them."""
    return "\0".join(pieces).encode().decode("latin-1").translate(BYTES).split(BYTES[0]) if pieces else []


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist()


class PieceTable:
    """Token ids of pieces of words. Of words of letters, of letters and marks, and of two such parted by a line end,
    each run of letters or marks and the line end is a piece, which the library's model encodes without searching for
    it; any other word is one piece, encoded by the whole tokenizer. Beyond MEMORY pieces only those of the last call
    are kept."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.plain = True
        self._start([], np.zeros(0, np.int64), np.zeros(0, np.uint32))
        probe = pa.array([" the", "a", " \u00e9lan,", " Z\u00fcrich", "word.", " \u0101b!", " end.\nNew;", "\u00c9t\u00e9"])
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(probe.to_pylist(), add_special_tokens=False)]
        lengths, flat = self.ids(probe)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        hidden = pc.match_substring_regex(pa.array([*added, *(f"a{t}" for t in added)], pa.string()), PARTS)
        # a byte-level tokenizer that parts letters from marks and line ends, with no special token among such pieces
        self.plain = flat.tolist() == sum(whole, []) and lengths.tolist() == [len(w) for w in whole] and not any(hidden.to_pylist())
        self._start([], np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _start(self, names: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        """The table of these pieces, behind the empty one, which has no ids."""
        self.names = ["", *names]
        self.index = {w: i for i, w in enumerate(self.names)}
        self.lengths, self.flat = array("q", [0, *lengths.tolist()]), array("I", flat.astype("<u4").tobytes())
        self.last = np.zeros(0, np.int64)

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.lengths, np.int64), np.frombuffer(self.flat, np.uint32)

    def _forget(self) -> None:
        lengths, flat = self._arrays()
        kept = np.unique(self.last[self.last > 0])
        names, many, ids = [self.names[i] for i in kept], lengths[kept], spans(lengths, kept, flat)
        del lengths, flat
        self._start(names, many, ids)

    def _numbers(self, pieces: list[str], plain: bool) -> np.ndarray:
        """The pieces' numbers in the table; new ones are encoded."""
        index = self.index
        new = [w for w in pieces if w not in index]
        if plain and new:
            tokenize, lengths, flat = self.model.tokenize, self.lengths, self.flat
            for w in _shown(new):
                ids = [t.id for t in tokenize(w)]
                lengths.append(len(ids))
                flat.extend(ids)
        else:
            for at in range(0, len(new), 4096):
                for e in self.tokenizer.encode_batch_fast(new[at : at + 4096], add_special_tokens=False):
                    ids = e.ids
                    self.lengths.append(len(ids))
                    self.flat.extend(ids)
        index.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += new
        return np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        if len(self.names) > MEMORY:
            self._forget()
        which = np.zeros((5, len(words)), np.int64)
        parts = pc.extract_regex(words, PARTS)
        rest = parts.is_null().to_numpy(zero_copy_only=False) if self.plain else np.ones(len(words), bool)
        if not rest.all():
            coded = pa.concat_arrays([parts.field(k) for k in range(5)]).dictionary_encode()
            regular = np.tile(~rest, 5)
            numbers = self._numbers(_strings(coded.dictionary), True)
            which.reshape(-1)[regular] = numbers[coded.indices.to_numpy(zero_copy_only=False)[regular].astype(np.int64)]
        if rest.any():
            which[0, rest] = self._numbers(_strings(words.filter(pa.array(rest))), False)
        self.last = which[0]
        lengths, flat = self._arrays()
        pieces = which.T.ravel()
        return lengths[pieces].reshape(-1, 5).sum(1), spans(lengths, pieces, flat)


def spans(lengths: np.ndarray, which: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, whose runs have ``lengths``, one after the other."""
    starts, many = (np.cumsum(lengths) - lengths)[which], lengths[which]
    shift = starts - (np.cumsum(many) - many)
    return flat[np.repeat(shift, many) + np.arange(many.sum())]


class ByteEncoder:
    """For byte-level tokenizers that join a blank to the word behind it."""

    def __init__(self, path: str):
        self.table = PieceTable(path)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        odd = pc.match_substring_regex(texts, IRREGULAR)
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets, words = parts.offsets.to_numpy(), parts.flatten()
        offsets = offsets - offsets[0]
        heads = pc.take(words, pa.array(offsets[:-1])).dictionary_encode()
        tails = words.dictionary_encode()
        joined = pc.binary_join_element_wise(" ", tails.dictionary, "")
        which = tails.indices.to_numpy().astype(np.int64)
        which[offsets[:-1]] = heads.indices.to_numpy() + len(tails.dictionary)
        lengths, flat = self.table.ids(pa.concat_arrays([joined, heads.dictionary]))
        ids = spans(lengths, which, flat)
        counts = np.add.reduceat(lengths[which], offsets[:-1]) if len(which) else np.zeros(0, np.int64)
        if pc.any(odd).as_py():  # rare runs of blanks: such a text is encoded as a whole
            ends, out = np.cumsum(counts), []
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            whole = {int(r): np.array(e.ids, np.uint32) for r, e in zip(rows, self.table.tokenizer.encode_batch_fast(pc.take(texts, pa.array(rows)).to_pylist(), add_special_tokens=False), strict=True)}
            for r in range(len(counts)):
                out.append(whole[r] if r in whole else ids[ends[r] - counts[r] : ends[r]])
            ids, counts = np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return ids, counts


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One a worker process and path: it keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
