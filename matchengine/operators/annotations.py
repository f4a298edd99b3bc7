"""Character spans in texts: what patterns find, the dictionary's skills by way of the folded text, degrees and a name."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.functions.batches import small
from matchengine.operators.offers import SPANS
from matchengine.operators.skills import Dictionary

# Words of degrees.
DEGREES = "master licence bachelor baccalauréat baccalaureat doctorat phd ingénieur ingenieur bts dut mba deug deust"
NAME_LINES = 30
NAME = regex.compile(r"\b\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+){1,2}\b")
TOKEN = re.compile(r"[a-z0-9#+](?:[a-z0-9#+.]*[a-z0-9#+])?")  # as functions.text.skill_tokens()


@functools.cache
def _folded(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()


def fold_with_places(text: str) -> tuple[str, np.ndarray]:
    """functions.text.fold() of a text, and for each of its characters the place of the one it comes from."""
    if text.isascii():
        return text.lower(), np.arange(len(text))
    parts = [_folded(c) for c in text]
    return "".join(parts), np.repeat(np.arange(len(text)), [len(p) for p in parts])


def skill_spans(text: str, trie) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place of the dictionary's aliases, in characters of the text itself."""
    folded, place = fold_with_places(text)
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(folded)]
    joined = " " + " ".join(folded[a:z] for a, z in tokens) + " "
    hits = [(end - size, n) for end, (n, size, _) in trie.iter(joined)] if trie is not None and tokens else []
    if not hits:
        return []
    blanks = np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 32)
    first = np.searchsorted(blanks, [at for at, _ in hits]).tolist()
    return [(int(place[tokens[i][0]]), int(place[tokens[i + n - 1][1] - 1]) + 1, "SKILL") for i, (_, n) in zip(first, hits, strict=True)]


def name_span(text: str) -> list[tuple[int, int, str]]:
    """The first two or three capitalised words in a row on one of the first lines."""
    at = 0
    for line in text.splitlines(keepends=True)[:NAME_LINES]:
        m = NAME.search(line)
        if m:
            return [(at + m.start(), at + m.end(), "PERSON_CANDIDATE")]
        at += len(line)
    return []


def apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that do not overlap: the earlier stays, of those with one start the longer."""
    out, end = [], 0
    for start, stop, label in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if start >= end and stop > start:
            out.append((start, stop, label))
            end = stop
    return out


def annotated(docs: DataFrame, known: Dictionary, id_: str = "doc_id", text: str = "text", patterns: dict[str, str] | None = None, names: bool = True) -> DataFrame:
    """(id, label, start, end, value): spans of the patterns, degrees, skills and the name's candidate, ends exclusive, none
    over another; value is the text from start to end. Null texts have none. The dictionary has to be one that is sent."""
    if known.sent is None:
        raise ValueError("the dictionary is too large to be sent to every task")
    sent = known.sent
    degrees = "|".join(DEGREES.split())
    given = {**SPANS, "DEGREE": rf"(?i)\b(?:{degrees})\b"} if patterns is None else patterns

    def run(batches):
        tests, trie = [(label, re.compile(p)) for label, p in given.items()], sent.value
        for b in small(batches):
            row, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                every = [(m.start(), m.end(), label) for label, p in tests for m in p.finditer(t)]
                for start, stop, label in apart([*every, *skill_spans(t, trie), *(name_span(t) if names else [])]):
                    row.append(i)
                    out.append((label, start, stop, t[start:stop]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_, "label", "start", "end", "value"])

    rows = docs.select(F.col(id_).cast("long").alias(id_), text)
    return rows.mapInArrow(run, f"{id_} long, label string, start int, end int, value string")
