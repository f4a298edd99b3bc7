"""Token-ID output: Parquet list columns in document order, read back selectively.

Texts are range-partitioned by id once; each task encodes its range and writes one file whose ids are
dictionary-encoded, with bounded row groups and pages and page indexes, so that a reader of few documents or of the
metadata alone touches few pages. A document's offset in the whole sequence is its offset in its part plus the sum
of the parts before, so no global order passes through one task.

Columns of documents that ``metadata`` names are kept beside the ids under the names m_0, m_1, ..., so that none can
clash; selected() gives them their own names back and reads the files as a query asks: row groups and pages by the
documents' ids, and the token column only if it is wanted.

Defined cases: a null text is empty and gives the end id alone; null ids come first; repeated ids keep the order of
their texts; an empty table gives an empty file set; a very long text is one list, encoded on its own; columns that are
not named as metadata are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.bpe import byte_encoder, pieces
from matchengine.llm.store import shared_dir

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}
STEP = 3_000_000  # bytes of text encoded at a time
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write(docs: DataFrame, out: str, tokenizer: str, end: int = 0, metadata: tuple[str, ...] = (), **writer: str) -> None:
    """Encodes (doc_id, text) and writes SCHEMA and the metadata below ``out``; part numbers rise with doc_id."""

    def encode(batches):
        part, at, encoder = TaskContext.get().partitionId(), 0, byte_encoder(tokenizer)
        for batch in batches:
            for rows, texts in pieces(batch, "text", STEP):
                ids, counts = encoder(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end).astype(np.int32)
                counts = counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(at + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        *(rows.column(2 + i) for i in range(len(metadata))),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids", *more],
                )
                at += int(offsets[-1])

    more = [f"m_{i}" for i in range(len(metadata))]
    kept = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(f"`{c}`").alias(m) for c, m in zip(metadata, more, strict=True)])
    schema = ", ".join([SCHEMA, *(f"{m} {kept.schema[m].dataType.simpleString()}" for m in more)])
    ranged = kept.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encode, schema).write.options(**{**WRITER, **writer}).parquet(out)


def read(spark, path: str) -> DataFrame:
    """SCHEMA with ``start``, the ids of all documents before, instead of the part's own."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row a file
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    # 16 bytes a file: thousands of files, however many rows; the ids are not shuffled again
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def selected(spark, path: str, ids: list[int] | None = None, metadata: dict[str, str] | None = None, tokens: bool = True) -> DataFrame:
    """doc_id, n_tokens, the metadata (names to types, in the order they were written) and, if wanted, ids: of all documents
    or of few ``ids``. The filter reaches the files' statistics, and columns that are not asked for are not read."""
    names = {f"m_{i}": (c, kind) for i, (c, kind) in enumerate((metadata or {}).items())}
    rows = spark.read.schema(", ".join([SCHEMA, *(f"{m} {kind}" for m, (_, kind) in names.items())])).parquet(path)
    rows = rows if ids is None else rows.filter(F.col("doc_id").isin(ids))
    return rows.select("doc_id", "n_tokens", *[F.col(m).alias(c) for m, (c, _) in names.items()], *(["ids"] if tokens else []))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of read()."""

    def crc(batches):
        for b in batches:
            lists = b.column(3)
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_ids(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The contract's digest, from the files."""
    import public_tokenizers

    out = shared_dir(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, path or public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read(spark, out))
