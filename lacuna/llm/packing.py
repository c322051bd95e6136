"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / 1024) pieces of 1024 tokens and one piece for each set
bit of the rest, longest first.  Pieces of equal length form a bucket, and every piece is a
sequence of its own there: its length is a power of two, so nothing is padded and no sequence
crosses documents.

Defined cases: a null or empty text is the closing token alone (one piece of length 1); each row
is a document, so repeated rows (or a null doc_id) are packed once for each row; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, parts, table, texts
from ._tok import ByteEncoder, encoder

CONTEXT = 1024
END_ID = 0
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"
)


def cuts(n: int, context: int = CONTEXT) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; context is a power of two."""
    start = 0
    while n - start >= context:
        yield start, context
        start += context
    bit = context >> 1
    while bit:
        if (n - start) & bit:
            yield start, bit
            start += bit
        bit >>= 1


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, context: int = CONTEXT, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: where it lies in its document, its ids (unless ``keep_ids`` is off) and its sequence."""
    paths = paths or default_paths()

    def run(batches):
        one = encoder(ByteEncoder, *paths)
        for batch in (part for whole in batches for part in parts(whole)):
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(ids, texts(batch), strict=True):
                tokens = one.encode(text.decode()) + END_ID.to_bytes(4, "little")
                n = len(tokens) // 4
                for start, length in cuts(n, context):
                    part = tokens[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(part), n, length.bit_length() - 1, part if keep_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # each piece is one sequence of its bucket; its number is unique without any exchange of rows
    return mapped(made, run, _PIECES).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, context: int = CONTEXT) -> DataFrame:
    return pieces(docs, paths, context, keep_ids=False).drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
