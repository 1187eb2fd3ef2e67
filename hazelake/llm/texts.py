"""Texts as compressed bytes in written tables, and concatenated texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazelake.llm.common import whole_text, written

PIECE = 1 << 20


def _compressed(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t.as_buffer()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["row", "doc_id", "packed"])


def packed_table(docs: DataFrame, name: str, column: str = "text") -> DataFrame:
    """(row, doc_id, packed): a row number of its own for each document, and its text compressed.

    Written once, so that row numbers stay what they are when tasks run again, and joins move less.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(column).alias("text"))
    return written(rows.mapInArrow(_compressed, "row long, doc_id long, packed binary"), name, compression="uncompressed")


def unpacked(column) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompressobj
    for value in column:
        yield unpack().decompress(value.as_py())


def groups(batches, size: int = PIECE) -> Iterator[list[tuple[int, bytes]]]:
    """Rows of (row, ..., packed) batches as lists of (row, text), of about ``size`` bytes or a long text alone."""
    group, held = [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), unpacked(batch.column(batch.num_columns - 1))):
            if group and held + len(text) > size:
                yield group
                group, held = [], 0
            group.append((row, text))
            held += len(text)
    if group:
        yield group


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum (``np.minimum``, ``np.maximum``) of each ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.concatenate([values, np.repeat(values[-1:], blocks * width - n)]).reshape(blocks, width)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n - width + 1], ahead[width - 1:n])
