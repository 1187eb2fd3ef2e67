"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (each step shifts it by two bits, so it knows the last sixteen
bytes). A chunk ends where the hash is the largest among its neighbours on both sides: chunks are no shorter
than ``REACH`` bytes, and where they end depends on nearby bytes alone, so an insertion moves no boundary
further on. Stretches without such a place are cut every ``LONGEST`` bytes.

Chunks are deduplicated by digest over all texts. A repeated passage shows as neighbouring chunks that all occur
elsewhere; only runs of at least ``LEAST_RUN`` bytes count, because a short chunk may be a common phrase. In
such runs the first copy of a chunk (least doc_id, then row, then place) stays and the others go.

Nulls: a null text is empty; a null id comes before all others; repeated rows are copies of each other. Long texts
are read in pieces with a margin on both sides. Empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hazelake.llm import texts
from hazelake.llm.common import written

REACH = 24
LONGEST = 2048
LEAST_RUN = 64
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR_BYTES = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: the sum of the codes of the last bytes, shifted by their age."""
    h = GEAR[data]
    for back in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[back:] = h[:-back] << np.uint32(2 * back)
        h = h + moved
    return h


def local_cuts(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Ends of chunks (exclusive) by content; the first and last ``reach`` bytes hold none."""
    h = gear(data).astype(np.uint64)
    around = texts.sliding(h, 2 * reach + 1, np.maximum)
    peak = h[reach:len(h) - reach] == around
    # of equal values side by side none is a peak, and neither where the hash is not yet filled
    left = texts.sliding(h, reach, np.maximum)[:len(around)]
    right = texts.sliding(h, reach, np.maximum)[reach + 1:reach + 1 + len(around)]
    peak &= (h[reach:len(h) - reach] > left) & (h[reach:len(h) - reach] > right)
    found = np.flatnonzero(peak) + reach + 1
    return found[found > GEAR_BYTES + reach]


def cuts(text: bytes, reach: int = REACH, longest: int = LONGEST, piece: int = texts.PIECE) -> np.ndarray:
    """Ends of all chunks of a text."""
    margin = reach + GEAR_BYTES + 1
    data = np.frombuffer(text, np.uint8)
    found = []
    for at in range(0, len(data), piece):
        low, high = max(0, at - 2 * margin), min(len(data), at + piece + 2 * margin)
        here = local_cuts(data[low:high], reach) + low
        found.append(here[(here > at) & (here <= at + piece)])
    ends = np.unique(np.concatenate([*found, [len(data)]])).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    if (ends - starts <= longest).all():
        return ends
    return np.concatenate([np.r_[np.arange(a + longest, b, longest), b] for a, b in zip(starts, ends)])


def _chunked(reach: int, longest: int):
    names = ["digest", "row", "start", "size"]

    def run(batches):
        for batch in batches:
            out: Iterator = ([], [], [], [])
            for row, text in zip(batch.column(0).to_pylist(), texts.unpacked(batch.column(batch.num_columns - 1))):
                if not text:
                    continue
                ends = cuts(text, reach, longest)
                starts = np.r_[0, ends[:-1]]
                digests = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                for column, values in zip(out, (np.array(digests, np.uint64).view(np.int64), np.full(len(ends), row), starts, ends - starts)):
                    column.append(values)
            if out[0]:
                kinds = (np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(k)) for v, k in zip(out, kinds)], names=names)

    return run


def chunk_table(packed: DataFrame, reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """(digest, row, start, size) of every chunk, written."""
    chunks = packed.select("row", "packed").mapInArrow(_chunked(reach, longest), "digest long, row long, start int, size int")
    return written(chunks, "chunks", compression="zstd")


def _runs(least: int):
    """Repeated runs of each document from its repeated chunks."""
    names = ["row", "n_repeated", "n_removed", "spans"]

    def run(batches):
        for batch in batches:
            out = {n: [] for n in names}
            for row, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks.sort(key=lambda c: c["start"])
                groups: list[list[dict]] = []
                for c in chunks:
                    if groups and groups[-1][-1]["start"] + groups[-1][-1]["size"] == c["start"]:
                        groups[-1].append(c)
                    else:
                        groups.append([c])
                good = [g for g in groups if sum(c["size"] for c in g) >= least]
                spans: list[dict] = []
                for c in (c for g in good for c in g if not c["first"]):
                    if spans and spans[-1]["end"] == c["start"]:
                        spans[-1]["end"] += c["size"]
                    else:
                        spans.append({"start": c["start"], "end": c["start"] + c["size"]})
                out["row"].append(row)
                out["n_repeated"].append(sum(c["size"] for g in good for c in g))
                out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
                out["spans"].append(spans)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), span))], names=names)

    return run


def repeated_runs(packed: DataFrame, least: int = LEAST_RUN, reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """row, n_repeated, n_removed, spans (removed, in bytes) of documents that hold a repeated run."""
    chunks = chunk_table(packed, reach, longest)
    order = packed.select("row", "doc_id")
    # first copies are found by row number; rows are numbered in no order of ids, so ids decide among equal digests
    counted = chunks.groupBy("digest").agg(F.count("*").alias("n"))
    copies = chunks.join(counted.where("n > 1").select("digest"), "digest")
    placed = copies.join(order, "row")
    first = placed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id"), "row", "start")).alias("at"))
    marked = placed.join(first, "digest").select(
        "row", "start", "size", ((F.col("at.row") == F.col("row")) & (F.col("at.start") == F.col("start"))).alias("first")
    )
    grouped = marked.groupBy("row").agg(F.collect_list(F.struct("start", "size", "first")).alias("chunks"))  # of one document
    return grouped.mapInArrow(_runs(least), "row long, n_repeated long, n_removed long, spans array<struct<start:bigint,end:bigint>>").where("n_repeated > 0")


def deduplicated(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """Per document: doc_id, spans removed and kept (the bytes left)."""
    packed = texts.packed_table(docs, "packed", column)
    runs = repeated_runs(packed, **options).select("row", "spans")

    def cut(batches):
        for batch in batches:
            kept = []
            for spans, text in zip(batch.column(1).to_pylist(), texts.unpacked(batch.column(2))):
                at = [0, *[x for s in spans or () for x in (s["start"], s["end"])], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(at[::2], at[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])

    joined = packed.join(runs, "row", "left").select("doc_id", "spans", "packed")
    return joined.mapInArrow(cut, "doc_id long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def repeats(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """doc_id, n_repeated, n_removed, spans of the documents that share a passage with another place."""
    packed = texts.packed_table(docs, "packed", column)
    return repeated_runs(packed, **options).join(packed.select("row", "doc_id"), "row").select("doc_id", "n_repeated", "n_removed", "spans")
