"""Exact substring dedup over run-length indexes.

Bytes covered by a window of ``WIDTH`` bytes that also starts elsewhere are removed. One index over all
texts would be one task's work, so windows are dealt out by content: each belongs to its anchor, the short
string inside it whose hash is least. Equal windows have equal anchors, so they meet. The windows of one
anchor in a row form a segment of the text.

1. Segments are counted by (anchor, digest). All of a segment that occurs twice is repeated; one of the
   copies stands for them from here on.
2. Where an anchor has different segments, their texts are fetched and go to a run-length index
   (``rindex``), which marks the windows that they share. Indexes take some megabytes each.
3. An anchor with more text than that is split: windows are dealt anew by their offset from the anchor and
   the bytes that all windows with such offsets have in common, in ever narrower classes. At the last one
   the whole window is the key, so any group gets small, with nothing left out.

Removed bytes are the union of the repeated windows, judged on the input. Segments are compared by 64-bit
digests under 64-bit anchors.

Nulls: a null text is empty; a null id is a value like any other, repeated rows are copies of each other.
Texts shorter than a window have nothing removed; long ones are read in overlapping pieces. Empty tables give
no rows, further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hazelake.llm import texts
from hazelake.llm.common import written
from hazelake.llm.rindex import RunIndex, ranges

WIDTH = 400
GRAM = 32
GROUP_BYTES = 1 << 20
#: rows of a key that one task may get in any case, and the share of all rows beyond that
HEAVY = 1000
#: one string of ``GRAM`` bytes is noted among so many that start in a row
NOTED = 160
INDEX_BYTES = 1 << 21
#: positions of a piece fit the low bits of a sort key
PLACE_BITS = 22


class Anchors:
    """Windows of a buffer in segments that share an anchor."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        rng = np.random.default_rng(20_24)
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int):
        if len(self.powers) <= n:
            size = max(n + 1, texts.PIECE + 2 * self.width)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse)], dtype=np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each ``gram`` bytes."""
        n = len(data)
        self._grow(n)
        sums = np.r_[np.uint64(0), np.cumsum(self.codes[data] * self.powers[:n], dtype=np.uint64)]
        h = (sums[self.gram:] - sums[:-self.gram]) * self.inverses[:n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def noted(self, data: np.ndarray, ends: np.ndarray, among: int) -> np.ndarray:
        """Places of the strings with the least hash among ``among`` that start in a row and stay inside a text."""
        if len(data) < self.gram + among - 1:
            return np.zeros(0, dtype=np.int64)
        h = self.hashes(data)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = texts.sliding(h & ~low | np.arange(len(h), dtype=np.uint64), among, np.minimum)
        starts = np.r_[0, ends[:-1]]
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        long = ends - starts >= self.gram + among - 1
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - self.gram - among + 2, -1)
        held = least[np.cumsum(inside)[:len(least)] > 0]
        return np.unique((held & low).astype(np.int64))

    def segments(self, data: np.ndarray, ends: np.ndarray):
        """(first window, last window, anchor place, anchor hash) of texts that end at ``ends`` in ``data``."""
        if len(data) > 1 << PLACE_BITS:
            raise ValueError(f"{len(data)} bytes in one buffer, places are of {PLACE_BITS} bits")
        if len(data) < self.width:
            return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
        h = self.hashes(data)
        low = np.uint64((1 << PLACE_BITS) - 1)
        keyed = h & ~low | np.arange(len(h), dtype=np.uint64)
        place = (texts.sliding(keyed, self.width - self.gram + 1, np.minimum) & low).astype(np.int64)
        n = len(place)
        starts = np.r_[0, ends[:-1]]
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        long = ends - starts >= self.width
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - self.width + 1, -1)
        valid = np.cumsum(inside)[:n] > 0
        change = np.r_[True, place[1:] != place[:-1]]
        first = np.flatnonzero(valid & (change | ~np.r_[False, valid[:-1]]))
        last = np.flatnonzero(valid & (np.r_[change[1:], True] | ~np.r_[valid[1:], False]))
        return [first, last, place[first], h[place[first]]]


def _pieces(rows: list[tuple[int, bytes]], width: int):
    """(rows, offsets in the texts, buffer, ends): texts side by side, or pieces of a long one."""
    if len(rows) > 1 or len(rows[0][1]) <= texts.PIECE:
        sizes = np.array([len(t) for _, t in rows], dtype=np.int64)
        yield [r for r, _ in rows], np.zeros(len(rows), dtype=np.int64), b"".join(t for _, t in rows), np.cumsum(sizes)
        return
    (row, text), = rows
    for at in range(0, max(1, len(text) - width + 1), texts.PIECE):
        part = text[at:at + texts.PIECE + width - 1]
        yield [row], np.array([at]), part, np.array([len(part)])


def _digest(part: bytes) -> int:
    return xxhash.xxh3_64_intdigest(part)


def _anchored(width: int, gram: int, among: int = NOTED):
    names = ["key", "digest", "row", "first", "last", "anchor"]

    def run(batches):
        anchors = Anchors(width, gram)
        for group in texts.groups(batches):
            for rows, offsets, data, ends in _pieces(group, width):
                buffer = np.frombuffer(data, np.uint8)
                places = anchors.noted(buffer, ends, among)
                if len(places):
                    own = np.array(rows)[np.searchsorted(ends, places, side="right")]
                    none = np.full(len(places), -1, dtype=np.int64)
                    columns = [anchors.hashes(buffer)[places].view(np.int64), none, own, none, none, none]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                first, last, place, h = anchors.segments(buffer, ends)
                if not len(first):
                    continue
                doc = np.searchsorted(ends, first, side="right")
                starts = np.r_[0, ends[:-1]] - offsets
                digests = np.array([_digest(data[a:b]) for a, b in zip(first.tolist(), (last + width).tolist())], dtype=np.uint64)
                move = starts[doc]
                columns = [h.view(np.int64), digests.view(np.int64), np.array(rows)[doc], *[(x - move).astype(np.int64) for x in (first, last, place)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


_SEGMENT = "key long, digest long, row long, first long, last long, anchor long"


def matched(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among ``wanted`` (keys and ``n``, the rows that have them).

    Keys of over a thousandth of the rows, of which there are less than a thousand, are looked up where the rows
    are; so no task gets more than a thousandth for one key.
    """
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = wanted.where(F.col("n") > max(HEAVY, total // HEAVY)).select(*keys)
    light = wanted.where(F.col("n") <= max(HEAVY, total // HEAVY)).select(*keys)
    rest = rows.join(F.broadcast(heavy), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys, "left_semi").unionByName(rest.join(light, keys, "left_semi"))


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of all segments that occur twice; one of each segment whose key has different ones."""
    place = F.struct("row", "first", "last", "anchor")
    counted = written(rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(place).alias("one")), "segment-counts")
    marks = matched(rows, counted.where("n > 1").select("key", "digest", "n"), ["key", "digest"]).select("row", "first", "last")
    mixed = counted.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return marks, counted.join(mixed, "key", "left_semi").select("key", "digest", "one.*")


def _cut(width: int):
    """Segments of the documents in (row, places, packed)."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("key", "row", "first", "last", "anchor", "text")}
            for row, places, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.unpacked(batch.column(2))):
                for p in places:
                    out["row"].append(row)
                    out["text"].append(text[p["first"]:p["last"] + width])
                    for n in ("key", "first", "last", "anchor"):
                        out[n].append(p[n])
            kinds = {"text": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=list(out))

    return run


def _narrower(width: int, classes: int):
    """Segments of hot keys cut into classes of offsets from the anchor, each with a longer key."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("key", "digest", "row", "first", "last", "anchor", "text")}
            for s in batch.to_pylist():
                low, high = s["anchor"] - s["last"], s["anchor"] - s["first"]
                for c in range(low // classes, high // classes + 1):
                    a, b = max(low, c * classes), min(high, (c + 1) * classes - 1)
                    first, last = s["anchor"] - b, s["anchor"] - a
                    text = s["text"][first - s["first"]:last - s["first"] + width]
                    # every window of the class has these bytes: from its latest start to its earliest end
                    latest = s["anchor"] - c * classes - s["first"]
                    common = s["text"][latest:latest + width - classes + 1]
                    key = xxhash.xxh3_64_intdigest(common, (s["key"] ^ c) & 0xFFFFFFFFFFFFFFFF)
                    for n, v in zip(out, (_signed(key), _signed(_digest(text)), s["row"], first, last, s["anchor"], text)):
                        out[n].append(v)
            kinds = {"text": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=list(out))

    return run


def _indexed(width: int):
    """Marks of the windows shared by different segments; rows come sorted by key."""

    def marks(rows: list[tuple]):
        found = {"row": [], "first": [], "last": []}
        for (_, row, first, _), flags in zip(rows, RunIndex([r[3] for r in rows]).repeated(width)):
            for a, b in ranges(flags):
                found["row"].append(row)
                found["first"].append(first + int(a))
                found["last"].append(first + int(b))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "row", "first", "text")]):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield marks(held)

    return run


def noted_elsewhere(rows: DataFrame) -> DataFrame:
    """(row, n_shared): noted strings of a text that are noted in another text too."""
    noted = rows.where("first < 0").select("key", "row")
    met = written(noted.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("key", "n"), "shared")
    return matched(noted, met, ["key"]).groupBy("row").agg(F.count("*").alias("n_shared"))


def marked(packed: DataFrame, width: int = WIDTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, among: int = NOTED) -> tuple[DataFrame, DataFrame]:
    """(row, first, last): first to last of window starts that are repeated, which may overlap; and ``noted_elsewhere``."""
    both = written(packed.select("row", "packed").mapInArrow(_anchored(width, gram, among), _SEGMENT), "segments", compression="zstd")
    rows, shared = both.where("first >= 0"), noted_elsewhere(both)
    marks, ones = _settled(rows)
    found = [written(marks, "marks")]
    places = ones.groupBy("row").agg(F.collect_list(F.struct("key", "first", "last", "anchor")).alias("places"))  # of one document
    fetched = places.join(packed.select("row", "packed"), "row").select("row", "places", "packed")
    groups = written(fetched.mapInArrow(_cut(width), "key long, row long, first long, last long, anchor long, text binary"), "groups", compression="zstd")
    classes = width - gram + 1
    while True:
        sizes = groups.groupBy("key").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("n"))
        hot = sizes.where((F.col("bytes") > group_bytes) & (F.col("n") > 1))
        fit = groups.join(hot.select("key"), "key", "left_anti")
        dealt = fit.select("key", "row", "first", "text").repartition("key").sortWithinPartitions("key")
        found.append(written(dealt.mapInArrow(_indexed(width), "row long, first long, last long"), "marks"))
        if classes == 1 or hot.isEmpty():
            break
        classes = -(-classes // 2)
        columns = "key long, digest long, row long, first long, last long, anchor long, text binary"
        split = groups.join(hot.select("key"), "key", "left_semi").mapInArrow(_narrower(width, classes), columns)
        split = written(split, "groups", compression="zstd")
        marks, ones = _settled(split)
        found.append(written(marks, "marks"))
        same = ["key", "digest", "row", "first"]
        groups = written(split.join(ones.select(*same), same, "left_semi").drop("digest"), "groups", compression="zstd")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, shared


def removed(spans: list[dict], width: int) -> list[tuple[int, int]]:
    """The union of windows as (start, end) of bytes."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + width)
        else:
            out.append([first, last + width])
    return [(a, b) for a, b in out]


def _kept(width: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_shared", "spans", "kept"]

    def run(batches):
        for batch in batches:
            out = {n: [] for n in names}
            for doc, spans, shared, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)], texts.unpacked(batch.column(3))):
                gone = removed(spans, width)
                cuts = [0, *[x for span in gone for x in span], len(text)]
                out["doc_id"].append(doc)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["n_shared"].append(shared or 0)
                out["spans"].append([{"start": a, "end": b} for a, b in gone])
                out["kept"].append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=names)

    return run


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, column: str = "text", group_bytes: int = GROUP_BYTES, among: int = NOTED) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_shared, spans (removed runs, in bytes), kept (the bytes left).

    ``n_shared`` tells of repeats too short to be removed: of any ``gram + among - 1`` bytes in a row at least one string of
    ``gram`` bytes is noted, by its hash, and those count that another document has noted too.
    """
    packed = texts.packed_table(docs, "packed", column)
    marks, shared = marked(packed, width, gram, group_bytes, among)
    spans = marks.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one document
    joined = packed.join(spans, "row", "left").join(shared, "row", "left").select("doc_id", "spans", "n_shared", "packed")
    return joined.mapInArrow(_kept(width), "doc_id long, n_bytes long, n_removed long, n_shared long, spans array<struct<start:bigint,end:bigint>>, kept binary")
