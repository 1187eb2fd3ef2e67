"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits of each other agree in at least one of ``radius + 1`` blocks of bits, so
distinct fingerprints meet by block value. A block value that few share is one tile. One that many share is cut
into tiles by population count (and hash); a pair of tiles is compared only if their counts differ by no more
than the radius. Comparison is numpy exclusive-or and bit counts. A task returns a spanning forest of the links
it finds, never all pairs; forests of all tiles are joined into components.

Only distinct fingerprints travel, so any number of exact copies counts once. No link is lost: every pair within
the radius shares a block value, and tiles that are left out cannot hold such a pair.

Nulls: a null text has no words and the fingerprint zero, linked like any other. A null id is never the least of
a component unless all ids of it are null; then the component is null. Repeated rows are all returned. Long texts
are hashed whole, in pieces. Further columns are ignored by ``near_duplicates``, kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hazelake.llm.common import free_name, whole_text, written
from hazelake.llm.graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
TILE = 1024
SHORT = 16
PIECE = 1 << 21


# ------------------------------------------------------------------ fingerprints
def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time: pieces end at a blank."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of word shingles, repeats included."""
    hash_of, n, ones, left = xxhash.xxh64_intdigest, 0, np.zeros(BITS, dtype=np.int64), []
    for words in _word_lists(text.encode().lower()):
        words = left + words
        joined = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
        hashes = np.array([hash_of(s, SEED) for s in joined], dtype="<u8")
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        left = words[-(shingle - 1):] if shingle > 1 else []
    if n == 0:
        if not left:
            return 0
        return hash_of(b" ".join(left), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, column: str = "text") -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(column).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long")


# ------------------------------------------------------------------ tiles
def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks that cover all bits."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def tiles(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(pair, side, fp): the members of every pair of tiles to compare; side 0 if both are the same tile."""
    fp = F.col("fp")
    value = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(m)).alias("value")) for k, (a, m) in enumerate(_blocks(radius))]
    keyed = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*value)).alias("k")).select("fp", "ones", "k.block", "k.value")
    by_ones = keyed.groupBy("block", "value", "ones").agg(F.count("*").alias("n"))
    shared = by_ones.groupBy("block", "value").agg(F.sum("n").alias("all")).where("all > 1")
    met = keyed.join(shared, ["block", "value"])
    small = met.where(F.col("all") <= tile).select(F.xxhash64("block", "value").alias("pair"), F.lit(0).alias("side"), "fp")
    cuts = by_ones.join(shared.where(F.col("all") > tile), ["block", "value"]).select(
        "block", "value", "ones", F.ceil(F.col("n") / tile).alias("tiles")
    )
    own = met.where(F.col("all") > tile).join(cuts, ["block", "value", "ones"])
    own = own.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    near = own.withColumn("other_ones", F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius)))
    others = cuts.select("block", "value", F.col("ones").alias("other_ones"), F.col("tiles").alias("other_tiles"))
    pairs = near.join(others, ["block", "value", "other_ones"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_tiles") - 1))
    )
    mine, its = F.struct("ones", "tile"), F.struct(F.col("other_ones").alias("ones"), F.col("other").alias("tile"))
    large = pairs.select(
        F.xxhash64("block", "value", F.least(mine, its), F.greatest(mine, its)).alias("pair"),
        F.when(mine == its, 0).when(mine < its, 1).otherwise(2).alias("side"), "fp",
    )
    return small.unionByName(large)


def _forest(fps: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and the least member that each is linked to, over a symmetric matrix of links."""
    label = np.arange(len(fps))
    while True:
        least = np.where(linked, label, len(fps)).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            moved = np.flatnonzero(label != np.arange(len(fps)))
            return fps[moved], fps[label[moved]]
        label = least


def linked_in(pair: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int):
    """Links among rows sorted by pair, as forests."""
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    sizes = np.diff(np.r_[starts, len(pair)])
    short = np.repeat(sizes <= SHORT, sizes)
    for d in range(1, min(SHORT, int(sizes.max()))):
        both = np.flatnonzero((pair[d:] == pair[:-d]) & short[d:])
        near = both[np.bitwise_count(fps[both] ^ fps[both + d]) <= radius]
        if len(near):
            yield fps[near], fps[near + d]
    for at, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        own, of = fps[at:at + size], side[at:at + size]
        ones = np.bitwise_count(own)
        if int(ones.max()) - int(ones.min()) > radius:
            order = np.argsort(ones, kind="stable")
            own, of, ones = own[order], of[order], ones[order]
        near = np.zeros((size, size), dtype=bool)
        for a in range(0, size, 256):
            for b in range(0, size, 256):
                x, y = slice(a, a + 256), slice(b, b + 256)
                if ones[y][0] > ones[x][-1] + radius or ones[x][0] > ones[y][-1] + radius:
                    continue
                near[x, y] = np.bitwise_count(own[x, None] ^ own[None, y]) <= radius
        if (of != 0).any() and not (of == 0).any():
            near &= of[:, None] != of[None, :]
        np.fill_diagonal(near, False)
        if near.any():
            yield _forest(own, near)


def _links(radius: int):
    names = ["a", "b"]

    def emit(rows: pa.Table):
        pair, side = rows.column("pair").to_numpy(), rows.column("side").to_numpy()
        fps = rows.column("fp").to_numpy().view(np.uint64)
        for a, b in linked_in(pair, side, fps, radius):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            pair = held.column("pair").to_numpy()
            last = int(np.searchsorted(pair, pair[-1])) if len(pair) else 0  # the last pair may go on
            if last:
                yield from emit(held.slice(0, last).combine_chunks())
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): forests of links within the radius between distinct fingerprints ``fp``."""
    members = tiles(distinct, radius)
    dealt = members.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, column: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    marked = written(fingerprints(docs, shingle, column), "fingerprints")
    distinct = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # distinct fingerprints that no link touches are their own root
    known = placed.join(least, "root").select("fp", "component_id")
    return marked.join(known, marked["fingerprint"] == known["fp"]).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, column: str = "text") -> DataFrame:
    """One document of each component, columns as they came: the one with the least id, then the least hash of all columns."""
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    marked = near_duplicates(numbered.select(F.col(row).alias("doc_id"), F.col(column).alias("text")), shingle, radius)
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.xxhash64(*[c for c in docs.columns if c != "doc_id"]), row)
    keyed = numbered.select(F.col(row).alias("_row"), order.alias("_order"))
    chosen = (
        marked.join(keyed, F.col("doc_id") == F.col("_row")).groupBy("component_id").agg(F.min_by("_row", "_order").alias("_chosen"))
    )
    return numbered.join(chosen.select(F.col("_chosen").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
