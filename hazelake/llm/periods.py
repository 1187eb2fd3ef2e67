"""Periodic runs of words, found tile by tile for each octave of periods.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its smallest period, of
``REPEATS`` periods and ``LEAST`` words or more, that no neighbouring word extends. Of words numbered i, those with
word i = word i + q form intervals; a run is such an interval of ``REPEATS - 1`` periods or more, plus q words.

For the octave of periods from P to 2P - 1, a boundary stands at every multiple of P, in a tile of P words before it
and 5P after it. Tiles overlap and are solved on their own: the boundary's Z-function says for every period how far
the words behind the boundary agree with those a period later; the backward one says it for the words before. An
interval of a run has 3P words at least, so some boundary in it has a forward value of 2P or more, and the boundaries that
have one reach, with the P words on either side, over all of it. Of the periods with such a value at one boundary only
the smallest can be the period of a run, all others being no smallest period (Fine and Wilf), so values are worked out
for that one: hashes of 2P words, doubled from octave to octave, tell which it is, then words are compared.

Tiles give fragments (period, first, last) of intervals. Fragments that touch are merged where they were found; what
is left is shuffled by document and period and stitched across tiles. Of stretches with equal bounds the one of the least
period is the run.

Short texts share a group of tiles, with separators that equal no word. Texts over ``LONG`` words are dealt out to tasks
as groups of tiles by octave, so that none is one task's work from end to end; they travel about 1.4 times per
octave beyond ``SPAN``. Fragments of a document and period are few: one per group of tiles and interval.

Nulls: a null text has no words; a null id is a value like any other (for ``looped`` it has no number: words stay). Repeated
rows are documents of their own. Texts without a run keep all words. Empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hazelake.llm.common import whole_text, written

REPEATS = 4
LEAST = 6
#: words in a group of tiles
SPAN = 1 << 16
#: words of a text that is dealt out to tasks
LONG = 1 << 20
FRAGMENT = "array<struct<period:bigint,first:bigint,last:bigint>>"
_FRAGMENT = pa.list_(pa.struct([(n, pa.int64()) for n in ("period", "first", "last")]))


# ------------------------------------------------------------------ tiles
def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``2 * width`` words out of those of ``width``."""
    return _mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])


def boundary_z(codes: np.ndarray, at: np.ndarray, shift: np.ndarray, before: int, after: int):
    """(backward, forward) Z-values of boundaries: words before and from ``at`` on that equal those ``shift`` later."""
    back, ahead = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    step = max(1, (1 << 20) // (before + after))
    for k in range(0, len(at), step):
        place = at[k:k + step, None] + np.arange(-before, after)
        later = place + shift[k:k + step, None]
        inside = (place >= 0) & (later < len(codes))
        equal = codes[np.where(inside, place, 0)] == codes[np.where(inside, later, 0)]
        differs = ~(equal & inside)
        ends = np.ones((len(place), 1), dtype=bool)
        back[k:k + step] = np.hstack([differs[:, :before][:, ::-1], ends]).argmax(axis=1)
        ahead[k:k + step] = np.hstack([differs[:, before:], ends]).argmax(axis=1)
    return back, ahead


def merged(period: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Fragments of one period that overlap or touch as one."""
    order = np.lexsort((last, first, period))
    period, first, last = period[order], first[order], last[order]
    if not len(first):
        return period, first, last
    # periods apart, so that a running maximum does not carry over
    apart = period * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + apart)
    new = np.r_[True, (first + apart)[1:] > reach[:-1]]
    starts = np.flatnonzero(new)
    return period[starts], first[starts], reach[np.r_[starts[1:], len(new)] - 1] - apart[starts]


def octave(codes: np.ndarray, wide: np.ndarray, width: int):
    """Fragments from all tiles of the octave of periods ``width`` to ``2 * width - 1``; ``wide`` hashes 2 widths."""
    rows = -(-len(wide) // width)
    blocks = np.zeros(rows * width, dtype=np.uint64)
    blocks[:len(wide)] = wide
    blocks = blocks.reshape(rows, width)
    same = blocks[1:] == blocks[:-1, :1]
    hit = np.flatnonzero(same.any(axis=1))
    at, shift = hit * width, width + same[hit].argmax(axis=1)
    back, ahead = boundary_z(codes, at, shift, width, 3 * width)
    real = ahead >= 2 * width
    return merged(shift[real], at[real] - back[real], at[real] + ahead[real])


def fragments(codes: np.ndarray, least: int, longest: int):
    """(period, first, last) from tiles of the octaves ``least``, 2 ``least``, ... up to texts of ``longest`` words."""
    found = [np.zeros((3, 0), dtype=np.int64)]
    hashes, width = _mixed(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), 1
    while REPEATS * width <= longest and len(hashes) > width:
        hashes = _doubled(hashes, width)
        if width >= least:
            found.append(np.array(octave(codes, hashes, width)))
        width *= 2
    return np.concatenate(found, axis=1)


def coded(words: list[bytes], codes: dict) -> list[int]:
    give = codes.setdefault
    return [give(w, len(codes)) for w in words]


# ------------------------------------------------------------------ documents
def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by a checksum of its id, with the words from some place on repeated over and over."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def _solved(long: int, span: int, rewrite):
    """Texts with the fragments of their runs; those of long ones are left null, words are kept where they are needed."""
    import zstandard

    names = ["row", "doc_id", "n_words", "digest", "words", "found"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _FRAGMENT]

    def group(held):
        """Rows for texts that share tiles."""
        codes, seen, starts, longest = [], {}, [], 0
        for _, _, words in held:
            starts.append(len(codes))
            if len(words) <= long:
                codes += coded(words, seen)
                longest = max(longest, len(words))
            codes.append(-1 - len(starts))  # equals no word and no other separator
        period, first, last = fragments(np.array(codes, dtype=np.int64), 1, longest)
        whole = last - first + period >= np.maximum(LEAST, REPEATS * period)
        period, first, last = period[whole], first[whole], last[whole]
        owner = np.searchsorted(starts, first, side="right") - 1
        found = [[] for _ in held]
        for d, p, a, b in zip(owner.tolist(), period.tolist(), first.tolist(), last.tolist()):
            found[d].append({"period": p, "first": a - starts[d], "last": b - starts[d]})
        pack = zstandard.ZstdCompressor(level=1).compress
        out = {n: [] for n in names}
        for (row, doc, words), own in zip(held, found):
            text, later = b" ".join(words), len(words) > long
            plain = not own and not later
            for n, v in zip(names, (row, doc, len(words), hashlib.sha256(text).hexdigest() if plain else None, None if plain else pack(text), None if later else own)):
                out[n].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_buffer().to_pybytes().split()
                held.append((row, doc, rewrite(doc, words) if rewrite else words))
                size += len(words)
                if size >= span or len(held) >= 4096:
                    yield group(held)
                    held, size = [], 0
        if held:
            yield group(held)

    return run


def tile_groups(n: int, span: int):
    """(least octave, most octave, first boundary, end of boundaries): the tiles of a text of ``n`` words."""
    small = 1
    while 24 * small <= span:
        small *= 2
    for at in range(0, n, span):
        yield 1, small, at, at + span
    width = 2 * small
    while REPEATS * width <= n:
        for at in range(0, n, 16 * width):
            yield width, width, at, at + 16 * width
        width *= 2


def _dealt(span: int):
    """Groups of tiles of long texts, each with the words it needs."""
    import zstandard

    names = ["row", "least", "most", "start", "words"]

    def run(batches):
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = zstandard.ZstdDecompressor().decompressobj().decompress(packed.as_py()).split()
                for least, most, lo, hi in tile_groups(len(words), span):
                    # boundaries are multiples of each octave's width, also when counted from here
                    start = max(0, lo - most)
                    part = b" ".join(words[start:hi + 5 * most])
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if n == "words" else pa.int64()) for n, x in zip(names, (row, least, most, start, part))], names=names)

    return run


def _tiles(batches):
    names = ["row", "period", "first", "last"]
    for batch in batches:
        for row, least, most, start, text in zip(*[c.to_pylist() for c in batch.columns]):
            codes = np.array(coded(text.split(), {}), dtype=np.int64)
            period, first, last = fragments(codes, least, REPEATS * most)
            columns = [np.full(len(period), row, dtype=np.int64), period, first + start, last + start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def stitched(found: DataFrame) -> DataFrame:
    """(row, start, period, length): runs out of fragments (row, period, first, last)."""
    ordered = Window.partitionBy("row", "period").orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") <= reach, 0).otherwise(1)
    numbered = found.withColumn("new", new).withColumn("part", F.sum("new").over(ordered))
    whole = numbered.groupBy("row", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    long = whole.withColumn("length", length).where(length >= F.greatest(F.lit(LEAST), REPEATS * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _collapsed(batches):
    """Digest of the words that no run repeats."""
    import zstandard

    names = ["row", "collapsed_sha256"]
    for batch in batches:
        out = []
        for packed, runs in zip(batch.column(1), batch.column(2).to_pylist()):
            words = zstandard.ZstdDecompressor().decompressobj().decompress(packed.as_py()).split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for r in runs or ():
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
            out.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=names)


def periodic_runs(docs: DataFrame, column: str = "text", rewrite=None, long: int = LONG, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_words, runs (array of start, period, length, in that order), collapsed_sha256.

    ``rewrite(doc_id, words)`` may change the words of a document, but not their number. ``collapsed_sha256`` is the
    digest of the words, joined by one space, that are in no run after its first period.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(column).alias("text"))
    kinds = f"row long, doc_id long, n_words long, digest string, words binary, found {FRAGMENT}"
    solved = written(rows.mapInArrow(_solved(long, span, rewrite), kinds), "tiles")
    near = solved.where("found IS NOT NULL").select("row", F.inline("found"))
    dealt = solved.where("found IS NULL").select("row", "words").mapInArrow(_dealt(span), "row long, least long, most long, start long, words binary")
    far = dealt.repartition("row", "least", "start").mapInArrow(_tiles, "row long, period long, first long, last long")
    runs = written(stitched(near.unionByName(far)), "runs")
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one document
    repeating = solved.where("words IS NOT NULL").select("row", "doc_id", "n_words", "words").join(listed, "row", "left")
    collapsed = repeating.select("row", "words", "runs").mapInArrow(_collapsed, "row long, collapsed_sha256 string")
    done = repeating.select("row", "doc_id", "n_words", "runs").join(collapsed, "row").drop("row")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    plain = solved.where("words IS NULL").select("doc_id", "n_words", none.alias("runs"), F.col("digest").alias("collapsed_sha256"))
    return plain.unionByName(done.withColumn("runs", F.coalesce("runs", none)))


# ------------------------------------------------------------------ the query's columns
def summary(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests, of ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    length, period = best["length"], -best["q"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )


#: crc32 of a number's decimal digits, bit by bit
CRC32 = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1))),
    lambda h, bit: CASE WHEN xor(h & 1, bit) = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""


def sql() -> str:
    """The same over the table ``documents``: equal words of a document joined, by distance."""
    return f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
ids AS MATERIALIZED (SELECT *, {CRC32} AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) AS d),
placed AS (SELECT r, t.doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM texts t LEFT JOIN ids i ON t.doc_id = i.doc_id),
docs AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) END AS w FROM placed),
words AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
places AS MATERIALIZED (SELECT r, n, word, list(i ORDER BY i) AS spots FROM words GROUP BY 1, 2, 3),
pairs AS MATERIALIZED (SELECT r, i, j - i AS q FROM (SELECT r, n, i, unnest(list_filter(spots, lambda x: x > i AND 4 * (x - i) <= n)) AS j
  FROM (SELECT r, n, spots, unnest(spots) AS i FROM places WHERE len(spots) > 1))),
parts AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pairs) GROUP BY r, q, part),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM parts WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
listed AS (SELECT r, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, length * 1000000000000 - start) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""
