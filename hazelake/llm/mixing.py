"""Mixing sources to target weights along a curriculum.

Each source has a share of the mix (its target, in words) and a weight schedule over training time
t in [0, 1]: a line from ``start`` to ``end``. Integrated, the schedule says which part of the target
has been asked for until t; inverted, it says at which t a given word of the source is due. Documents
of a source queue in hash order, again from the first when all are used, and each is due when the
words before it in the queue have been asked for. Sorted by that position the documents are the mix.

A queue is a running sum over a source, which may be a third of all rows: documents go to 4,096
buckets of each source by the first digits of their hash, running sums run inside buckets, and the
sums before a bucket come from a table with one row per bucket. Sources themselves are a dimension
(one row each) and ranked in one task.

The last document a source needs is taken in part, so that a source's words are its target, rounded.
Nulls: a null source is a source of its own, ranked last; a null text has size 0 and is never taken;
a null doc_id is queued by the hash of its text. Repeated rows queue one after
the other; which of two equal rows is taken makes no difference to the rows returned. An empty table
gives an empty mix. Columns of any other name are carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazelake.llm.common import WORD, whole_text, written

# --- fixed values ----------------------------------------------------------------------------
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: (start, end) of the weight schedules, repeating over the sources like the weights
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKET_DIGITS = 3


def sized(docs: DataFrame, column: str = "text") -> DataFrame:
    """Size, queue key and bucket of each document, next to its columns in ``doc``."""
    text = whole_text(column)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), text).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id"), F.col("source"),
        # never null, so that windows and joins deal rows out alike
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("of"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket"),
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Rank, weight and target of each (source, source_size).

    Filled like vessels of capacity ``passes * source_size``: in the order in which they fill up, a
    source is full if the level that the rest would reach without it is above its own.
    """
    ranked = sources.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    cap = (F.lit(passes) * F.col("source_size")).cast("double")
    weighted = ranked.withColumns({
        "weight": F.get(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights)).cast("double"),
        "cap": cap,
    })
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, from_here = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighted.withColumns({
        "place": F.row_number().over(by_level),
        "level": (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(from_here),
    })
    open_place = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("place"))
    level = F.min_by("level", open_place).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return levels.select(*sources.columns, "rank", "weight", target.alias("target"))


def position(done: Column, start: Column, end: Column) -> Column:
    """The time at which a share ``done`` of the target has been asked for.

    The integral of the line up to t, over that up to 1, is (2 start t + (end - start) t^2) / (start + end).
    """
    curved = (F.sqrt(start * start + (end * end - start * start) * done) - start) / (end - start)
    return F.when(start == end, done).otherwise(curved)


def assigned(docs: DataFrame, column: str = "text", weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, schedules=SCHEDULES) -> DataFrame:
    """Every document with its size, target, words taken, and per pass (words, position)."""
    rows = sized(docs, column)
    same_source = Window.partitionBy("of")
    # read several times below, so that texts are not
    buckets = written(rows.groupBy("of", "source", "bucket").agg(F.sum("size").alias("in_bucket")), "buckets")
    sources = targets(buckets.groupBy("of", "source").agg(F.sum("in_bucket").alias("source_size")), weights, share, passes)
    buckets = buckets.withColumn(
        "ahead", F.coalesce(F.sum("in_bucket").over(same_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    known = buckets.join(sources.drop("source"), "of").select("of", "bucket", "ahead", "source_size", "rank", "weight", "target")
    queue = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size", F.xxhash64("doc"))
    inside = F.coalesce(F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queued = rows.withColumn("inside", inside)
    # dealt out by the keys of the window above: texts move once
    out = queued.join(known, ["of", "bucket"])
    before = F.col("ahead") + F.col("inside")
    quota = F.floor(F.col("target") + 0.5)
    lines = F.get(
        F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in schedules]),
        F.col("rank") % len(schedules),
    )
    def turn(k):
        first = F.lit(k) * F.col("source_size") + before
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota - first))
        done = F.least(F.lit(1.0), first / F.greatest(F.col("target"), F.lit(1.0)))
        return F.struct(
            words.cast("long").alias("words"),
            F.when(words > 0, position(done, F.col("line.start"), F.col("line.end"))).alias("position"),
        )

    out = out.withColumn("line", lines).withColumn("turns", F.array(*[turn(k) for k in range(passes)]))
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc", "doc_id", "size", "source_size", "target", taken.alias("taken"), "turns")


def mix(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """The mix: a row per document and pass in training order, columns as they came.

    A document of which the mix takes only part (one per source) keeps its first words, one space apart.
    """
    rows = assigned(docs, column, **options).withColumn("turn", F.explode("turns")).where("turn.words > 0")
    cut = F.array_join(F.slice(F.array_remove(F.split(F.col(f"doc.`{column}`"), r"[\x20\x09-\x0D]+"), ""), 1, F.col("turn.words").cast("int")), " ")
    text = F.when(F.col("turn.words") < F.col("size"), cut).otherwise(F.col(f"doc.`{column}`"))
    columns = [text.alias(c) if c == column else F.col(f"doc.`{c}`") for c in docs.columns]
    ordered = rows.orderBy("turn.position", F.md5(F.col("doc_id").cast("string")), "doc_id", "size")
    return ordered.select(*columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS place,
  (CAST(sum(source_size) OVER () AS BIGINT) * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
   / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE cap / weight > level) AS filled FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.rank,
  CASE WHEN filled IS NULL THEN cap ELSE least(cap, t.weight * filled) END AS target,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, CAST(floor(target + 0.5e0) AS BIGINT) - before)) AS one,
  greatest(0, least(size, CAST(floor(target + 0.5e0) AS BIGINT) - before - source_size)) AS two,
  least(1e0, before / greatest(target, 1e0)) AS done FROM q)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken, CASE WHEN one > 0 THEN
  CASE rank % 3 WHEN 0 THEN (sqrt(1.5e0 * 1.5e0 + (0.5e0 * 0.5e0 - 1.5e0 * 1.5e0) * done) - 1.5e0) / (0.5e0 - 1.5e0)
  WHEN 1 THEN done ELSE (sqrt(0.5e0 * 0.5e0 + (1.5e0 * 1.5e0 - 0.5e0 * 0.5e0) * done) - 0.5e0) / (1.5e0 - 0.5e0) END END AS first_position
FROM p"""
