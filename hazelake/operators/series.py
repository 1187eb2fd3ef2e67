"""Ordered work on station series, cut into bounded blocks.

A window over ``(station)`` puts a whole series into one task, and one station may hold a third
of all rows. Frames that look back at most ``back`` rows do not need that: the series is cut into
blocks of ``block`` rows, every block also gets the ``back`` rows before it, the window runs
per ``(station, block)``, and the borrowed rows are dropped again. A window group therefore holds
at most ``block + back + ahead`` rows however long the series or however hot the station is.

``spacing`` says what a row's position in its series is:

* ``"rows"`` - its ordinal, exact for any series. Ordinals come from counts per (key, day).
* ``"hourly"`` - its hour, for series known to have one row for every hour. Saves a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from hazelake.functions.scalar import hour_index
from hazelake.session import materialised

BLOCK_ROWS = 24 * 90
BLOCK, OWN, POSITION = "_block", "_own", "_position"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_ordinal(df: DataFrame, key, ts: str, name: str = POSITION, day: str | None = None) -> DataFrame:
    """0-based ordinal of each row in its series without sorting a series in one task.

    ``day`` names a column that has the date of ``ts`` already: rows that a join by it has dealt out are not shuffled again.
    """
    key = _keys(key)
    dated = df if day else df.withColumn("_day", F.to_date(ts))
    by_day = [*key, day or "_day"]
    counts = dated.groupBy(*by_day).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(by_day[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by_day, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_day = Window.partitionBy(*by_day).orderBy(ts)
    # a series has more rows than days, and the window below needs this exchange and order anyway
    return (
        dated.hint("merge").join(starts, by_day)
        .withColumn(name, F.col("_start") + F.row_number().over(in_day) - 1)
        .drop("_day", "_start")
    )


def to_blocks(
    df: DataFrame,
    key,
    ts: str,
    back: int = 0,
    ahead: int = 0,
    block: int = BLOCK_ROWS,
    spacing: str = "rows",
    day: str | None = None,
) -> DataFrame:
    """Give every row to its own block and to the blocks that need it as history or future."""
    if spacing == "rows":
        placed = with_ordinal(df, key, ts, day=day)
    elif spacing == "hourly":
        placed = df.withColumn(POSITION, hour_index(ts))
    else:
        raise ValueError(f"unknown spacing: {spacing}")
    position = F.col(POSITION)
    own = F.floor(position / block)
    first, last = F.floor((position - ahead) / block), F.floor((position + back) / block)
    return (
        placed.select("*", own.alias("_home"), F.explode(F.sequence(first, last)).alias(BLOCK))
        .withColumn(OWN, F.col(BLOCK) == F.col("_home"))
        .drop("_home", POSITION)
    )


def every_hour_once(blocks: DataFrame, key, ts: str) -> DataFrame:
    """Raise where a block lacks an hour or has one twice; the check needs no exchange or sort of its own.

    A gap longer than the borrowed rows that ends at the border of a block shows in neither block; ``hourly_span`` sees
    it where the whole series is aggregated anyway.
    """
    w = Window.partitionBy(*_keys(key), BLOCK).orderBy(ts)
    step = hour_index(ts) - F.lag(hour_index(ts)).over(w)
    sound = F.when(F.coalesce(step, F.lit(1)) == 1, F.col(ts)).otherwise(
        F.raise_error(F.lit('series has missing or repeated hours; use spacing="rows"')).cast("timestamp_ntz")
    )
    return blocks.withColumn(ts, sound)


def hourly_span(ts: str) -> tuple:
    """Aggregates for the first and last hour of a series; the first raises unless each hour in between is there once.

    As many hours as there should be, with the right sum and the right sum of squares.
    """
    at = hour_index(ts)
    n, first, last = F.count(at), F.min(at), F.max(at)

    def pyramid(x):
        return x * (x + 1) * (x * 2 + 1)

    sound = (n == last - first + 1) & (F.sum(at) * 2 == (first + last) * n) & (F.sum(at * at) * 6 == pyramid(last) - pyramid(first - 1))
    wrong = F.raise_error(F.lit('series has missing or repeated hours; use spacing="rows"')).cast("bigint")
    return F.when(sound | (n == 0), first).otherwise(wrong), last


def block_window(key, ts: str) -> str:
    """The window all column builders below refer to, as SQL text."""
    return f"PARTITION BY {', '.join(_keys(key))}, {BLOCK} ORDER BY {ts}"


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given as SQL; one call for all of them keeps wide plans quick to build."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def from_blocks(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(BLOCK, OWN)


def windowed(
    df: DataFrame,
    key,
    ts: str,
    build,
    back: int = 0,
    ahead: int = 0,
    block: int = BLOCK_ROWS,
    spacing: str = "rows",
) -> DataFrame:
    """Add the columns that ``build(window)`` returns; they may look ``back``/``ahead`` rows."""
    blocks = to_blocks(df, key, ts, back, ahead, block, spacing)
    if spacing == "hourly":
        blocks = every_hour_once(blocks, key, ts)
    return from_blocks(add_columns(blocks, build(block_window(key, ts))))


# ------------------------------------------------------------------ column builders
def lags(w: str, column: str, offsets, name: str) -> dict[str, str]:
    return {name.format(k): f"lag({column}, {k}) OVER ({w})" for k in offsets}


LONGEST_FRAME = 12


@dataclass(frozen=True)
class Rolling:
    """Statistics of one column over several window lengths; names have a ``{}`` for the length."""

    column: str
    lengths: tuple[int, ...]
    names: dict[str, str]

    @property
    def parts(self) -> list[str]:
        """What has to be carried: count, sum, sum of squares, maximum."""
        wanted = set(self.names)
        users = {"n": wanted, "s": {"mean", "std", "sum"}, "q": {"std"}, "x": {"max"}}
        return [part for part, stats in users.items() if stats & wanted]

    def part(self, n: int, kind: str) -> str:
        return f"_{kind}_{self.column}_{n}"


def _piece(n: int) -> int:
    """Length of the frames a window of ``n`` rows is put together from."""
    return n if n <= LONGEST_FRAME else max(m for m in range(1, LONGEST_FRAME + 1) if n % m == 0)


def rolling(df: DataFrame, w: str, specs, inclusive: bool) -> DataFrame:
    """Add rolling statistics for all ``specs``.

    A frame of 168 rows evaluated at every row costs 168 updates per statistic. Here only frames of
    up to 12 rows are evaluated; a longer window adds up the results of such frames at earlier
    rows (168 = 14 x 12), which are plain lags over the same (partition, order) and cost neither an
    exchange nor a sort. Sums are taken of the distance to the smallest value of the block, so
    that squares do not cancel.

    ``inclusive`` frames end at the current row and stay NULL until every row of the window is
    present; the others end one row earlier and need one observation.
    """
    whole = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    df = add_columns(df, {
        spec.part(0, "c"): f"min({spec.column}) OVER ({whole})" if "std" in spec.names else "0D" for spec in specs
    })
    df = add_columns(df, {
        name: sql
        for spec in specs
        for m in sorted({_piece(n) for n in spec.lengths})
        for name, sql in _framed(w, spec, m, inclusive).items()
    })
    df = add_columns(df, {
        name: sql
        for spec in specs
        for n in spec.lengths
        if _piece(n) != n
        for name, sql in _joined(w, spec, n, _piece(n)).items()
    })
    carried = [
        spec.part(n, kind)
        for spec in specs
        for n in {0, *spec.lengths, *map(_piece, spec.lengths)}
        for kind in ("c", "n", "s", "q", "x")
    ]
    return add_columns(df, _finished(specs, inclusive)).drop(*carried)


def _framed(w: str, spec: Rolling, n: int, inclusive: bool) -> dict[str, str]:
    rows = f"{n - 1} PRECEDING AND CURRENT ROW" if inclusive else f"{n} PRECEDING AND 1 PRECEDING"
    over = f"OVER ({w} ROWS BETWEEN {rows})"
    distance = f"({spec.column} - {spec.part(0, 'c')})"
    made = {
        "n": f"count({spec.column}) {over}",
        "s": f"coalesce(sum({distance}) {over}, 0D)",
        "q": f"coalesce(sum({distance} * {distance}) {over}, 0D)",
        "x": f"max({spec.column}) {over}",
    }
    return {spec.part(n, kind): made[kind] for kind in spec.parts}


def _joined(w: str, spec: Rolling, n: int, piece: int) -> dict[str, str]:
    def pieces(kind, default):
        column = spec.part(piece, kind)
        return [column, *[f"lag({column}, {k}, {default}) OVER ({w})" for k in range(piece, n, piece)]]

    made = {kind: " + ".join(pieces(kind, "0L" if kind == "n" else "0D")) for kind in spec.parts if kind != "x"}
    if "x" in spec.parts:
        made["x"] = f"greatest({', '.join(pieces('x', 'NULL'))})"
    return {spec.part(n, kind): sql for kind, sql in made.items()}


def _finished(specs, inclusive: bool) -> dict[str, str]:
    out = {}
    for spec in specs:
        centre = spec.part(0, "c")
        for n in spec.lengths:
            count, s, q, x = (spec.part(n, kind) for kind in ("n", "s", "q", "x"))
            spread = f"({q} - {s} * {s} / {count})"
            values = {
                "mean": f"{centre} + {s} / {count}",
                "sum": f"{s} + {centre} * {count}",
                "max": x,
                # what is left of equal values is rounding, not spread
                "std": f"CASE WHEN {count} >= 2 THEN sqrt(CASE WHEN {spread} > {q} * 1e-12D THEN {spread} ELSE 0D END"
                f" / ({count} - 1)) END",
            }
            enough = f"{count} = {n}" if inclusive else f"{count} >= 1"
            for stat, name in spec.names.items():
                out[name.format(n)] = f"CASE WHEN {enough} THEN {values[stat]} END"
    return out


def with_rolling(df: DataFrame, key, ts: str, specs, inclusive: bool = False, block: int = BLOCK_ROWS, spacing: str = "rows") -> DataFrame:
    """Rolling statistics over whole series, in blocks."""
    back = max(n for spec in specs for n in spec.lengths)
    blocks = to_blocks(df, key, ts, back, block=block, spacing=spacing)
    if spacing == "hourly":
        blocks = every_hour_once(blocks, key, ts)
    return from_blocks(rolling(blocks, block_window(key, ts), specs, inclusive))


# ------------------------------------------------------------------ unbounded look-back
def fill_gaps(df: DataFrame, key, ts: str, columns, block: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill, then backward fill, per series.

    What a block needs from before it is one value, the last one present in an earlier block, so
    the carry runs over one row per block, and only the fill inside a block looks at the rows.
    """
    key = _keys(key)
    placed = df.withColumn(BLOCK, F.floor(hour_index(ts) / block))
    edges = placed.groupBy(*key, BLOCK).agg(
        *[
            agg(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_{side}_{c}")
            for c in columns
            for side, agg in (("last", F.max_by), ("first", F.min_by))
        ]
    )
    by_block = Window.partitionBy(*key).orderBy(BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = edges.select(
        *key,
        BLOCK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_lead_{c}") for c in columns],
    )
    so_far = Window.partitionBy(*key, BLOCK).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.join(carries, [*key, BLOCK]).withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_carry_{c}"), F.col(f"_lead_{c}"))
        for c in columns
    })
    return filled.select(*df.columns)


# ------------------------------------------------------------------ rows by rank
def keep_first(df: DataFrame, key, order) -> DataFrame:
    """First row per key in ``order``; the group limit below the exchange prunes hot keys early."""
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, key, order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key in ``order``, ranked from 1."""
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


RANGES = 64


def running_total(df: DataFrame, order: str, value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Sum of ``value`` over the rows up to and including each, in the order of a unique column.

    Rows go to ranges of that column, which are sorted each by itself; what lies before a range is the sum of the
    ranges before it, one number each. The ranges are written down, because two evaluations may cut them differently.
    """
    dealt = df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id())
    placed = materialised(dealt, "ranges")
    sums = dict(placed.groupBy("_range").agg(F.sum(value)).collect())  # at most one row per range
    before = [sum(v for r, v in sums.items() if r < i) for i in range(ranges)]
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    offset = F.get(F.array(*[F.lit(int(b)) for b in before]), F.col("_range"))
    return placed.withColumn(name, inside + offset).drop("_range")


def label_encode(df: DataFrame, column: str, label: str) -> DataFrame:
    """Distinct values with their 0-based alphabetical ordinal."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1))
    return running_total(values, column, "_one", "_upto").select(column, (F.col("_upto") - 1).cast("int").alias(label))
