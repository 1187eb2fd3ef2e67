"""Assembly of the hourly panel out of weather, particulate readings and daily fires.

Hours laid out by ``explode`` look as small to Spark as the stations they come from. Joins of two hourly tables
therefore ask for a merge; Spark would broadcast the larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.constants import FIRE_COLUMNS
from hazelake.operators.series import keep_first

KEY = ["Datetime", "Province"]


def join_observations(pm25: DataFrame, weather: DataFrame) -> DataFrame:
    """Hours that have both a reading and weather."""
    return pm25.join(weather.hint("merge"), KEY, "inner")


def attach_pm25(weather: DataFrame, pm25: DataFrame) -> DataFrame:
    """Every weather hour, with its reading where there is one."""
    return weather.hint("merge").join(pm25.select("Datetime", "Province", "PM25"), KEY, "left")


def attach_daily_fires(hourly: DataFrame, daily: DataFrame, fill_zero: bool = True, dated: bool = False) -> DataFrame:
    """Daily fire measures on every hour of their day; ``fill_zero=False`` leaves unknown days NULL.

    ``dated`` hours have their ``date`` already; those dealt out by it are not shuffled again.
    """
    if not dated:
        hourly = hourly.withColumn("date", F.to_date("Datetime"))
    joined = hourly.join(daily.select("date", "Province", *FIRE_COLUMNS), ["date", "Province"], "left")
    value = (lambda c: F.coalesce(c, F.lit(0.0))) if fill_zero else (lambda c: c)
    return joined.select(
        *[c for c in hourly.columns if c != "date"], "date", *[value(F.col(c).cast("double")).alias(c) for c in FIRE_COLUMNS]
    )


def union_sources(**sources: DataFrame) -> DataFrame:
    """Union by name in the given order; ``source`` and ``source_priority`` tell rows apart."""
    parts = [
        df.withColumns({"source": F.lit(name), "source_priority": F.lit(i)})
        for i, (name, df) in enumerate(sources.items())
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def history_wins(union: DataFrame, tiebreak=(), key=KEY) -> DataFrame:
    """One row per hour and station, from the source listed first. ``key`` may also have what follows from the hour."""
    return keep_first(union, key, ["source_priority", *tiebreak])


def densify_hours(df: DataFrame, key: str = "Province", ts: str = "Datetime") -> DataFrame:
    """Insert the missing hours of each series between its own first and last hour."""
    spans = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = spans.select(
        key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias(ts)
    )
    return grid.join(df, [key, ts], "left").select(*df.columns)


def append_new_dates(master: DataFrame, batch: DataFrame, date, keys=()) -> DataFrame:
    """Master plus the batch rows whose date it does not know yet.

    ``date`` is an expression for the date of a row. With ``keys`` given the test is on date and
    keys, so a station that failed in an earlier partial run is still picked up.
    """
    return master.unionByName(new_rows(master, batch, date, keys))


def new_rows(master: DataFrame, batch: DataFrame, date, keys=()) -> DataFrame:
    known = master.select(F.expr(date).alias("_date"), *keys).distinct()
    dated = batch.withColumn("_date", F.expr(date))
    return dated.join(known, ["_date", *keys], "left_anti").select(*batch.columns)
