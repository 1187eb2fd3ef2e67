"""The daily batch: from history, forecast weather and fires to the hours a forecast starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.operators import fires, panel
from hazelake.operators.splits import ntz
from hazelake.plans.forecast import forecast_window


def batch_frame(history: DataFrame, ahead: DataFrame, daily: DataFrame, now) -> DataFrame:
    """Hours around ``now`` with weather, readings and fires as they are known at ``now``.

    ``history`` is weather with readings, ``ahead`` forecast weather, ``daily`` fires per station and day; rows of
    ``history`` and ``daily`` after ``now`` are not read. Where history and forecast overlap, history wins. Days
    whose fires are unknown take the recent means of their station. Both tables are cut to the forecast's window before
    they are stacked, so the shuffle of ``history_wins`` carries a few hundred rows per station. It deals them out by day and
    station, as the join with daily fires needs them.
    """
    known = daily.where(F.col("date") <= F.to_date(ntz(now)))
    past = forecast_window(history.where(F.col("Datetime") <= ntz(now)), now)
    stacked = panel.union_sources(history=past, forecast=forecast_window(ahead, now)).withColumn("date", F.to_date("Datetime"))
    hours = panel.history_wins(stacked.repartition("date", "Province"), key=["date", *panel.KEY])
    dated = panel.attach_daily_fires(hours.drop("source", "source_priority"), known, fill_zero=False, dated=True)
    return fires.fill_from_recent(dated, known)
