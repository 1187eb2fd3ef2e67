"""Tables an alerting service reads: as-of rows, indicators, daily summaries, ranked fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.constants import WEATHER_COLUMNS
from hazelake.functions import scalar as S
from hazelake.operators.series import top_per_group
from hazelake.operators.splits import ntz, since_latest

WEEK_ROWS = 168


def asof_latest(frame: DataFrame, now, extra=()) -> DataFrame:
    """Per station the last row up to ``now`` and the last one up to a day before.

    Without a row up to ``now`` the first one stands in; without one a day earlier, the latest.
    ``max_by`` is partially aggregated, so the size of a station does not matter.
    """
    ts, now = F.col("Datetime"), ntz(now)
    row = F.struct(ts.alias("ts"), F.col("PM25").alias("pm25"), *extra)
    picked = frame.groupBy("Province").agg(
        F.max_by(row, F.when(ts <= now, ts)).alias("_latest"),
        F.max_by(row, F.when(ts <= now - F.expr("INTERVAL 1 DAY"), ts)).alias("_prev"),
        F.min_by(row, ts).alias("_first"),
    )
    picked = picked.withColumn("_latest", F.coalesce("_latest", "_first"))
    picked = picked.withColumn("_prev", F.coalesce("_prev", "_latest"))
    return picked.select(
        "Province",
        F.col("_latest.ts").alias("now_ts"),
        F.col("_latest.pm25").alias("pm25_now"),
        F.col("_prev.ts").alias("prev_ts"),
        F.col("_prev.pm25").alias("pm25_prev"),
        *[F.col(f"_latest.{c}").alias(c) for c in extra],
    )


def latest_of(frame: DataFrame, now, column: str) -> DataFrame:
    """Per station the value of its last row up to ``now``."""
    past = frame.where(F.col("Datetime") <= ntz(now))
    return past.groupBy("Province").agg(F.max_by(column, "Datetime").alias(column))


def forecast_rows(frame: DataFrame, now, n: int = WEEK_ROWS) -> DataFrame:
    """First ``n`` rows after ``now`` per station."""
    ahead = frame.where(F.col("Datetime") > ntz(now))
    return top_per_group(ahead, "Province", [F.col("Datetime").asc()], n, "_rn").drop("_rn")


def actual_rows(frame: DataFrame, now, n: int = WEEK_ROWS) -> DataFrame:
    """Last ``n`` rows up to ``now`` per station."""
    past = frame.where(F.col("Datetime") <= ntz(now))
    return top_per_group(past, "Province", [F.col("Datetime").desc()], n, "_rn").drop("_rn")


def daily_summary(forecast: DataFrame, value: str = "predicted") -> DataFrame:
    """Mean, maximum, minimum per day and the level of the maximum; grouped by date, formatted last."""
    days = forecast.groupBy("Province", F.to_date("Datetime").alias("date")).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min")
    )
    return days.withColumns({
        "day": F.date_format("date", "dd MMM yyyy"),
        "level": S.risk_level("max"),
        "label": S.risk_label("max"),
        "max_text": S.with_unit("max"),
    })


def forecast_peak(forecast: DataFrame, value: str = "predicted") -> DataFrame:
    """Row of the largest value per station, the earliest one if it occurs twice."""
    present = S.missing_to_null(value)
    hour = S.hour_index("Datetime")
    best = F.max(F.when(present.isNotNull(), F.struct(present.alias("v"), (-hour).alias("h"), F.col("Datetime").alias("ts"))))
    return forecast.groupBy("Province").agg(best.alias("_b")).where("_b IS NOT NULL").select(
        "Province", F.col("_b.ts").alias("peak_ts"), F.col("_b.v").alias("peak")
    )


def kpi_cards(frame: DataFrame, hotspots: DataFrame, now) -> DataFrame:
    """One indicator row per station out of a frame with one row per hour.

    A week is 168 rows, which in an hourly frame is 168 hours: everything is a conditional
    aggregate, so one pass with map-side partials does it. ``fire_count`` covers the latest
    detection date and the one before it: dates carry no hours, so "24 hours" spans two days.
    """
    ts, at, week = F.col("Datetime"), ntz(now), F.expr(f"INTERVAL '{WEEK_ROWS}' HOUR")
    ahead = (ts > at) & (ts <= at + week)
    past = (ts <= at) & (ts > at - week)
    carried = ["temperature_2m", "relative_humidity_2m", "wind_direction_10m"]
    row = F.struct(ts.alias("ts"), F.col("PM25").alias("pm25"), *carried)
    stations = frame.groupBy("Province").agg(
        F.max_by(row, F.when(ts <= at, ts)).alias("_latest"),
        F.max_by(row, F.when(ts <= at - F.expr("INTERVAL 1 DAY"), ts)).alias("_prev"),
        F.min_by(row, ts).alias("_first"),
        F.max(F.when(ahead, F.col("predicted"))).alias("_fmax"),
        F.avg(F.when(ahead, F.col("predicted"))).alias("_fmean"),
        F.avg(F.when(past, F.col("PM25"))).alias("_amean"),
        F.max("PM25").alias("_omax"),
    )
    latest = F.coalesce("_latest", "_first")
    fires = since_latest(hotspots, "acq_date", 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("frp"), F.lit(0.0)).alias("frp")
    )
    cards = stations.withColumns({"_latest": latest, "_prev": F.coalesce("_prev", latest)}).withColumns({
        "now_ts": F.col("_latest.ts"),
        "pm25_now": F.col("_latest.pm25"),
        "forecast_max": F.coalesce(F.col("_fmax"), F.col("_latest.pm25")),
        "weekly_trend": F.coalesce(F.col("_fmean") - F.col("_amean"), F.lit(0.0)),
    })
    return cards.select(
        "Province",
        "now_ts",
        "pm25_now",
        (F.col("pm25_now") - F.col("_prev.pm25")).alias("delta_24h"),
        S.risk_level("pm25_now").alias("level_now"),
        "forecast_max",
        S.risk_level("forecast_max").alias("level_forecast"),
        "weekly_trend",
        S.trend_icon("weekly_trend").alias("trend_icon"),
        S.trend_direction("weekly_trend").alias("trend_direction"),
        *[F.col(f"_latest.{c}").alias(c) for c in carried],
        fires.select("n").scalar().alias("fire_count"),
        fires.select("frp").scalar().alias("fire_frp_sum"),
        S.axis_bound("_omax", "_fmax").alias("axis_bound"),
    )


def risk_table(frame: DataFrame, value: str) -> DataFrame:
    return frame.select(
        "Province",
        "Datetime",
        value,
        S.risk_level(value).alias("level"),
        S.risk_label(value).alias("label"),
        S.risk_colour(value).alias("colour"),
        S.risk_advice(value).alias("advice"),
        S.is_missing(value).alias("is_missing"),
    )


def audience_table(peaks: DataFrame, value: str) -> DataFrame:
    long = peaks.select("Province", value, F.explode(S.audience_alerts(value)).alias("_a"))
    return long.select("Province", value, "_a.audience", "_a.is_alert")


def band_table(forecast: DataFrame, value: str = "predicted") -> DataFrame:
    return forecast.select(
        "Province",
        "Datetime",
        value,
        S.band_lower(value).alias("lower"),
        S.band_upper(value).alias("upper"),
        S.zone(value).alias("zone"),
    )


def serving_frame(actual: DataFrame, forecast: DataFrame, now, days: int = 14) -> DataFrame:
    """Recent rows with one PM25 series: readings where present, the forecast elsewhere."""
    known = forecast.select("Province", "Datetime", "Predicted_PM25")
    recent = actual.where(F.col("Datetime") >= ntz(now) - F.expr(f"INTERVAL '{int(days)}' DAY"))
    merged = recent.join(known, ["Province", "Datetime"], "left")
    value = F.coalesce("PM25", "Predicted_PM25")
    carried = [c for c in (*WEATHER_COLUMNS, "hotspot_count", "frp_sum", "frp_mean") if c in actual.columns]
    return merged.select("Province", "Datetime", value.alias("PM25"), *carried, value.alias("predicted"))
