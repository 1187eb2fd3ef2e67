"""Multi-step forecasts that feed each prediction into the next step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hazelake.constants import PM25_LAGS, PM25_WINDOWS, SNAPSHOT_HORIZONS
from hazelake.functions.scalar import hour_index
from hazelake.operators.splits import ntz
from hazelake.plans.features import feature_matrix

HISTORY_DAYS = 10
FORECAST_DAYS = 7


def forecast_window(panel: DataFrame, now, history_days: int = HISTORY_DAYS, days: int = FORECAST_DAYS) -> DataFrame:
    """Recent history and the hours to forecast.

    This bounds what one station can hold in the steps below to
    ``24 * (history_days + days)`` rows, however long its series is.
    """
    ts, now = F.col("Datetime"), ntz(now)
    return panel.where(
        (ts >= now - F.expr(f"INTERVAL '{int(history_days)}' DAY"))
        & (ts <= now + F.expr(f"INTERVAL '{int(days)}' DAY"))
    )


def last_actual(frame: DataFrame) -> DataFrame:
    seen = frame.where(F.col("PM25").isNotNull())
    last = seen.groupBy("Province").agg(
        F.max("Datetime").alias("last_ts"), F.max_by("PM25", "Datetime").alias("last_pm25")
    )
    return last


def forecast_linear(frame: DataFrame, persistence: float, coefficient: float, driver: str) -> DataFrame:
    """``x[t] = persistence * x[t-1] + coefficient * driver[t]`` from the last reading on.

    ``frame`` is a :func:`forecast_window`; the fold over one station's hours stays in the JVM.
    """
    ahead = frame.join(last_actual(frame), "Province").where("Datetime > last_ts")
    series = ahead.groupBy("Province", "last_ts", "last_pm25").agg(
        F.array_sort(F.collect_list(F.struct("Datetime", F.col(driver).alias("d")))).alias("_s")
    )
    start = F.array(F.struct(F.col("last_ts").alias("ts"), F.col("last_pm25").alias("x")))

    def step(done, hour):
        previous = F.element_at(done, -1)["x"]
        value = F.lit(persistence) * previous + F.lit(coefficient) * hour["d"]
        return F.concat(done, F.array(F.struct(hour["Datetime"].alias("ts"), value.alias("x"))))

    folded = series.select("Province", "last_ts", F.aggregate("_s", start, step).alias("_f"))
    rows = folded.select("Province", "last_ts", F.explode(F.slice("_f", 2, F.size("_f"))).alias("_r"))
    return rows.select(
        "Province", F.col("_r.ts").alias("Datetime"), F.col("_r.x").alias("Predicted_PM25"), "last_ts"
    )


def horizon_snapshot(forecast: DataFrame, created_at, horizons=SNAPSHOT_HORIZONS) -> DataFrame:
    """One row per station with the predictions for fixed hours after its last reading."""
    ahead = hour_index("Datetime") - hour_index("last_ts")
    wide = forecast.withColumn("_h", ahead).groupBy("Province", "last_ts").agg(
        *[F.max(F.when(F.col("_h") == h, F.col("Predicted_PM25"))).alias(f"pred_{h}h") for h in horizons]
    )
    return wide.select(
        "Province",
        F.col("last_ts").alias("predict_datetime"),
        *[f"pred_{h}h" for h in horizons],
        F.lit(created_at).alias("created_at"),
    )


# ------------------------------------------------------------------ with the trained model
def recursive_inputs(frame: DataFrame, encoding: DataFrame, spacing: str = "rows") -> DataFrame:
    """Feature rows of a forecast window, computed by the same windows as for training.

    Only the PM25-dependent features have to be redone while stepping; everything known ahead
    (weather, fires, calendar) comes out of the JVM.
    """
    return feature_matrix(frame, encoding, spacing=spacing)


def forecast_recursive(inputs: DataFrame, fitted, trees: int | None = None, clip_at_zero: bool = False) -> DataFrame:
    """Predict hour by hour from the last reading on, each prediction feeding the next.

    ``inputs`` covers a :func:`forecast_window`, so a station is a few hundred rows whatever its
    history. Stations are spread over tasks; inside a task they step through their hours
    side by side, ``CHUNK`` stations at a time, which also bounds what a worker holds. A station
    without any reading yields no rows. Features that no tree cuts, and those that stepping redoes, are neither
    computed nor shuffled.
    """
    model, used = (fitted.ensemble if trees is None else fitted.ensemble.first(trees)).over_used(list(fitted.features))
    names = [fitted.features[i] for i in used]
    known = [name for name in names if name not in REDONE]

    def run(batches):
        for chunk in _whole_stations(batches):
            yield _step_chunk(chunk, model, names, clip_at_zero)

    schema = "Province string, Datetime timestamp_ntz, Predicted_PM25 double, last_ts timestamp_ntz"
    ordered = inputs.select("Province", "Datetime", "PM25", *known).repartition("Province").sortWithinPartitions("Province", "Datetime")
    return ordered.mapInPandas(run, schema)


CHUNK = 64
#: features that depend on PM25, which ``_refreshed`` computes at each step
REDONE = {
    *[f"pm25_lag_{k}h" for k in PM25_LAGS], *[f"pm25_roll_{stat}_{n}h" for n in PM25_WINDOWS for stat in ("mean", "std", "max")],
    "pm25_delta_1h", "pm25_delta_24h",
}


def _whole_stations(batches):
    """Regroup sorted batches into frames of at least ``CHUNK`` complete stations."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if held["Province"].nunique() > CHUNK:
            unfinished = held["Province"] == held["Province"].iloc[-1]
            yield held[~unfinished].reset_index(drop=True)
            held = held[unfinished].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _step_chunk(pdf: pd.DataFrame, model, names: list[str], clip_at_zero: bool) -> pd.DataFrame:
    place = {name: i for i, name in enumerate(names)}
    x = pdf.reindex(columns=names).to_numpy(dtype=float)  # without those that are redone
    pm25 = pdf["PM25"].to_numpy(dtype=float).copy()
    starts = np.flatnonzero(pdf["Province"].ne(pdf["Province"].shift()).to_numpy())
    ends = np.append(starts[1:], len(pdf))
    firsts, last_of = [], np.empty(len(pdf), dtype=np.int64)
    for start, end in zip(starts, ends):
        seen = np.flatnonzero(~np.isnan(pm25[start:end]))
        first = start + seen[-1] + 1 if seen.size else end
        firsts.append(first)
        last_of[start:end] = first - 1
    firsts = np.array(firsts)
    memory = max(PM25_WINDOWS)
    recent = np.full((len(starts), memory), np.nan)
    for k, (start, first) in enumerate(zip(starts, firsts)):
        tail = pm25[max(start, first - memory) : first]
        recent[k, memory - len(tail) :] = tail
    for step in range(int((ends - firsts).max(initial=0))):
        live = np.flatnonzero(firsts + step < ends)
        rows = firsts[live] + step
        x[rows] = _refreshed(x[rows], recent[live], place)
        value = model.predict(x[rows])
        pm25[rows] = np.maximum(value, 0.0) if clip_at_zero else value
        recent[live, :-1] = recent[live, 1:]
        recent[live, -1] = pm25[rows]
    ahead = np.concatenate([np.arange(f, e) for f, e in zip(firsts, ends)] or [np.empty(0, np.int64)]).astype(np.int64)
    out = pdf.iloc[ahead]
    return pd.DataFrame({
        "Province": out["Province"].to_numpy(),
        "Datetime": out["Datetime"].to_numpy(),
        "Predicted_PM25": pm25[ahead],
        "last_ts": pdf["Datetime"].to_numpy()[last_of[ahead]],
    })


def _refreshed(x: np.ndarray, recent: np.ndarray, place: dict[str, int]) -> np.ndarray:
    """Redo the features that depend on PM25, one row per station; what is missing becomes 0.

    ``recent`` holds the hours before the row, the latest one last.
    """
    x = x.copy()

    def put(name: str, value) -> None:
        if name in place:
            x[:, place[name]] = value

    for k in PM25_LAGS:
        put(f"pm25_lag_{k}h", recent[:, -k])
    present = ~np.isnan(recent)
    with np.errstate(invalid="ignore", divide="ignore"):
        for n in PM25_WINDOWS:
            if not any(f"pm25_roll_{stat}_{n}h" in place for stat in ("mean", "std", "max")):
                continue
            window, has = recent[:, -n:], present[:, -n:]
            count = has.sum(axis=1)
            mean = np.where(has, window, 0.0).sum(axis=1) / count
            spread = (np.where(has, window - mean[:, None], 0.0) ** 2).sum(axis=1)
            put(f"pm25_roll_mean_{n}h", mean)
            put(f"pm25_roll_std_{n}h", np.where(count > 1, np.sqrt(spread / (count - 1)), np.nan))
            put(f"pm25_roll_max_{n}h", np.where(has, window, -np.inf).max(axis=1))
    put("pm25_delta_1h", recent[:, -1] - recent[:, -2])
    put("pm25_delta_24h", recent[:, -1] - recent[:, -25])
    x[~np.isfinite(x)] = 0.0
    return x
