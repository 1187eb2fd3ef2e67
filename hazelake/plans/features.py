"""The 69-column feature matrix, in the two published profiles.

``training`` never lets a row see its own target: frames end one row earlier. ``serving`` uses
frames that include the current row and slightly different encodings; do not train on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazelake.constants import (
    FEATURE_GROUPS,
    FEATURES,
    FIRE_COLUMNS,
    FIRE_LAGS,
    FIRE_WINDOWS,
    PM25_LAGS,
    PM25_WINDOWS,
    WEATHER_COLUMNS,
)
from hazelake.functions import scalar as S
from hazelake.operators.series import (
    BLOCK,
    BLOCK_ROWS,
    block_window,
    from_blocks,
    hourly_span,
    Rolling,
    add_columns,
    label_encode,
    lags,
    rolling,
    to_blocks,
)
from hazelake.operators.splits import complete_cases, ntz

PANEL_COLUMNS = ["Province", "Datetime", "PM25", *WEATHER_COLUMNS, *FIRE_COLUMNS]
HISTORY_ROWS = max(*PM25_LAGS, *PM25_WINDOWS, *FIRE_WINDOWS, 25)


@dataclass(frozen=True)
class Profile:
    haze_months: tuple[int, ...]
    day_period: int
    humidity_scale: float
    inclusive: bool


PROFILES = {
    "training": Profile(haze_months=(3, 4), day_period=365, humidity_scale=100.0, inclusive=False),
    "serving": Profile(haze_months=(1, 2, 3, 4), day_period=31, humidity_scale=1.0, inclusive=True),
}


# ------------------------------------------------------------------ row-wise features
def cyclic_columns(profile: str = "training", ts: str = "Datetime") -> dict[str, Column]:
    p = PROFILES[profile]
    out = {}
    for name, part, period in (
        ("hour", F.hour(ts), 24),
        ("month", F.month(ts), 12),
        ("day", F.dayofmonth(ts), p.day_period),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = S.cyclic(part, period)
    angle = F.radians("wind_direction_10m")
    out["wind_dir_sin"], out["wind_dir_cos"] = F.sin(angle), F.cos(angle)
    out["is_haze_season"] = S.in_months(ts, p.haze_months)
    return out


def interaction_columns(profile: str = "training", ts: str = "Datetime") -> dict[str, Column]:
    p = PROFILES[profile]
    haze = S.in_months(ts, p.haze_months)
    hotspot_log, frp_log = F.log1p("hotspot_count"), F.log1p("frp_sum")
    product = F.col("temperature_2m") * F.col("relative_humidity_2m")
    return {
        "precipitation_log": F.log1p("precipitation"),
        "hotspot_log": hotspot_log,
        "frp_sum_log": frp_log,
        "frp_mean_log": F.log1p("frp_mean"),
        "temp_x_humidity": product / F.lit(p.humidity_scale) if p.humidity_scale != 1 else product,
        "hotspot_x_haze": hotspot_log * haze,
        "frp_x_haze": frp_log * haze,
        "wind_x_hotspot": F.col("wind_speed_10m") * hotspot_log,
    }


# ------------------------------------------------------------------ windowed features
def pm25_lag_columns(w: str) -> dict[str, str]:
    return lags(w, "PM25", PM25_LAGS, "pm25_lag_{}h")


def fire_lag_columns(w: str, profile: str = "training") -> dict[str, str]:
    out = {**lags(w, "hotspot_count", FIRE_LAGS, "hotspot_lag_{}h"), **lags(w, "frp_sum", FIRE_LAGS, "frp_sum_lag_{}h")}
    for k in FIRE_LAGS:
        logged = f"log1p(lag(hotspot_count, {k}) OVER ({w}))"
        out[f"hotspot_log_lag_{k}h"] = logged if PROFILES[profile].inclusive else f"coalesce({logged}, 0D)"
    return out


PM25_ROLLING = Rolling("PM25", tuple(PM25_WINDOWS), {s: f"pm25_roll_{s}_{{}}h" for s in ("mean", "std", "max")})
FIRE_ROLLING = [
    Rolling("hotspot_count", tuple(FIRE_WINDOWS), {"sum": "hotspot_roll_sum_{}h"}),
    Rolling("frp_sum", tuple(FIRE_WINDOWS), {"sum": "frp_roll_sum_{}h"}),
]


def delta_columns(w: str, profile: str = "training") -> dict[str, str]:
    shift = 0 if PROFILES[profile].inclusive else 1

    def back(column, k):
        return f"lag({column}, {k}) OVER ({w})" if k else column

    out = {f"pm25_delta_{k}h": f"{back('PM25', shift)} - {back('PM25', shift + k)}" for k in (1, 24)}
    for k in (1, 24):
        out[f"humidity_delta_{k}h"] = f"relative_humidity_2m - {back('relative_humidity_2m', k)}"
    return out


# ------------------------------------------------------------------ station encodings
def target_encoding(panel: DataFrame, train_end, readings: DataFrame | None = None) -> DataFrame:
    """Alphabetical ordinal and mean PM25 of the stations that have training rows.

    ``readings`` may name a narrower table to take PM25 from than the panel.
    """
    known = F.col("Datetime") <= ntz(train_end)
    return _encode(panel.where(known), panel.where(known) if readings is None else readings.where(known))


def frame_encoding(panel: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Serving fallback: the mean over whatever part of the series is at hand."""
    return _encode(panel, panel if readings is None else readings)


def _encode(panel: DataFrame, readings: DataFrame) -> DataFrame:
    means = readings.groupBy("Province").agg(F.avg("PM25").alias("province_target_enc"))
    return label_encode(panel, "Province", "province_label").join(means, "Province", "left")


def _encoding_by_block(panel: DataFrame, encoding: DataFrame, block: int, spacing: str) -> DataFrame:
    """The encodings once per (station, block), to join on the key the windows need anyway.

    Joining on the station alone would pull a hot station into one task and cost the panel
    another exchange.
    """
    if spacing == "hourly":
        first, last = hourly_span("Datetime")
    else:
        first, last = F.lit(0), F.count(F.lit(1)) - 1
    spans = panel.groupBy("Province").agg(
        F.floor(first / block).alias("_first"), F.floor(last / block).alias("_last")
    )
    return spans.join(encoding, "Province", "left").select(
        "Province",
        F.explode(F.sequence("_first", "_last")).alias(BLOCK),
        F.coalesce("province_label", F.lit(-1)).alias("province_label"),
        F.coalesce("province_target_enc", F.lit(0.0)).alias("province_target_enc"),
    )


# ------------------------------------------------------------------ the matrix
def feature_matrix(
    panel: DataFrame,
    encoding: DataFrame,
    profile: str = "training",
    block: int = BLOCK_ROWS,
    spacing: str = "rows",
    day: str | None = None,
) -> DataFrame:
    """Province, Datetime, PM25 and the 69 features in stored order.

    Features only look back, so they are computed once over the whole series and any split is a
    filter afterwards. All frames share one window spec: one exchange, one sort. ``day`` may name the panel's column of
    dates, by which it was joined with daily fires.
    """
    slim = panel.select(*PANEL_COLUMNS, *([day] if day else []))
    blocks = to_blocks(slim, "Province", "Datetime", back=HISTORY_ROWS, block=block, spacing=spacing, day=day)
    return _matrix(blocks, _encoding_by_block(slim, encoding, block, spacing), profile)


def feature_matrix_from_sources(
    weather: DataFrame,
    pm25: DataFrame,
    daily: DataFrame,
    encoding: DataFrame,
    profile: str = "training",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """The same matrix straight from hourly weather, readings and daily fires."""
    blocks = merge_sources(weather, pm25, daily, block)
    return _matrix(blocks, _encoding_by_block(weather, encoding, block, "hourly"), profile)


def merge_sources(weather: DataFrame, pm25: DataFrame, daily: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the hourly panel, put together without a join.

    Two joins, on the hour and on the date, and a window on the block would shuffle the panel three
    times. Here the three tables are cut into the same blocks and stacked, one exchange brings
    a block together, and its sort order places each reading right before its hour and each day's
    fires before the hours of the day. Keys have to be unique, as they are after
    ``history_wins``, and weather has to have a row for every hour. A repeated reading or hour raises here, a missing
    hour where the encodings are laid out (``hourly_span``).
    """
    kinds = {"fires": 0, "reading": 1, "hour": 2}
    fires = F.struct("date", *[F.col(c).cast("double").alias(c) for c in FIRE_COLUMNS])
    midnight = F.col("date").cast("timestamp_ntz")

    def cut(df, kind, ahead_of_last_hour=0):
        marked = df.withColumn("_kind", F.lit(kinds[kind]))
        back = HISTORY_ROWS + ahead_of_last_hour
        return to_blocks(marked, "Province", "Datetime", back, block=block, spacing="hourly")

    stacked = (
        cut(weather.select("Province", "Datetime", *WEATHER_COLUMNS), "hour")
        .unionByName(cut(pm25.select("Province", "Datetime", "PM25"), "reading"), allowMissingColumns=True)
        .unionByName(
            cut(daily.select("Province", midnight.alias("Datetime"), fires.alias("_fires")), "fires", 23),
            allowMissingColumns=True,
        )
    )
    w = Window.partitionBy("Province", BLOCK).orderBy("Datetime", "_kind")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = {c: F.lag(c).over(w) for c in ("Datetime", "_kind", "PM25")}
    same_hour = (before["Datetime"] == F.col("Datetime")) & (before["_kind"] == kinds["reading"])
    again = (before["Datetime"] == F.col("Datetime")) & (before["_kind"] == F.col("_kind"))
    twice = F.raise_error(F.lit("a station has an hour, a reading or a day's fires twice")).cast("double")
    placed = stacked.withColumns({
        "PM25": F.when(again, twice).when(same_hour, before["PM25"]),
        "_fires": F.last("_fires", ignorenulls=True).over(upto),
    }).where(F.col("_kind") == kinds["hour"])
    same_day = F.col("_fires.date") == F.to_date("Datetime")
    return placed.withColumns({
        c: F.when(same_day, F.coalesce(F.col(f"_fires.{c}"), F.lit(0.0))).otherwise(0.0) for c in FIRE_COLUMNS
    }).drop("_fires", "_kind")


def _matrix(blocks: DataFrame, codes: DataFrame, profile: str) -> DataFrame:
    w = block_window("Province", "Datetime")
    coded = blocks.join(codes, ["Province", BLOCK], "left")
    rolled = rolling(coded, w, [PM25_ROLLING, *FIRE_ROLLING], PROFILES[profile].inclusive)
    built = add_columns(rolled, {
        **pm25_lag_columns(w),
        **fire_lag_columns(w, profile),
        **delta_columns(w, profile),
    })
    own = from_blocks(built).withColumns({
        **cyclic_columns(profile),
        **interaction_columns(profile),
        "year": F.year("Datetime"),
    })
    if profile == "serving":
        own = complete_cases(own, ["pm25_lag_72h"])
    return own.select("Province", "Datetime", "PM25", *FEATURES)


def feature_catalog(features: DataFrame) -> DataFrame:
    """Ordinal, group, name of every feature and the number of rows that have it."""
    rows = features.agg(*[F.count(f).alias(f) for f in FEATURES])
    group_of = {f: g for g, names in FEATURE_GROUPS.items() for f in names}
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(group_of[f]).alias("feature_group"),
            F.lit(f).alias("feature"),
            F.col(f).alias("n_present"),
        )
        for i, f in enumerate(FEATURES)
    ]
    return rows.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
