"""Exploratory statistics."""

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from hazelake.catalog.register import query
from hazelake.catalog.tables import TRAIN_END, VALIDATION_END
from hazelake.constants import AUTOCORR_LAGS, EXTREME_PM25, FIRE_COLUMNS, NUMERIC_COLUMNS
from hazelake.functions import scalar as S
from hazelake.operators import fires, series, splits, stats
from hazelake.plans.explain import linear_attribution
from hazelake.plans.model import fit_scaler

MONTHS = range(1, 13)
SERIES = "(PARTITION BY Province ORDER BY Datetime)"
FIRES = " ".join(f"{c}~" for c in FIRE_COLUMNS)


@query("hotspot_daily", f"date@ Province {FIRES}", "SELECT * FROM daily_sparse")
def hotspot_daily(t):
    return fires.daily_totals(t.located)


@query(
    "panel_profile",
    "n_rows first_ts last_ts n_keys " + " ".join(f"null_{c}" for c in NUMERIC_COLUMNS),
    "SELECT count(*) AS n_rows, min(Datetime) AS first_ts, max(Datetime) AS last_ts, count(DISTINCT Province) AS n_keys, "
    + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in NUMERIC_COLUMNS) + " FROM panel",
)
def panel_profile(t):
    return stats.profile(t.panel, "Datetime", "Province", NUMERIC_COLUMNS)


@query(
    "describe_long",
    "column n mean~ std~ min~ q25~ q50~ q75~ max~",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
        max({c}) AS max FROM panel""" for c in NUMERIC_COLUMNS
    ),
)
def describe_long(t):
    return stats.describe_long(t.panel, NUMERIC_COLUMNS)


@query(
    "shape_stats",
    "Province n skewness~ kurtosis~",
    "SELECT Province, count(PM25) AS n, skewness(PM25) AS skewness, kurtosis(PM25) AS kurtosis FROM pm25 GROUP BY 1",
)
def shape_stats(t):
    return stats.shape_stats(t.pm25, "PM25", ["Province"])


@query(
    "fire_conditional_means",
    "Province with_fire~ no_fire~",
    """SELECT Province, avg(CASE WHEN hotspot_count > 0 THEN PM25 END) AS with_fire,
      avg(CASE WHEN hotspot_count = 0 THEN PM25 END) AS no_fire FROM panel GROUP BY 1""",
)
def fire_conditional_means(t):
    burning, quiet = F.col("hotspot_count") > 0, F.col("hotspot_count") == 0
    return t.panel.groupBy("Province").agg(
        F.avg(F.when(burning, F.col("PM25"))).alias("with_fire"), F.avg(F.when(quiet, F.col("PM25"))).alias("no_fire")
    )


@query(
    "monthly_mean_std",
    "month# mean~ std~",
    "SELECT month(Datetime) AS month, avg(PM25) AS mean, stddev_samp(PM25) AS std FROM shifted GROUP BY 1",
)
def monthly_mean_std(t):
    return stats.mean_std_by(t.shifted, "PM25", month=F.month("Datetime"))


@query("diurnal_mean", "hour# mean~", "SELECT hour(Datetime) AS hour, avg(PM25) AS mean FROM observed GROUP BY 1")
def diurnal_mean(t):
    return stats.mean_by(t.observed, "PM25", hour=F.hour("Datetime"))


@query("province_mean", "Province mean~", "SELECT Province, avg(PM25) AS mean FROM observed GROUP BY 1 ORDER BY mean DESC")
def province_mean(t):
    return stats.mean_by(t.observed, "PM25", Province=F.col("Province")).orderBy(F.desc("mean"))


def _pivot_sql(key, table="shifted"):
    cells = ", ".join(f"avg(CASE WHEN month(Datetime) = {m} THEN PM25 END) AS m{m:02d}" for m in MONTHS)
    return f"SELECT {key}, {cells} FROM {table} GROUP BY 1"


@query("pivot_province_month", "Province " + " ".join(f"m{m:02d}~" for m in MONTHS), _pivot_sql("Province"))
def pivot_province_month(t):
    return stats.pivot_months(t.shifted, "Province", F.avg("PM25"))


@query("pivot_hour_month", "hour# " + " ".join(f"m{m:02d}~" for m in MONTHS), _pivot_sql("hour(Datetime) AS hour"))
def pivot_hour_month(t):
    return stats.pivot_months(t.shifted.withColumn("hour", F.hour("Datetime")), "hour", F.avg("PM25"))


@query(
    "year_month_mean",
    "year# month# mean~",
    "SELECT year(Datetime) AS year, month(Datetime) AS month, avg(PM25) AS mean FROM shifted GROUP BY 1, 2",
)
def year_month_mean(t):
    return stats.mean_by(t.shifted, "PM25", year=F.year("Datetime"), month=F.month("Datetime"))


@query(
    "extreme_counts",
    "Province " + " ".join(f"m{m:02d}#" for m in MONTHS),
    "SELECT Province, "
    + ", ".join(f"count(CASE WHEN month(Datetime) = {m} THEN 1 END) AS m{m:02d}" for m in MONTHS)
    + f" FROM shifted WHERE PM25 > {EXTREME_PM25}e0 GROUP BY 1",
)
def extreme_counts(t):
    extreme = t.shifted.where(F.col("PM25") > EXTREME_PM25)
    return stats.pivot_months(extreme, "Province", F.count(F.lit(1))).na.fill(0)


@query(
    "value_counts",
    "column value n",
    """SELECT 'confidence' AS "column", confidence AS value, count(*) AS n FROM hotspots WHERE confidence IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'type', CAST(type AS VARCHAR), count(*) FROM hotspots WHERE type IS NOT NULL GROUP BY 2""",
)
def value_counts(t):
    return stats.value_counts(t.hotspots, ["confidence", "type"]).orderBy("column", F.desc("n"))


@query(
    "confidence_profile",
    "confidence column mean~ median~",
    " UNION ALL ".join(
        f"""SELECT confidence, '{c}' AS "column", avg({c}) AS mean, median({c}) AS median FROM hotspots
        WHERE confidence IS NOT NULL GROUP BY 1""" for c in ("bright_ti4", "frp")
    ),
)
def confidence_profile(t):
    return stats.mean_median_by(t.hotspots, "confidence", ["bright_ti4", "frp"])


@query("hotspot_monthly", "month# n", "SELECT month(acq_date) AS month, count(*) AS n FROM hotspots GROUP BY 1")
def hotspot_monthly(t):
    return t.hotspots.groupBy(F.month("acq_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "zero_fire_report",
    "n_rows first_date@ last_date@ zero_fire_rows",
    """SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
      count(CASE WHEN hotspot_count = 0 THEN 1 END) AS zero_fire_rows FROM daily""",
)
def zero_fire_report(t):
    return t.daily.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("hotspot_count") == 0).alias("zero_fire_rows"),
    )


def _pairs_sql(pairs, table):
    rows = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {table}" for a, b in pairs]
    return "SELECT col_a, col_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM (" + " UNION ALL ".join(rows) + ")"


@query("correlation_matrix", "col_a col_b r~", _pairs_sql(list(combinations_with_replacement(NUMERIC_COLUMNS, 2)), "panel"))
def correlation_matrix(t):
    return stats.correlation_matrix(t.panel, NUMERIC_COLUMNS)


TARGET_PAIRS = [("PM25", c) for c in NUMERIC_COLUMNS[1:]]


@query("target_correlation", "col_b r~", _pairs_sql(TARGET_PAIRS, "panel"))
def target_correlation(t):
    return stats.correlation_pairs(t.panel, TARGET_PAIRS).orderBy("r")


LAG_OFFSETS = [1, 2, 3, 6, 12, 24]
LAGGED = f"""SELECT * FROM (SELECT *, {', '.join(f'lag(PM25, {k}) OVER {SERIES} AS pm25_lag_{k}h' for k in LAG_OFFSETS)},
  ln(1e0 + hotspot_count) AS log_hotspot, ln(1e0 + frp_sum) AS log_frp_sum,
  CASE WHEN month(Datetime) IN (3, 4) THEN 1 ELSE 0 END AS is_haze_season,
  hour(Datetime) AS hour, month(Datetime) AS month FROM shifted) AS l
  WHERE PM25 IS NOT NULL AND {' AND '.join(f'pm25_lag_{k}h IS NOT NULL' for k in LAG_OFFSETS)}"""
LAG_FEATURES = [f"pm25_lag_{k}h" for k in LAG_OFFSETS] + [
    "log_hotspot", "log_frp_sum", "relative_humidity_2m", "precipitation", "temperature_2m", "wind_speed_10m",
    "is_haze_season", "hour", "month",
]
LAG_PAIRS = [("PM25", c) for c in LAG_FEATURES]


@query(
    "lag_feature_correlation",
    "feature abs_r~",
    f"SELECT col_b AS feature, abs(r) AS abs_r FROM ({_pairs_sql(LAG_PAIRS, 'lagged')})",
    lagged=LAGGED,
)
def lag_feature_correlation(t):
    lagged = series.windowed(
        t.shifted, "Province", "Datetime",
        build=lambda w: series.lags(w, "PM25", LAG_OFFSETS, "pm25_lag_{}h"), back=max(LAG_OFFSETS), spacing="hourly",
    ).withColumns({
        "log_hotspot": F.log1p("hotspot_count"),
        "log_frp_sum": F.log1p("frp_sum"),
        "is_haze_season": S.in_months("Datetime", (3, 4)),
        "hour": F.hour("Datetime"),
        "month": F.month("Datetime"),
    })
    complete = splits.complete_cases(lagged, ["PM25", *LAG_FEATURES])
    pairs = stats.correlation_pairs(complete, LAG_PAIRS)
    return pairs.select(F.col("col_b").alias("feature"), F.abs("r").alias("abs_r")).orderBy("abs_r")


@query(
    "autocorrelation",
    "Province lag_h# r~",
    "SELECT Province, lag_h, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM ("
    + " UNION ALL ".join(
        f"""SELECT Province, {k} AS lag_h, corr(PM25, x) AS r FROM (
        SELECT Province, PM25, lag(PM25, {k}) OVER {SERIES} AS x FROM observed) GROUP BY 1""" for k in AUTOCORR_LAGS
    ) + ")",
)
def autocorrelation(t):
    return stats.autocorrelation(t.observed, "Province", "Datetime", "PM25", AUTOCORR_LAGS, spacing="hourly")


def _histogram_sql(column, bins, table, where="TRUE"):
    return f"""SELECT b.bin, s.lo + b.bin * s.w AS lo, s.lo + (b.bin + 1) * s.w AS hi, coalesce(c.n, 0) AS n,
      coalesce(c.n, 0) / (s.n * s.w) AS density FROM (SELECT unnest(range({bins})) AS bin) b
      CROSS JOIN (SELECT min(x) AS lo, (max(x) - min(x)) / {bins}e0 AS w, count(x) AS n FROM (SELECT {column} AS x FROM {table} WHERE {where})) s
      LEFT JOIN (SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS INT) AS bin, count(*) AS n FROM (
        SELECT {column} AS x FROM {table} WHERE {where}) CROSS JOIN (
        SELECT min(x) AS lo, (max(x) - min(x)) / {bins}e0 AS w FROM (SELECT {column} AS x FROM {table} WHERE {where}))
        WHERE x IS NOT NULL GROUP BY 1) c ON c.bin = b.bin"""


HISTOGRAM = "bin# lo~ hi~ n density~"


@query("histogram", HISTOGRAM, _histogram_sql("PM25", 80, "pm25"))
def histogram(t):
    return stats.histogram(t.pm25, "PM25", 80)


@query("histogram_log1p", HISTOGRAM, _histogram_sql("ln(1e0 + PM25)", 100, "pm25"))
def histogram_log1p(t):
    return stats.histogram(t.pm25, F.log1p("PM25"), 100)


@query("histogram_fires", HISTOGRAM, _histogram_sql("ln(1e0 + frp_sum)", 80, "panel", "hotspot_count > 0"))
def histogram_fires(t):
    return stats.histogram(t.panel.where("hotspot_count > 0"), F.log1p("frp_sum"), 80)


RESIDUAL = f"SELECT Province, Datetime, PM25, lag(PM25, 1) OVER {SERIES} AS predicted FROM observed"


def persistence(t):
    """The reading an hour ago as prediction."""
    lagged = series.windowed(
        t.observed.select("Province", "Datetime", "PM25"), "Province", "Datetime",
        build=lambda w: series.lags(w, "PM25", [1], "predicted"), back=1, spacing="hourly",
    )
    return splits.time_split(lagged, "Datetime", TRAIN_END, VALIDATION_END)


@query(
    "residual_histogram",
    HISTOGRAM + " mean_residual~",
    f"""SELECT h.*, m.mean_residual FROM ({_histogram_sql('predicted - PM25', 80, 'residual')}) h
      CROSS JOIN (SELECT avg(predicted - PM25) AS mean_residual FROM residual) m""",
    residual=RESIDUAL,
)
def residual_histogram(t):
    residual = persistence(t).select((F.col("predicted") - F.col("PM25")).alias("residual"))
    mean = residual.select(F.avg("residual")).scalar()
    return stats.histogram(residual, "residual", 80).withColumn("mean_residual", mean)


@query(
    "regression_metrics",
    "split n mae~ rmse~ r2~ mape~",
    f"""SELECT split, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
      1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2, 1e2 * avg(abs((y - p) / (y + 1e-8))) AS mape FROM (
      SELECT CASE WHEN Datetime <= TIMESTAMP '{TRAIN_END}' THEN 'train'
        WHEN Datetime <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split,
        PM25 AS y, greatest(predicted, 0e0) AS p FROM residual WHERE PM25 IS NOT NULL AND predicted IS NOT NULL) GROUP BY 1""",
    residual=RESIDUAL,
)
def regression_metrics(t):
    return stats.regression_metrics(persistence(t), "PM25", "predicted", ["split"])


@query(
    "actual_vs_predicted",
    "Province Datetime PM25~ predicted~",
    f"""SELECT Province, Datetime, PM25, greatest(predicted, 0e0) AS predicted FROM (
      SELECT Province, Datetime, PM25, lag(PM25, 1) OVER {SERIES} AS predicted FROM shifted)
      WHERE month(Datetime) IN (3, 4) AND predicted IS NOT NULL AND PM25 IS NOT NULL""",
)
def actual_vs_predicted(t):
    lagged = series.windowed(
        t.shifted.select("Province", "Datetime", "PM25"), "Province", "Datetime",
        build=lambda w: series.lags(w, "PM25", [1], "predicted"), back=1, spacing="hourly",
    )
    haze = lagged.where(F.month("Datetime").isin(3, 4)).dropna(subset=["PM25", "predicted"])
    return haze.withColumn("predicted", S.clip_at_zero("predicted"))


@query(
    "linear_trend",
    "trend slope~ intercept~ r~ n#",
    """SELECT 'log_hotspots' AS trend, regr_slope(PM25, x) AS slope, regr_intercept(PM25, x) AS intercept,
      corr(x, PM25) AS r, regr_count(PM25, x) AS n FROM (SELECT PM25, ln(1e0 + hotspot_count) AS x FROM panel WHERE hotspot_count > 0)
      UNION ALL SELECT 'previous_hour', regr_slope(PM25, predicted), regr_intercept(PM25, predicted),
      corr(predicted, PM25), regr_count(PM25, predicted) FROM residual""",
    residual=RESIDUAL,
)
def linear_trend(t):
    burning = t.panel.where("hotspot_count > 0")
    on_fires = burning.agg(*stats.linear_trend("PM25", F.log1p("hotspot_count"))).withColumn("trend", F.lit("log_hotspots"))
    on_lag = persistence(t).agg(*stats.linear_trend("PM25", "predicted")).withColumn("trend", F.lit("previous_hour"))
    return on_fires.unionByName(on_lag)


@query(
    "province_density",
    "Province point# grid~ density~ median~",
    """SELECT s.Province, g.point, s.lo + g.point * (s.hi - s.lo) / 99e0 AS grid,
      sum(exp(-0.5e0 * pow((s.lo + g.point * (s.hi - s.lo) / 99e0 - p.PM25) / s.h, 2))) / (s.n * s.h * sqrt(2e0 * pi())) AS density,
      s.median FROM (SELECT Province, count(PM25) AS n, min(PM25) AS lo, max(PM25) AS hi, median(PM25) AS median,
        pow(count(PM25), -0.2e0) * stddev_samp(PM25) AS h FROM pm25 GROUP BY 1) s
      CROSS JOIN (SELECT unnest(range(100)) AS point) g JOIN pm25 p ON p.Province = s.Province
      GROUP BY s.Province, g.point, s.lo, s.hi, s.h, s.n, s.median""",
)
def province_density(t):
    return stats.density_curves(t.pm25, "Province", "PM25")


STANDARD = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "PM25"]


@query(
    "standardize",
    "feature mean~ scale~",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS scale FROM observed" for c in STANDARD
    ),
)
def standardize(t):
    return fit_scaler(t.observed, STANDARD)


_COEF = {"temperature_2m": 0.3, "relative_humidity_2m": -0.2, "surface_pressure": 0.05, "wind_speed_10m": -0.7}


@query(
    "attribution_linear",
    "Province Datetime feature value~ contribution~",
    " UNION ALL ".join(
        f"""SELECT Province, Datetime, '{c}' AS feature, {c} AS value,
        {b}e0 * ({c} - (SELECT avg({c}) FROM weather)) AS contribution FROM weather""" for c, b in _COEF.items()
    ),
)
def attribution_linear(t):
    return linear_attribution(t.weather, _COEF, ["Province", "Datetime"])
