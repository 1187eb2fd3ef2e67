"""Feature queries."""

from hazelake.catalog.register import query
from hazelake.catalog.tables import TRAIN_END
from hazelake.constants import FEATURES, FIRE_LAGS, FIRE_WINDOWS, PM25_LAGS, PM25_WINDOWS
from hazelake.operators.series import Rolling, lags, windowed, with_rolling
from hazelake.plans import features as X

TWO_PI = "(2e0 * pi())"


def _w(length: int) -> str:
    return f"(PARTITION BY Province ORDER BY Datetime ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"


def _i(length: int) -> str:
    return f"(PARTITION BY Province ORDER BY Datetime ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"


SERIES = "(PARTITION BY Province ORDER BY Datetime)"


def _lag_sql():
    return [f"lag(PM25, {k}) OVER {SERIES} AS pm25_lag_{k}h" for k in PM25_LAGS]


def _fire_lag_sql(serving=False):
    out = []
    for k in FIRE_LAGS:
        logged = f"ln(1e0 + lag(hotspot_count, {k}) OVER {SERIES})"
        out += [
            f"lag(hotspot_count, {k}) OVER {SERIES} AS hotspot_lag_{k}h",
            f"lag(frp_sum, {k}) OVER {SERIES} AS frp_sum_lag_{k}h",
            f"{logged if serving else f'coalesce({logged}, 0e0)'} AS hotspot_log_lag_{k}h",
        ]
    return out


def _rolling_sql(serving=False):
    out = []
    for n in PM25_WINDOWS:
        for stat, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")):
            if serving:
                out.append(f"CASE WHEN count(PM25) OVER {_i(n)} = {n} THEN {f}(PM25) OVER {_i(n)} END AS pm25_roll_{stat}_{n}h")
            else:
                out.append(f"{f}(PM25) OVER {_w(n)} AS pm25_roll_{stat}_{n}h")
    return out + _fire_sum_sql(serving)


def _fire_sum_sql(serving=False):
    out = []
    for column, name in (("hotspot_count", "hotspot"), ("frp_sum", "frp")):
        for n in FIRE_WINDOWS:
            if serving:
                out.append(f"CASE WHEN count({column}) OVER {_i(n)} = {n} THEN sum({column}) OVER {_i(n)} END AS {name}_roll_sum_{n}h")
            else:
                out.append(f"sum({column}) OVER {_w(n)} AS {name}_roll_sum_{n}h")
    return out


def _delta_sql(serving=False):
    humidity = [
        f"relative_humidity_2m - lag(relative_humidity_2m, {k}) OVER {SERIES} AS humidity_delta_{k}h" for k in (1, 24)
    ]
    if serving:
        return [f"PM25 - lag(PM25, {k}) OVER {SERIES} AS pm25_delta_{k}h" for k in (1, 24)] + humidity
    return [
        f"lag(PM25, 1) OVER {SERIES} - lag(PM25, {k + 1}) OVER {SERIES} AS pm25_delta_{k}h" for k in (1, 24)
    ] + humidity


def _cyclic_sql(serving=False):
    months, period = ("1, 2, 3, 4", 31) if serving else ("3, 4", 365)
    out = []
    for name, part, length in (("hour", "hour(Datetime)", 24), ("month", "month(Datetime)", 12), ("day", "day(Datetime)", period)):
        for f in ("sin", "cos"):
            out.append(f"{f}({TWO_PI} * {part} / {length}e0) AS {name}_{f}")
    out += [f"{f}(radians(wind_direction_10m)) AS wind_dir_{f}" for f in ("sin", "cos")]
    return out + [f"CASE WHEN month(Datetime) IN ({months}) THEN 1 ELSE 0 END AS is_haze_season"]


def _interaction_sql(serving=False):
    haze = f"(CASE WHEN month(Datetime) IN ({'1, 2, 3, 4' if serving else '3, 4'}) THEN 1 ELSE 0 END)"
    scale = "" if serving else " / 1e2"
    return [
        "ln(1e0 + precipitation) AS precipitation_log",
        "ln(1e0 + hotspot_count) AS hotspot_log",
        "ln(1e0 + frp_sum) AS frp_sum_log",
        "ln(1e0 + frp_mean) AS frp_mean_log",
        f"temperature_2m * relative_humidity_2m{scale} AS temp_x_humidity",
        f"ln(1e0 + hotspot_count) * {haze} AS hotspot_x_haze",
        f"ln(1e0 + frp_sum) * {haze} AS frp_x_haze",
        "wind_speed_10m * ln(1e0 + hotspot_count) AS wind_x_hotspot",
    ]


def _select(expressions, table="panel"):
    return f"SELECT Province, Datetime, {', '.join(expressions)} FROM {table}"


def _names(expressions):
    return " ".join(e.rsplit(" AS ", 1)[1] + "~4" for e in expressions)


def _windowed(t, build, back, columns):
    frame = t.panel.select("Province", "Datetime", *columns)
    return windowed(frame, "Province", "Datetime", build=build, back=back, spacing="hourly")


@query("lag_features", "Province Datetime " + _names(_lag_sql()), _select(_lag_sql()))
def lag_features(t):
    return _windowed(t, X.pm25_lag_columns, max(PM25_LAGS), ["PM25"])


@query("fire_lag_features", "Province Datetime " + _names(_fire_lag_sql()), _select(_fire_lag_sql()))
def fire_lag_features(t):
    return _windowed(t, X.fire_lag_columns, max(FIRE_LAGS), ["hotspot_count", "frp_sum"])


_ROLL = _rolling_sql()[: 3 * len(PM25_WINDOWS)]


@query("rolling_lagged", "Province Datetime " + _names(_ROLL), _select(_ROLL))
def rolling_lagged(t):
    frame = t.observed.select("Province", "Datetime", "PM25")
    return with_rolling(frame, "Province", "Datetime", [X.PM25_ROLLING], spacing="hourly")


@query("rolling_fire_sums", "Province Datetime " + _names(_fire_sum_sql()), _select(_fire_sum_sql()))
def rolling_fire_sums(t):
    frame = t.panel.select("Province", "Datetime", "hotspot_count", "frp_sum")
    return with_rolling(frame, "Province", "Datetime", X.FIRE_ROLLING, spacing="hourly")


_FULL = [
    f"CASE WHEN count(PM25) OVER {_i(n)} = {n} THEN {f}(PM25) OVER {_i(n)} END AS pm25_rolling_{stat}_{n}"
    for n in (3, 7, 14)
    for stat, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("sum", "sum"))
]


@query("rolling_inclusive", "Province Datetime " + _names(_FULL), _select(_FULL))
def rolling_inclusive(t):
    spec = Rolling("PM25", (3, 7, 14), {s: f"pm25_rolling_{s}_{{}}" for s in ("mean", "std", "max", "sum")})
    frame = t.observed.select("Province", "Datetime", "PM25")
    return with_rolling(frame, "Province", "Datetime", [spec], inclusive=True, spacing="hourly")


@query("delta_features", "Province Datetime " + _names(_delta_sql()), _select(_delta_sql()))
def delta_features(t):
    return _windowed(t, X.delta_columns, 25, ["PM25", "relative_humidity_2m"])


_GENERIC = [f"lag(temperature_2m, {k}) OVER {SERIES} AS temperature_2m_lag_{k}" for k in (1, 2, 3, 7)]


@query("lag_generic", "Province Datetime " + _names(_GENERIC), _select(_GENERIC, "weather"))
def lag_generic(t):
    frame = t.weather.select("Province", "Datetime", "temperature_2m")
    build = lambda w: lags(w, "temperature_2m", [1, 2, 3, 7], "temperature_2m_lag_{}")
    return windowed(frame, "Province", "Datetime", build=build, back=7)


@query("cyclic_features", "Province Datetime " + _names(_cyclic_sql()), _select(_cyclic_sql(), "shifted"))
def cyclic_features(t):
    return t.shifted.withColumns(X.cyclic_columns())


@query("interaction_features", "Province Datetime " + _names(_interaction_sql()), _select(_interaction_sql(), "shifted"))
def interaction_features(t):
    return t.shifted.withColumns(X.interaction_columns())


def _matrix_sql(serving=False):
    windows = _lag_sql() + _fire_lag_sql(serving) + _rolling_sql(serving) + _delta_sql(serving)
    plain = _cyclic_sql(serving) + _interaction_sql(serving)
    code = "coalesce(c.province_label, -1) AS province_label, coalesce(c.province_target_enc, 0e0) AS province_target_enc"
    body = f"""SELECT p.*, year(p.Datetime) AS year, {code}, {', '.join(windows + plain)}
      FROM panel p LEFT JOIN codes c USING (Province)"""
    body = body.replace("BY Province ORDER", "BY p.Province ORDER")
    return f"SELECT * FROM ({body}) AS m" + (" WHERE pm25_lag_72h IS NOT NULL" if serving else "")


MATRIX_COLUMNS = "Province Datetime PM25~4 " + " ".join(f"{f}~4" for f in FEATURES)
TRAIN_CODES = f"""SELECT Province, row_number() OVER (ORDER BY Province) - 1 AS province_label,
  avg(PM25) AS province_target_enc FROM panel WHERE Datetime <= TIMESTAMP '{TRAIN_END}' GROUP BY Province"""
FRAME_CODES = """SELECT Province, row_number() OVER (ORDER BY Province) - 1 AS province_label,
  avg(PM25) AS province_target_enc FROM panel GROUP BY Province"""


def training_features(t):
    encoding = X.target_encoding(t.weather, TRAIN_END, readings=t.pm25)
    return X.feature_matrix_from_sources(t.weather, t.pm25, t.daily_sparse, encoding)


@query("feature_matrix", MATRIX_COLUMNS, _matrix_sql(), codes=TRAIN_CODES)
def feature_matrix(t):
    return training_features(t)


@query("feature_matrix_serving", MATRIX_COLUMNS, _matrix_sql(True), codes=FRAME_CODES)
def feature_matrix_serving(t):
    encoding = X.frame_encoding(t.weather, readings=t.pm25)
    return X.feature_matrix_from_sources(t.weather, t.pm25, t.daily_sparse, encoding, profile="serving")


@query("feature_matrix_of_panel", MATRIX_COLUMNS, _matrix_sql(), codes=TRAIN_CODES)
def feature_matrix_of_panel(t):
    """The same matrix for a panel that is already assembled, of any spacing."""
    return X.feature_matrix(t.panel, X.target_encoding(t.weather, TRAIN_END, readings=t.pm25), day="date")


@query(
    "feature_catalog",
    "ordinal# feature_group feature n_present",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{g}' AS feature_group, '{f}' AS feature, count({f}) AS n_present FROM matrix"
        for i, (g, f) in enumerate((g, f) for g, names in X.FEATURE_GROUPS.items() for f in names)
    ) + ") AS c",
    codes=TRAIN_CODES,
    matrix=_matrix_sql(),
)
def feature_catalog(t):
    return X.feature_catalog(training_features(t))


@query(
    "target_encoding",
    "Province province_label# province_target_enc~",
    "SELECT * FROM codes",
    codes=TRAIN_CODES.replace("FROM panel", "FROM observed"),
)
def target_encoding(t):
    return X.target_encoding(t.weather, TRAIN_END, readings=t.pm25)
