"""Alerting tables."""

from pyspark.sql import functions as F

from hazelake.catalog.q_tables import LINEAR, SERVING, batch_tables, daily_batch_linear as batch, serving_frame as serving
from hazelake.catalog.register import query
from hazelake.catalog.tables import NOW
from hazelake.constants import AUDIENCE_THRESHOLDS, RISK_LEVELS
from hazelake.operators import fires, splits
from hazelake.operators.lookup import lookup
from hazelake.plans import alerts

#: days of fires that are ranked, the published default
RECENT_DAYS = 30

LIVE = {**LINEAR, "live": SERVING + " "}


def _level_sql(value, attribute=1):
    arms = " ".join(f"WHEN {value} <= {level[0]}e0 THEN '{level[attribute]}'" for level in RISK_LEVELS[:-1])
    return f"CASE {arms} ELSE '{RISK_LEVELS[-1][attribute]}' END"


def forecast_part(t):
    return alerts.forecast_rows(serving(t), NOW)


AHEAD_ROWS = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Province ORDER BY Datetime) AS rn
  FROM live WHERE Datetime > TIMESTAMP '{NOW}') AS f WHERE rn <= 168"""


@query(
    "risk_level",
    "Province Datetime PM25~ level label colour advice is_missing",
    f"""SELECT Province, Datetime, PM25, {_level_sql('PM25')} AS level, {_level_sql('PM25', 2)} AS label,
      {_level_sql('PM25', 3)} AS colour, {_level_sql('PM25', 4)} AS advice, PM25 IS NULL AS is_missing FROM observed""",
)
def risk_level(t):
    return alerts.risk_table(t.observed, "PM25")


@query(
    "forecast_daily_summary",
    "Province date@ day mean~ max~ min~ level label max_text",
    f"""SELECT Province, CAST(Datetime AS DATE) AS date, strftime(CAST(Datetime AS DATE), '%d %b %Y') AS day,
      avg(predicted) AS mean, max(predicted) AS max, min(predicted) AS min,
      {_level_sql('max(predicted)')} AS level, {_level_sql('max(predicted)', 2)} AS label,
      printf('%.1f µg/m³', max(predicted)) AS max_text
      FROM ({AHEAD_ROWS}) GROUP BY 1, 2, 3""",
    **LIVE,
)
def forecast_daily_summary(t):
    return alerts.daily_summary(forecast_part(t))


# ------------------------------------------------------------------ what the daily batch's forecast warns of
WEEK_AHEAD = f"SELECT Province, Datetime, Predicted_PM25 AS predicted FROM steps WHERE Datetime > TIMESTAMP '{NOW}'"


def week_ahead(t):
    return alerts.forecast_rows(batch(t), NOW)


@query(
    "forecast_peak",
    "Province peak_ts peak~",
    f"""SELECT Province, Datetime AS peak_ts, predicted AS peak FROM (SELECT *, row_number() OVER (
      PARTITION BY Province ORDER BY predicted DESC, Datetime) AS rn FROM ({WEEK_AHEAD}) AS w) AS x WHERE rn = 1""",
    **batch_tables(NOW),
)
def forecast_peak(t):
    return alerts.forecast_peak(week_ahead(t))


@query(
    "audience_alerts",
    "Province peak~ audience is_alert",
    " UNION ALL ".join(
        f"SELECT Province, max(predicted) AS peak, '{a}' AS audience, coalesce(max(predicted) > {b}e0, FALSE) AS is_alert FROM ({WEEK_AHEAD}) AS w GROUP BY 1"
        for a, b in AUDIENCE_THRESHOLDS
    ),
    **batch_tables(NOW),
)
def audience_alerts(t):
    return alerts.audience_table(alerts.forecast_peak(week_ahead(t)), "peak")


@query(
    "forecast_band",
    "Province Datetime predicted~ lower~ upper~ zone",
    f"""SELECT Province, Datetime, predicted, predicted * 0.85e0 AS lower, predicted * 1.15e0 AS upper,
      CASE WHEN predicted >= 75 THEN 'danger' WHEN predicted >= 37.5 THEN 'affected'
        WHEN predicted IS NOT NULL THEN 'normal' END AS zone FROM ({AHEAD_ROWS})""",
    **LIVE,
)
def forecast_band(t):
    return alerts.band_table(forecast_part(t))


@query(
    "kpi_cards",
    "Province now_ts pm25_now~ delta_24h~ level_now forecast_max~ level_forecast weekly_trend~ trend_icon "
    "trend_direction temperature_2m~ fire_count fire_frp_sum~ axis_bound~",
    f"""SELECT c.Province, now_ts, pm25_now, pm25_now - pm25_prev AS delta_24h, {_level_sql('pm25_now')} AS level_now,
      forecast_max, {_level_sql('forecast_max')} AS level_forecast, weekly_trend,
      CASE WHEN weekly_trend > 2 THEN 'up' WHEN weekly_trend < -2 THEN 'down' ELSE 'flat' END AS trend_icon,
      CASE WHEN weekly_trend > 0 THEN 'rising' ELSE 'falling' END AS trend_direction, temperature_2m,
      (SELECT count(*) FROM hotspots WHERE acq_date >= (SELECT max(acq_date) FROM hotspots) - 1) AS fire_count,
      (SELECT sum(frp) FROM hotspots WHERE acq_date >= (SELECT max(acq_date) FROM hotspots) - 1) AS fire_frp_sum,
      greatest(150e0, coalesce(omax, 0e0) * 1.1e0, coalesce(fmax, 0e0) * 1.1e0) AS axis_bound FROM (
      SELECT a.Province, a.now_ts, a.pm25_now, b.pm25_prev, a.temperature_2m, coalesce(f.fmax, a.pm25_now) AS forecast_max,
        coalesce(f.fmean - w.amean, 0e0) AS weekly_trend, f.fmax, o.omax
      FROM (SELECT Province, Datetime AS now_ts, PM25 AS pm25_now, temperature_2m FROM live WHERE Datetime = TIMESTAMP '{NOW}') a
      JOIN (SELECT Province, PM25 AS pm25_prev FROM live WHERE Datetime = TIMESTAMP '{NOW}' - INTERVAL 1 DAY) b ON a.Province = b.Province
      LEFT JOIN (SELECT Province, max(predicted) AS fmax, avg(predicted) AS fmean FROM ({AHEAD_ROWS}) GROUP BY 1) f ON f.Province = a.Province
      LEFT JOIN (SELECT Province, avg(PM25) AS amean FROM (SELECT *, row_number() OVER (PARTITION BY Province ORDER BY Datetime DESC) AS rn
        FROM live WHERE Datetime <= TIMESTAMP '{NOW}') AS q WHERE rn <= 168 GROUP BY 1) w ON w.Province = a.Province
      LEFT JOIN (SELECT Province, max(PM25) AS omax FROM live GROUP BY 1) o ON o.Province = a.Province) AS c""",
    **LIVE,
)
def kpi_cards(t):
    return alerts.kpi_cards(serving(t), t.hotspots, NOW)


# ------------------------------------------------------------------ ranked fires
SCORED = f"""SELECT f.*, greatest(frp, 0e0) * (0.5e0 + (1 + cos(radians(angle))) / 2e0) / (dist_km + 10) AS priority FROM (
  SELECT d.*, abs(pmod360(bearing - wind + 180) - 180) AS angle FROM (
  SELECT h.*, s.Province, w.wind_direction_10m AS wind,
    2 * 6371e0 * asin(sqrt(least(greatest(pow(sin(radians(h.latitude - s.lat) / 2), 2)
      + cos(radians(s.lat)) * cos(radians(h.latitude)) * pow(sin(radians(h.longitude - s.lon) / 2), 2), 0e0), 1e0))) AS dist_km,
    pmod360(degrees(atan2(h.longitude - s.lon, h.latitude - s.lat))) AS bearing
  FROM located h JOIN stations s ON s.Province = h.Province
  JOIN weather w ON w.Province = h.Province AND w.Datetime = CAST(h.acq_date AS TIMESTAMP)) AS d) AS f"""


def _pmod(sql):
    """Write the modulo out: SQL engines disagree on the sign of ``%``."""
    import re

    while match := re.search(r"pmod360\(", sql):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[match.end() : end - 1]
        sql = f"{sql[:match.start()]}(({inner}) - 360e0 * floor(({inner}) / 360e0)){sql[end:]}"
    return sql


SCORED = _pmod(SCORED)


def scored_fires(t):
    """Fires of a station's own area against that station, with the wind at the start of their day."""
    places = t.stations.select("Province", "lat", "lon")
    wind = t.weather.select(
        "Province", F.col("Datetime").cast("date").alias("acq_date"), F.col("wind_direction_10m").alias("wind"),
    ).where(F.hour(t.weather["Datetime"]) == 0)
    known = lookup(t.located, places, "Province", "inner").join(wind, ["Province", "acq_date"])
    return fires.priority(known, "lat", "lon", "wind")


@query("hotspot_priority", "event_id Province dist_km~ priority~", "SELECT * FROM scored", scored=SCORED)
def hotspot_priority(t):
    return scored_fires(t)


EVERY_FIRE = SCORED.replace("FROM located h JOIN stations s ON s.Province = h.Province", "FROM recent_fires h CROSS JOIN stations s").replace(
    "JOIN weather w ON w.Province = h.Province AND w.Datetime = CAST(h.acq_date AS TIMESTAMP)",
    f"JOIN weather w ON w.Province = s.Province AND w.Datetime = TIMESTAMP '{NOW}'",
)


@query(
    "hotspot_priority_top",
    "Province rank# latitude~ longitude~ frp~ dist_km~ priority~",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Province
      ORDER BY priority DESC, latitude, longitude, frp, acq_date) AS rank FROM scored) WHERE rank <= 20""",
    recent_fires=f"SELECT * FROM good_fires WHERE acq_date >= (SELECT max(acq_date) FROM good_fires) - {RECENT_DAYS}",
    scored=EVERY_FIRE,
)
def hotspot_priority_top(t):
    """The fires that matter most to each station, of all of the last 30 days, with the wind it has now."""
    wind = alerts.latest_of(t.weather, NOW, "wind_direction_10m").withColumnRenamed("wind_direction_10m", "wind")
    places = t.stations.select("Province", "lat", "lon").join(wind, "Province")
    return fires.priority_top_of_all(splits.since_latest(t.good_fires, "acq_date", RECENT_DAYS), places, 20)
