"""Sources, sinks, filters, joins and set operations."""

from pyspark.sql import functions as F

from hazelake import schemas
from hazelake.catalog.ctes import with_tables
from hazelake.catalog.register import query
from hazelake.catalog.tables import NOW, TRAIN_END, VALIDATION_END
from hazelake.constants import BBOX_ARCHIVE, BBOX_DAILY, FEATURES, FIRE_COLUMNS, WEATHER_COLUMNS
from hazelake.functions import scalar as S
from hazelake.operators import fires, geo, panel, series, splits
from hazelake.plans import alerts, forecast
from hazelake.plans.features import pm25_lag_columns
from hazelake.session import fresh_path
from hazelake.sources import commits, ingest

WEATHER = " ".join(f"{c}~" for c in WEATHER_COLUMNS)
FIRES = " ".join(f"{c}~" for c in FIRE_COLUMNS)
HOTSPOT = "acq_date@ latitude~ longitude~ frp~ bright_ti4~ confidence type#"


# ------------------------------------------------------------------ sources and sinks
@query("scan_csv_glob", "Datetime PM25~ Province", "SELECT Datetime, PM25, Province FROM pm25")
def scan_csv_glob(t):
    folder = fresh_path(t.spark, "pm25-csv")
    ingest.write_csv(t.pm25.select("Datetime", "PM25", "Province"), folder)
    return ingest.read_csv_glob(t.spark, f"{folder}/*.csv", schemas.PM25)


@query("payload_json_rows", f"Datetime Province {WEATHER}", "SELECT * FROM weather")
def payload_json_rows(t):
    names = {c: c for c in WEATHER_COLUMNS}
    days = t.weather.groupBy("Province", F.to_date("Datetime").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("Datetime", *WEATHER_COLUMNS))).alias("hours")
    )
    landing = fresh_path(t.spark, "weather-json")
    days.select("Province", ingest.json_body(names, "hours").alias("body")).write.json(landing)
    landed = t.spark.read.schema("Province string, body string").json(landing)
    return ingest.json_payload_rows(landed, names)


@query(
    "payload_csv_rows", HOTSPOT,
    "SELECT * REPLACE (CASE WHEN event_id // 50 % 3 = 2 THEN NULL ELSE type END AS type) FROM hotspots",
)
def payload_csv_rows(t):
    """Bodies with the declared columns, with more of them in another order, and without the fire type."""
    declared = schemas.HOTSPOTS.fieldNames()
    layouts = [declared, [*reversed(declared), "note"], [c for c in declared if c != "type"]]
    rows = t.hotspots.withColumns({"note": F.lit('"high, dry"'), "chunk": F.expr("event_id div 50")})
    bodies = None
    for i, names in enumerate(layouts):
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
        chunks = rows.where(F.col("chunk") % 3 == i).groupBy("chunk").agg(F.collect_list(line).alias("lines"))
        text = F.concat(F.lit(",".join(names) + "\n"), F.array_join("lines", "\n"), F.lit("\n"))
        part = chunks.select(text.alias("body"))
        bodies = part if bodies is None else bodies.unionByName(part)
    messages = t.stations.select(
        F.expr("CASE pid % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'No data available' ELSE 'Invalid request' END").alias("body")
    )
    return ingest.csv_payload_rows(bodies.unionByName(messages), schemas.HOTSPOTS)


@query(
    "date_chunks",
    "Province chunk_start@ chunk_end@",
    """SELECT Province, chunk_start, least(CAST(chunk_start + INTERVAL 4 DAY AS DATE), last_day) AS chunk_end FROM (
      SELECT Province, last_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 5 DAY)) AS DATE) AS chunk_start
      FROM (SELECT 'P' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS Province, CAST(min(ts) AS DATE) AS first_day,
        CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY user_id))""",
)
def date_chunks(t):
    spans = t.observations.groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")
    )
    named = spans.withColumn("Province", F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    return ingest.date_chunks(named, "first_day", "last_day", 5)


APPEND = """SELECT * FROM daily WHERE date <= DATE '2024-01-20' UNION ALL
  SELECT * FROM daily b WHERE date >= DATE '2024-01-16' AND NOT EXISTS (
    SELECT 1 FROM daily m WHERE m.date <= DATE '2024-01-20' AND m.date = b.date)"""


def _master_and_batch(t):
    batch = t.daily.where("date >= DATE'2024-01-16'").withColumn("frp_mean", F.col("frp_mean") + 1)
    return t.daily.where("date <= DATE'2024-01-20'"), batch


@query("append_new_dates", f"date@ Province {FIRES}", APPEND.replace("SELECT * FROM daily b", "SELECT date, Province, hotspot_count, frp_sum, frp_mean + 1 FROM daily b"))
def append_new_dates(t):
    master, batch = _master_and_batch(t)
    return panel.append_new_dates(master, batch, "date")


@query(
    "append_new_keys",
    f"date@ Province {FIRES}",
    """SELECT * FROM daily WHERE date <= DATE '2024-01-20' AND Province < 'P000100' UNION ALL
      SELECT date, Province, hotspot_count, frp_sum, frp_mean + 1 FROM daily b WHERE date >= DATE '2024-01-16'
      AND NOT EXISTS (SELECT 1 FROM daily m WHERE m.date <= DATE '2024-01-20' AND m.Province < 'P000100'
        AND m.date = b.date AND m.Province = b.Province)""",
)
def append_new_keys(t):
    """A partial earlier run: stations it lacks are picked up on dates it already has."""
    master, batch = _master_and_batch(t)
    return panel.append_new_dates(master.where("Province < 'P000100'"), batch, "date", ["Province"])


@query("append_to_table", f"date@ Province {FIRES}", "SELECT * FROM daily")
def append_to_table(t):
    """Three writes to one table: create it, overlap it, repeat a batch."""
    folder = fresh_path(t.spark, "master")
    first, second = t.daily.where("date <= DATE'2024-01-20'"), t.daily.where("date >= DATE'2024-01-16'")
    for run, batch in enumerate((first, second, second)):
        ingest.append_to_table(batch, folder, "date", run=str(run))
    return ingest.read_appended(t.spark, folder)


@query("append_committed", f"date@ Province {FIRES}", "SELECT * FROM daily")
def append_committed(t):
    """Two loads that overlap by five days, one of which commits while the other is being written, and a repeat."""
    folder = fresh_path(t.spark, "committed")
    first, second = t.daily.where("date <= DATE'2024-01-20'"), t.daily.where("date >= DATE'2024-01-16'")

    def meanwhile(attempt):
        if attempt == 0:
            commits.append(second, folder, "date", run="second")

    commits.append(first, folder, "date", run="first", before_claim=meanwhile)
    commits.append(second, folder, "date", run="second")
    return commits.read(t.spark, folder)


@query("sink_roundtrip", f"Province Datetime PM25~ {FIRES}", "SELECT * FROM panel")
def sink_roundtrip(t):
    folder = fresh_path(t.spark, "panel")
    ingest.write_parquet(t.panel, folder, partition_by=["date"])
    return t.spark.read.parquet(folder)


@query(
    "recent_hotspots_snapshot",
    HOTSPOT,
    """SELECT * FROM hotspots WHERE (confidence IS NULL OR confidence <> 'l') AND type = 0
      AND acq_date >= (SELECT max(acq_date) FROM hotspots) - 5""",
)
def recent_hotspots_snapshot(t):
    folder = fresh_path(t.spark, "recent-hotspots")
    recent = splits.since_latest(t.hotspots, "acq_date", 5)
    kept = fires.quality_filter_nrt(recent).select(*schemas.HOTSPOTS.fieldNames())
    ingest.write_parquet(kept, folder)
    return ingest.read_hotspots_or_empty(t.spark, folder)


# ------------------------------------------------------------------ filters
ARCHIVE = "(confidence IS NULL OR confidence <> 'l') AND (type IS NULL OR type <> 3)"


@query("hotspot_filter_archive", f"event_id {HOTSPOT}", f"SELECT * FROM hotspots WHERE {ARCHIVE}")
def hotspot_filter_archive(t):
    return fires.quality_filter_archive(t.hotspots)


@query(
    "hotspot_filter_nrt",
    f"event_id {HOTSPOT}",
    "SELECT * FROM hotspots WHERE (confidence IS NULL OR confidence <> 'l') AND type = 0",
)
def hotspot_filter_nrt(t):
    return fires.quality_filter_nrt(t.hotspots)


@query(
    "hotspot_filter_untyped",
    "event_id acq_date@ latitude~ longitude~ frp~ confidence",
    "SELECT * FROM hotspots WHERE confidence IS NULL OR confidence <> 'l'",
)
def hotspot_filter_untyped(t):
    return fires.quality_filter_nrt(t.hotspots.drop("type"))


def _bbox_sql(bbox):
    west, south, east, north = bbox
    return f"longitude BETWEEN {west}e0 AND {east}e0 AND latitude BETWEEN {south}e0 AND {north}e0"


@query(
    "bbox_filter",
    "event_id latitude~ longitude~ in_archive_box",
    f"SELECT *, ({_bbox_sql(BBOX_ARCHIVE)}) AS in_archive_box FROM hotspots WHERE {_bbox_sql(BBOX_DAILY)}",
)
def bbox_filter(t):
    west, south, east, north = BBOX_ARCHIVE
    inside = F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    return geo.in_bbox(t.hotspots, BBOX_DAILY).withColumn("in_archive_box", inside)


@query(
    "recent_history",
    f"Province Datetime {WEATHER} PM25~",
    f"SELECT * FROM observed WHERE Datetime >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY",
)
def recent_history(t):
    return splits.since(t.observed, "Datetime", NOW, 10)


@query(
    "recent_relative_to_max",
    f"event_id {HOTSPOT}",
    "SELECT * FROM hotspots WHERE acq_date >= (SELECT max(acq_date) FROM hotspots) - 3",
)
def recent_relative_to_max(t):
    return splits.since_latest(t.hotspots, "acq_date", 3)


@query(
    "time_split",
    "Province Datetime split",
    f"""SELECT Province, Datetime, CASE WHEN Datetime <= TIMESTAMP '{TRAIN_END}' THEN 'train'
      WHEN Datetime <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split FROM weather""",
)
def time_split(t):
    return splits.time_split(t.weather, "Datetime", TRAIN_END, VALIDATION_END)


@query(
    "ordered_split",
    "Province Datetime split",
    """SELECT Province, Datetime, CASE WHEN rn <= n - ceil(0.2e0 * n) THEN 'train' ELSE 'test' END AS split FROM (
      SELECT Province, Datetime, row_number() OVER (ORDER BY Datetime, Province) AS rn, count(*) OVER () AS n FROM pm25)""",
)
def ordered_split(t):
    return splits.ordered_split(t.pm25, "Datetime", "Province")


COMPLETE = [f for f in FEATURES if f.startswith("pm25_lag")]


@query(
    "complete_cases",
    "Province Datetime PM25~4 " + " ".join(f"{c}~4" for c in COMPLETE),
    "SELECT * FROM (SELECT Province, Datetime, PM25, "
    + ", ".join(f"lag(PM25, {c[9:-1]}) OVER (PARTITION BY Province ORDER BY Datetime) AS {c}" for c in COMPLETE)
    + " FROM observed) AS l WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COMPLETE),
)
def complete_cases(t):
    lagged = series.windowed(
        t.observed.select("Province", "Datetime", "PM25"), "Province", "Datetime",
        build=pm25_lag_columns, back=72, spacing="hourly",
    )
    return splits.complete_cases(lagged, COMPLETE)


# ------------------------------------------------------------------ joins
@query(
    "join_pm25_weather",
    f"Datetime Province PM25~ {WEATHER}",
    "SELECT w.*, p.PM25 FROM pm25 p JOIN weather w ON p.Datetime = w.Datetime AND p.Province = w.Province",
)
def join_pm25_weather(t):
    return panel.join_observations(t.pm25.drop("pid"), t.weather.drop("pid"))


@query("left_join_pm25", f"Datetime Province PM25~ {WEATHER}", "SELECT * FROM observed")
def left_join_pm25(t):
    return panel.attach_pm25(t.weather, t.pm25)


@query("hourly_daily_join", f"Datetime Province date@ PM25~ {FIRES}", "SELECT * FROM panel")
def hourly_daily_join(t):
    return panel.attach_daily_fires(t.observed, t.daily_sparse)


@query("spatial_join", "event_id Province acq_date@ frp~", "SELECT * FROM located")
def spatial_join(t):
    return geo.spatial_join(t.good_fires, t.polygons)


@query(
    "spatial_join_mapped",
    "event_id Province",
    """SELECT event_id, 'region ' || substr(Province, 2) AS Province FROM located
      WHERE CAST(substr(Province, 2) AS INT) % 2 = 0""",
)
def spatial_join_mapped(t):
    """Only the regions a name mapping knows, under its names."""
    even = t.stations.where("pid % 2 = 0")
    mapping = even.select("Province", F.concat(F.lit("region "), F.substring("Province", 2, 6)).alias("ours"))
    return geo.spatial_join(t.good_fires, geo.map_regions(t.polygons, mapping, "Province", "ours"))


@query(
    "spatial_match_report",
    "total outside outside_pct~ matched",
    """SELECT count(*) AS total, count(*) - count(t.Province) AS outside,
      1e2 * (count(*) - count(t.Province)) / count(*) AS outside_pct, count(t.Province) AS matched
      FROM good_fires h LEFT JOIN hits t ON h.event_id = t.event_id""",
)
def spatial_match_report(t):
    return geo.match_report(geo.spatial_join(t.good_fires, t.polygons, how="left"))


@query("densify_daily_grid", f"date@ Province {FIRES}", "SELECT * FROM daily")
def densify_daily_grid(t):
    return fires.densify_daily(t.daily_sparse, t.stations)


@query(
    "densify_hours",
    "Province Datetime PM25~",
    """SELECT s.Province, h.Datetime, p.PM25 FROM
      (SELECT Province, min(Datetime) AS lo, max(Datetime) AS hi FROM pm25 GROUP BY 1) s
      JOIN hours h ON h.Datetime BETWEEN s.lo AND s.hi
      LEFT JOIN pm25 p ON p.Province = s.Province AND p.Datetime = h.Datetime""",
)
def densify_hours(t):
    return panel.densify_hours(t.pm25)


PROXY = """SELECT p.Province, p.Datetime,
  coalesce(CASE WHEN f.hotspot_count IS NULL THEN x.hotspot_count ELSE f.hotspot_count END, 0e0) AS hotspot_count,
  coalesce(CASE WHEN f.hotspot_count IS NULL THEN x.frp_sum ELSE f.frp_sum END, 0e0) AS frp_sum,
  coalesce(CASE WHEN f.hotspot_count IS NULL THEN x.frp_mean ELSE f.frp_mean END, 0e0) AS frp_mean
  FROM observed p LEFT JOIN known f ON f.Province = p.Province AND f.date = CAST(p.Datetime AS DATE)
  LEFT JOIN (SELECT Province, avg(hotspot_count) AS hotspot_count, avg(frp_sum) AS frp_sum, avg(frp_mean) AS frp_mean
    FROM known WHERE date >= (SELECT max(date) FROM known) - 3 GROUP BY 1) x ON x.Province = p.Province"""


@query(
    "hotspot_proxy_fill",
    f"Province Datetime {FIRES}",
    PROXY,
    known="SELECT * FROM daily WHERE date <= DATE '2024-01-24'",
)
def hotspot_proxy_fill(t):
    known = t.daily.where("date <= DATE'2024-01-24'")
    return fires.fill_from_recent(panel.attach_daily_fires(t.observed, known, fill_zero=False), known)


@query(
    "asof_latest",
    "Province now_ts pm25_now~ prev_ts pm25_prev~",
    f"""SELECT Province, l.Datetime AS now_ts, l.PM25 AS pm25_now, p.Datetime AS prev_ts, p.PM25 AS pm25_prev FROM (
      SELECT Province,
        coalesce(arg_max(r, CASE WHEN Datetime <= TIMESTAMP '{NOW}' THEN Datetime END), arg_min(r, Datetime)) AS l,
        coalesce(arg_max(r, CASE WHEN Datetime <= TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN Datetime END),
          arg_max(r, CASE WHEN Datetime <= TIMESTAMP '{NOW}' THEN Datetime END), arg_min(r, Datetime)) AS p
      FROM (SELECT Province, Datetime, {{'Datetime': Datetime, 'PM25': PM25}} AS r FROM pm25) GROUP BY 1)""",
)
def asof_latest(t):
    return alerts.asof_latest(t.pm25, NOW)


# ------------------------------------------------------------------ set operations, order, fills
PARTS = dict(
    known=f"""SELECT w.Datetime, w.Province, p.PM25, w.temperature_2m FROM (SELECT pid, Datetime, Province, temperature_2m FROM weather
      WHERE Datetime <= TIMESTAMP '{NOW}') w LEFT JOIN pm25 p ON w.pid = p.pid AND w.Datetime = p.Datetime""",
    coming=f"SELECT Datetime, Province, temperature_2m + 1 AS temperature_2m FROM weather WHERE Datetime >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY",
)
UNION = """SELECT Datetime, Province, PM25, temperature_2m, 'history' AS source FROM known UNION ALL
  SELECT Datetime, Province, CAST(NULL AS DOUBLE) AS PM25, temperature_2m, 'forecast' AS source FROM coming"""


def _history_and_forecast(t):
    history = t.observed.where(F.col("Datetime") <= splits.ntz(NOW))
    ahead = t.weather.where(F.col("Datetime") >= splits.ntz(NOW) - F.expr("INTERVAL 1 DAY"))
    return panel.union_sources(history=history, forecast=ahead.withColumn("temperature_2m", F.col("temperature_2m") + 1))


@query("union_history_forecast", "Datetime Province PM25~ temperature_2m~ source", UNION, **PARTS)
def union_history_forecast(t):
    return _history_and_forecast(t)


@query(
    "dedupe_keep_first",
    "Datetime Province PM25~ temperature_2m~ source",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Datetime, Province
      ORDER BY CASE source WHEN 'history' THEN 0 ELSE 1 END) AS rn FROM ({UNION})) WHERE rn = 1""",
    **PARTS,
)
def dedupe_keep_first(t):
    return panel.history_wins(_history_and_forecast(t))


@query(
    "ffill_bfill",
    "Province Datetime PM25~",
    """SELECT Province, Datetime, coalesce(
      last_value(PM25 IGNORE NULLS) OVER (PARTITION BY Province ORDER BY Datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(PM25 IGNORE NULLS) OVER (PARTITION BY Province ORDER BY Datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      ) AS PM25 FROM observed""",
)
def ffill_bfill(t):
    return series.fill_gaps(t.observed.select("Province", "Datetime", "PM25"), "Province", "Datetime", ["PM25"], block=168)


@query(
    "label_encode",
    "Province province_label#",
    "SELECT Province, row_number() OVER (ORDER BY Province) - 1 AS province_label FROM stations",
)
def label_encode(t):
    return series.label_encode(t.weather, "Province", "province_label")


@query(
    "head_tail_per_group",
    "Province Datetime PM25~ part",
    f"""SELECT Province, Datetime, PM25, part FROM (
      SELECT *, 'head' AS part, row_number() OVER (PARTITION BY Province ORDER BY Datetime) AS rn FROM pm25
        WHERE Datetime > TIMESTAMP '{NOW}'
      UNION ALL SELECT *, 'tail' AS part, row_number() OVER (PARTITION BY Province ORDER BY Datetime DESC) AS rn FROM pm25
        WHERE Datetime <= TIMESTAMP '{NOW}') WHERE rn <= 168""",
)
def head_tail_per_group(t):
    head = alerts.forecast_rows(t.pm25, NOW, 168).withColumn("part", F.lit("head"))
    return head.unionByName(alerts.actual_rows(t.pm25, NOW, 168).withColumn("part", F.lit("tail")))


@query(
    "calendar_parts",
    "Province Datetime year# month# day# hour# dayofyear# weekday#",
    """SELECT Province, Datetime, year(Datetime) AS year, month(Datetime) AS month, day(Datetime) AS day,
      hour(Datetime) AS hour, dayofyear(Datetime) AS dayofyear, isodow(Datetime) - 1 AS weekday FROM shifted""",
)
def calendar_parts(t):
    return t.shifted.withColumns(S.calendar_parts("Datetime"))


@query(
    "top_fire_days",
    f"Province rank# date@ {FIRES}",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Province ORDER BY hotspot_count DESC, date) AS rank
      FROM daily) WHERE rank <= 5""",
)
def top_fire_days(t):
    return series.top_per_group(t.daily, "Province", [F.desc("hotspot_count"), F.asc("date")], 5)


@query(
    "seeded_sample",
    "Province Datetime PM25~ hotspot_count~",
    """SELECT * FROM panel WHERE hotspot_count > 0 AND PM25 IS NOT NULL
      ORDER BY md5(Province || '|' || CAST(Datetime AS VARCHAR) || '|42'), Province, Datetime LIMIT 3000""",
)
def seeded_sample(t):
    burning = t.panel.where("hotspot_count > 0 AND PM25 IS NOT NULL")
    return splits.seeded_sample(burning, ["Province", "Datetime"], 3000)


# ------------------------------------------------------------------ linear forecast (SQL-checkable)
AHEAD = f"""SELECT f.Province, f.Datetime, f.temperature_2m, l.last_ts, l.last_pm25,
  row_number() OVER (PARTITION BY f.Province ORDER BY f.Datetime) AS n
  FROM recent f JOIN (SELECT Province, max(Datetime) AS last_ts, arg_max(PM25, Datetime) AS last_pm25
    FROM recent WHERE PM25 IS NOT NULL GROUP BY 1) l ON f.Province = l.Province WHERE f.Datetime > l.last_ts"""
RECENT = f"""SELECT * FROM upto_now WHERE Datetime >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY
  AND Datetime <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY"""
STEPS = """SELECT Province, n, Datetime, last_ts, 0.8e0 * last_pm25 + 0.05e0 * temperature_2m AS Predicted_PM25
  FROM ahead WHERE n = 1 UNION ALL
  SELECT a.Province, a.n, a.Datetime, a.last_ts, 0.8e0 * s.Predicted_PM25 + 0.05e0 * a.temperature_2m
  FROM steps s JOIN ahead a ON a.Province = s.Province AND a.n = s.n + 1"""
LINEAR = {"recent": RECENT, "ahead": AHEAD, "steps": STEPS}


def linear_forecast(t):
    window = forecast.forecast_window(t.upto_now, NOW)
    return forecast.forecast_linear(window, 0.8, 0.05, "temperature_2m")


@query("forecast_recursive_linear", "Province Datetime Predicted_PM25~", "SELECT * FROM steps", **LINEAR)
def forecast_recursive_linear(t):
    return linear_forecast(t)


HORIZONS = [1, 3, 6, 12, 24, 48, 72]


@query(
    "horizon_snapshot",
    "Province predict_datetime " + " ".join(f"pred_{h}h~" for h in HORIZONS) + " created_at",
    "SELECT Province, last_ts AS predict_datetime, "
    + ", ".join(f"max(CASE WHEN date_diff('hour', last_ts, Datetime) = {h} THEN Predicted_PM25 END) AS pred_{h}h" for h in HORIZONS)
    + ", '2024-01-24 07:00' AS created_at FROM steps GROUP BY Province, last_ts",
    **LINEAR,
)
def horizon_snapshot(t):
    return forecast.horizon_snapshot(linear_forecast(t), "2024-01-24 07:00")


SERVING = f"""SELECT u.Province, u.Datetime, coalesce(u.PM25, s.Predicted_PM25) AS PM25, u.temperature_2m,
  u.hotspot_count, u.frp_sum, coalesce(u.PM25, s.Predicted_PM25) AS predicted
  FROM upto_now u LEFT JOIN steps s ON s.Province = u.Province AND s.Datetime = u.Datetime
  WHERE u.Datetime >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY"""


@query("serving_frame", "Province Datetime PM25~ temperature_2m~ hotspot_count~ frp_sum~ predicted~", SERVING, **LINEAR)
def serving_frame(t):
    return alerts.serving_frame(t.upto_now, linear_forecast(t), NOW)


# ------------------------------------------------------------------ the daily batch, from sources to serving frame
BATCH_COLUMNS = "Province Datetime PM25~ temperature_2m~ hotspot_count~ frp_sum~ frp_mean~ predicted~"


def batch_tables(now: str) -> dict[str, str]:
    """``recent`` as the batch knows it at ``now``, and the linear steps from there."""
    at = f"TIMESTAMP '{now}'"
    return LINEAR | {
        "known": f"SELECT * FROM daily WHERE date <= CAST({at} AS DATE)",
        "stacked": f"""SELECT Province, Datetime, PM25, temperature_2m, 0 AS later FROM observed
          WHERE Datetime BETWEEN {at} - INTERVAL 10 DAY AND {at} UNION ALL
          SELECT Province, Datetime, NULL, temperature_2m + 1, 1 FROM weather
          WHERE Datetime BETWEEN {at} - INTERVAL 1 DAY AND {at} + INTERVAL 7 DAY""",
        "once": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Province, Datetime ORDER BY later) AS rn
          FROM stacked) AS s WHERE rn = 1""",
        "recent": f"""SELECT o.PM25, o.temperature_2m, p.* FROM once o JOIN (
          {PROXY.replace("FROM observed p", "FROM once p")}) AS p ON p.Province = o.Province AND p.Datetime = o.Datetime""",
    }


def batch_serving(steps: str = "steps") -> str:
    return f"""SELECT r.Province, r.Datetime, coalesce(r.PM25, s.Predicted_PM25) AS PM25, r.temperature_2m,
      r.hotspot_count, r.frp_sum, r.frp_mean, coalesce(r.PM25, s.Predicted_PM25) AS predicted
      FROM recent r LEFT JOIN {steps} s ON s.Province = r.Province AND s.Datetime = r.Datetime"""


def batch_forecast(t, now=NOW):
    return forecast.forecast_linear(t.batch(now), 0.8, 0.05, "temperature_2m")


@query("daily_batch_linear", BATCH_COLUMNS, batch_serving(), **batch_tables(NOW))
def daily_batch_linear(t):
    """History, forecast weather and fires to the frame that alerts read, with a linear model."""
    return alerts.serving_frame(t.batch(), batch_forecast(t), NOW)


DAY_BEFORE = "2024-01-23 00:00:00"
SNAPSHOTS = {DAY_BEFORE: "2024-01-23 07:00", NOW: "2024-01-24 07:00"}


def _snapshot_sql(now: str) -> str:
    rows = with_tables(
        "SELECT Province, last_ts AS predict_datetime, "
        + ", ".join(f"max(CASE WHEN date_diff('hour', last_ts, Datetime) = {h} THEN Predicted_PM25 END) AS pred_{h}h" for h in HORIZONS)
        + f", '{SNAPSHOTS[now]}' AS created_at FROM steps GROUP BY Province, last_ts",
        batch_tables(now),
    )
    return f"SELECT * FROM ({rows}) AS s"


@query(
    "snapshot_history",
    "Province predict_datetime " + " ".join(f"pred_{h}h~" for h in HORIZONS) + " created_at",
    " UNION ALL ".join(map(_snapshot_sql, SNAPSHOTS)),
)
def snapshot_history(t):
    """Snapshots of two days' batches in one table; the second day's batch is run twice and counts once."""
    path = fresh_path(t.spark, "snapshots")
    for now in (*SNAPSHOTS, NOW):
        rows = forecast.horizon_snapshot(batch_forecast(t, now), SNAPSHOTS[now])
        ingest.append_to_table(rows, path, "created_at", run=SNAPSHOTS[now][:10])
    return ingest.read_appended(t.spark, path)
