from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazelake.functions import scalar as S
from hazelake.plans import alerts

NOW = "2024-01-31 12:00:00"


def frame(spark, rows):
    return spark.createDataFrame(rows, "Province string, Datetime timestamp_ntz, PM25 double")


def test_levels_at_their_bounds(spark):
    values = [0.0, 25.0, 25.01, 37.0, 37.01, 50.0, 50.01, 90.0, 90.01, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.level for r in df.select("i", S.risk_level("v").alias("level")).orderBy("i").collect()]
    assert got == [
        "very_good", "very_good", "good", "good", "moderate", "moderate", "unhealthy", "unhealthy",
        "hazardous", "hazardous", "hazardous",
    ]
    missing = [r.m for r in df.select("i", S.is_missing("v").alias("m")).orderBy("i").collect()]
    assert missing == [False] * 9 + [True, True]


def test_audiences(spark):
    df = spark.createDataFrame([("a", 37.0), ("b", 37.1), ("c", 50.1), ("d", None)], "Province string, peak double")
    got = {(r.Province, r.audience): r.is_alert for r in alerts.audience_table(df, "peak").collect()}
    assert not any(got["a", x] for x in ("hospital", "school", "risk_group"))
    assert got["b", "school"] and got["b", "risk_group"] and not got["b", "hospital"]
    assert got["c", "hospital"] and not got["d", "hospital"]


def test_asof_and_its_fallbacks(spark):
    t = datetime(2024, 1, 31, 12)
    rows = [
        ("a", t - timedelta(hours=30), 1.0), ("a", t - timedelta(hours=1), 2.0), ("a", t + timedelta(hours=1), 3.0),
        ("young", t - timedelta(hours=2), 4.0), ("ahead", t + timedelta(hours=5), 5.0),
    ]
    got = {r.Province: (r.pm25_now, r.pm25_prev) for r in alerts.asof_latest(frame(spark, rows), NOW).collect()}
    assert got == {"a": (2.0, 1.0), "young": (4.0, 4.0), "ahead": (5.0, 5.0)}


def test_daily_summary_across_a_month(spark):
    rows = [("a", datetime(2024, 1, 31, 23), 10.0), ("a", datetime(2024, 2, 1, 0), 95.0), ("a", datetime(2024, 2, 1, 1), 5.0)]
    got = alerts.daily_summary(frame(spark, rows), "PM25").orderBy("date").collect()
    assert [(r.day, r["max"], r.level) for r in got] == [("31 Jan 2024", 10.0, "very_good"), ("01 Feb 2024", 95.0, "hazardous")]
    assert got[1]["min"] == 5.0 and got[1]["mean"] == 50.0 and got[1].max_text == "95.0 µg/m³"


def test_peak_takes_the_first_of_equals_and_skips_nan(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(hours=i), v) for i, v in enumerate([1.0, 9.0, 9.0, float("nan"), None])] + [("b", t, None)]
    got = alerts.forecast_peak(frame(spark, rows), "PM25").collect()
    assert [(r.Province, r.peak, r.peak_ts.hour) for r in got] == [("a", 9.0, 1)]


def test_kpi_cards_with_and_without_forecast(spark):
    t = datetime(2024, 1, 31, 12)
    rows = [("a", t + timedelta(hours=h), 20.0 + h) for h in range(-30, 4)] + [("b", t, 60.0)]
    df = frame(spark, rows).withColumns({
        "predicted": F.col("PM25"), "temperature_2m": F.lit(1.0), "relative_humidity_2m": F.lit(2.0), "wind_direction_10m": F.lit(3.0),
    })
    fires = spark.createDataFrame(
        [(date(2024, 1, d), float(d)) for d in (28, 29, 30)] + [(date(2024, 1, 30), None)], "acq_date date, frp double"
    )
    got = {r.Province: r for r in alerts.kpi_cards(df, fires, NOW).collect()}
    a, b = got["a"], got["b"]
    assert a.pm25_now == 20.0 and a.delta_24h == 24.0 and a.forecast_max == 23.0
    assert a.weekly_trend == pytest.approx(22.0 - (20.0 - 15.0)) and a.trend_icon == "up"
    assert b.forecast_max == 60.0 and b.weekly_trend == 0.0 and b.trend_icon == "flat" and b.trend_direction == "falling"
    assert a.fire_count == 3 and a.fire_frp_sum == 59.0 and a.axis_bound == 150.0


def test_bands_and_zones(spark):
    df = spark.createDataFrame([("a", None, v) for v in (37.4, 37.5, 75.0)], "Province string, Datetime timestamp_ntz, predicted double")
    got = alerts.band_table(df).collect()
    assert [r.zone for r in got] == ["normal", "affected", "danger"]
    assert got[2].lower == pytest.approx(63.75) and got[2].upper == pytest.approx(86.25)


def test_serving_frame_prefers_readings(spark):
    t = datetime(2024, 1, 31, 12)
    actual = frame(spark, [("a", t, 5.0), ("a", t + timedelta(hours=1), None), ("a", t - timedelta(days=20), 1.0)])
    ahead = spark.createDataFrame([("a", t, 99.0), ("a", t + timedelta(hours=1), 7.0)], "Province string, Datetime timestamp_ntz, Predicted_PM25 double")
    got = alerts.serving_frame(actual, ahead, NOW).orderBy("Datetime").collect()
    assert [(r.PM25, r.predicted) for r in got] == [(5.0, 5.0), (7.0, 7.0)]


def test_clip_and_cyclic(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r.c for r in df.select(S.clip_at_zero("v").alias("c")).collect()] == [0.0, 2.0, None]
    sin, cos = S.cyclic(F.lit(6), 24)
    r = spark.range(1).select(sin.alias("s"), cos.alias("c")).first()
    assert r.s == pytest.approx(1.0) and r.c == pytest.approx(0.0, abs=1e-12)


def test_fires_of_all_places_are_ranked_as_by_brute_force(spark):
    import math
    import random

    from hazelake.operators import fires

    rng = random.Random(6)
    at = lambda: (rng.uniform(17, 21), rng.uniform(97, 102))
    burning = [(*at(), rng.choice([0.0, 1.5, 4.0, 300.0 * rng.random() ** 6]), None) for _ in range(400)] + [(18.2, 99.1, None, None), (50.0, -170.0, 5000.0, None)]
    places = [(f"p{i}", *at(), rng.uniform(0, 360)) for i in range(12)] + [("far", -40.0, 179.9, 10.0)]
    hotspots = spark.createDataFrame(burning, "latitude double, longitude double, frp double, acq_date date")
    got = fires.priority_top_of_all(hotspots, spark.createDataFrame(places, "Province string, lat double, lon double, wind double"), 5).collect()

    def score(lat, lon, wind, y, x, frp):
        a = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        dist = 2 * 6371 * math.asin(math.sqrt(min(max(a, 0), 1)))
        turn = abs((math.degrees(math.atan2(x - lon, y - lat)) % 360 - wind + 180) % 360 - 180)
        return max(frp, 0) * (0.5 + (1 + math.cos(math.radians(turn))) / 2) / (dist + 10)

    for name, lat, lon, wind in places:
        want = sorted((score(lat, lon, wind, y, x, f) for y, x, f, _ in burning if f is not None), reverse=True)[:5]
        have = [r.priority for r in sorted(got, key=lambda r: r["rank"]) if r.Province == name]
        assert len(have) == 5 and all(abs(a - b) < 1e-9 for a, b in zip(have, want)), name


def test_fires_below_the_floor_are_not_sorted_and_ties_at_it_stay(spark, monkeypatch):
    from hazelake.operators import fires

    ranked = {}
    rank = fires.priority_top
    monkeypatch.setattr(fires, "priority_top", lambda scored, n, key: ranked.setdefault("rows", scored) and rank(scored, n, key))
    # one class of 300 fires that get weaker with the distance: all of it is joined, five fires and one equal to the fifth are ranked
    burning = [(18.1 + i / 2000, 99.1, 31.0 - i / 20, date(2024, 1, 1)) for i in range(300)] + [(18.102, 99.1, 30.8, date(2024, 1, 2))]
    hotspots = spark.createDataFrame(burning, "latitude double, longitude double, frp double, acq_date date")
    places = spark.createDataFrame([("a", 18.09, 99.1, 0.0), ("b", 18.08, 99.1, 40.0)], "Province string, lat double, lon double, wind double")
    got = sorted(fires.priority_top_of_all(hotspots, places, 5).collect(), key=lambda r: (r.Province, r["rank"]))
    scored = fires.priority(hotspots.crossJoin(places), "lat", "lon", "wind")
    want = sorted(rank(scored, 5).collect(), key=lambda r: (r.Province, r["rank"]))
    assert [(r.Province, r["rank"], r.latitude, r.acq_date, r.priority) for r in got] == [(r.Province, r["rank"], r.latitude, r.acq_date, r.priority) for r in want]
    assert ranked["rows"].count() < 20
    assert "_floor" not in got[0]


def test_fires_of_the_last_30_days_are_ranked(spark):
    import math
    import random
    from types import SimpleNamespace

    from hazelake.catalog.q_alerts import hotspot_priority_top
    from hazelake.catalog.tables import NOW as now

    rng = random.Random(8)
    last = date(2024, 1, 24)
    burning = [(rng.uniform(17, 21), rng.uniform(97, 102), rng.choice([1.5, 300.0 * rng.random() ** 4]), last - timedelta(days=i % 45)) for i in range(450)]
    burning += [(18.0, 99.0, 9000.0, last - timedelta(days=30)), (18.0, 99.1, 90000.0, last - timedelta(days=31))]
    places = [("a", 18.1, 99.0, 40.0), ("b", 20.5, 101.0, 310.0)]
    t = SimpleNamespace(
        good_fires=spark.createDataFrame(burning, "latitude double, longitude double, frp double, acq_date date"),
        stations=spark.createDataFrame([p[:3] for p in places], "Province string, lat double, lon double"),
        weather=spark.createDataFrame([(p[0], datetime.fromisoformat(now), p[3]) for p in places], "Province string, Datetime timestamp_ntz, wind_direction_10m double"),
    )
    got = hotspot_priority_top(t).collect()

    def score(lat, lon, wind, y, x, frp):
        a = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        dist = 2 * 6371 * math.asin(math.sqrt(min(max(a, 0), 1)))
        turn = abs((math.degrees(math.atan2(x - lon, y - lat)) % 360 - wind + 180) % 360 - 180)
        return frp * (0.5 + (1 + math.cos(math.radians(turn))) / 2) / (dist + 10)

    for name, lat, lon, wind in places:
        want = sorted((score(lat, lon, wind, *f[:3]) for f in burning if f[3] >= last - timedelta(days=30)), reverse=True)[:20]
        have = [r.priority for r in sorted(got, key=lambda r: r["rank"]) if r.Province == name]
        assert len(have) == 20 and all(abs(a - b) < 1e-9 for a, b in zip(have, want)), name
    assert max(r.frp for r in got) == 9000.0
