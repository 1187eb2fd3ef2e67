import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazelake.catalog.tables import Tables
from hazelake.functions import scalar as S
from hazelake.operators import fires, panel, splits


def detections(spark):
    rows = [(1, "l", 0), (2, "n", 0), (3, None, 3), (4, "h", None), (5, None, None), (6, "h", 2)]
    return spark.createDataFrame(rows, "id int, confidence string, type int")


def ids(df):
    return {r.id for r in df.collect()}


def test_quality_filters_keep_missing(spark):
    assert ids(fires.quality_filter_archive(detections(spark))) == {2, 4, 5, 6}
    assert ids(fires.quality_filter_nrt(detections(spark))) == {2}
    assert ids(fires.quality_filter_nrt(detections(spark).drop("type"))) == {2, 3, 4, 5, 6}


def daily(spark, rows):
    return spark.createDataFrame(rows, "date date, Province string, hotspot_count double, frp_sum double, frp_mean double")


def test_densify_covers_days_times_names(spark):
    sparse = daily(spark, [(date(2024, 2, 27), "a", 2.0, 5.0, 2.5), (date(2024, 3, 1), "b", 1.0, 1.0, 1.0)])
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "Province string")
    dense = fires.densify_daily(sparse, names)
    assert dense.count() == 4 * 3  # 2024 is a leap year
    assert dense.agg(F.sum("hotspot_count")).first()[0] == 3.0
    assert dense.where("frp_mean IS NULL").count() == 0


def test_proxy_uses_four_calendar_days_then_zero(spark):
    known = daily(spark, [(date(2024, 1, d), "a", float(d), 0.0, 0.0) for d in range(1, 8)])
    hourly = spark.createDataFrame(
        [("a", datetime(2024, 1, 7)), ("a", datetime(2024, 1, 9)), ("b", datetime(2024, 1, 9))],
        "Province string, Datetime timestamp_ntz",
    )
    filled = fires.fill_from_recent(panel.attach_daily_fires(hourly, known, fill_zero=False), known)
    got = {(r.Province, r.Datetime.day): r.hotspot_count for r in filled.collect()}
    assert got == {("a", 7): 7.0, ("a", 9): 5.5, ("b", 9): 0.0}


def test_priority_properties(spark):
    rows = [(18.9, 99.0, 10.0, 0.0), (18.9, 99.0, -3.0, 360.0), (18.9, 99.0, None, 90.0), (18.7883, 98.9853, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, frp double, wind double")
    scored = fires.priority(df.withColumns({"lat": F.lit(18.7883), "lon": F.lit(98.9853)}), "lat", "lon", "wind").collect()
    assert scored[1].priority == 0.0 and scored[2].priority is None
    assert all(0 <= r.wind_factor <= 1 for r in scored)
    assert scored[3].dist_km == 0.0
    assert scored[0].wind_factor == pytest.approx(scored[1].wind_factor)  # 0 and 360 degrees agree


def test_haversine_known_distance(spark):
    df = spark.range(1).select(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d"))
    assert df.first().d == pytest.approx(6371 * 3.141592653589793 / 2)


def test_append_twice_is_once(spark):
    master = daily(spark, [(date(2024, 1, 1), "a", 1.0, 1.0, 1.0)])
    batch = daily(spark, [(date(2024, 1, 1), "b", 9.0, 9.0, 9.0), (date(2024, 1, 2), "b", 2.0, 2.0, 2.0)])
    once = panel.append_new_dates(master, batch, "date")
    assert sorted((str(r.date), r.Province) for r in once.collect()) == [("2024-01-01", "a"), ("2024-01-02", "b")]
    assert panel.append_new_dates(once, batch, "date").count() == 2
    by_key = panel.append_new_dates(master, batch, "date", ["Province"])
    assert by_key.count() == 3
    assert panel.append_new_dates(once, batch.limit(0), "date").count() == 2


def test_history_wins_over_forecast(spark):
    h = datetime(2024, 1, 1)
    history = spark.createDataFrame([(h, "a", 1.0)], "Datetime timestamp_ntz, Province string, PM25 double")
    ahead = spark.createDataFrame([(h, "a"), (h + timedelta(hours=1), "a")], "Datetime timestamp_ntz, Province string")
    union = panel.union_sources(history=history, forecast=ahead)
    got = {(r.Datetime.hour, r.source, r.PM25) for r in panel.history_wins(union).collect()}
    assert got == {(0, "history", 1.0), (1, "forecast", None)}


def test_left_join_keeps_every_hour_and_fills_zero(spark):
    hourly = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, i)) for i in range(24)] + [("b", datetime(2024, 1, 2))],
        "Province string, Datetime timestamp_ntz",
    )
    joined = panel.attach_daily_fires(hourly, daily(spark, [(date(2024, 1, 1), "a", 3.0, 6.0, 2.0)]))
    assert joined.count() == 25
    assert joined.where("Province = 'b'").first().frp_sum == 0.0


def test_densify_hours(spark):
    rows = [("a", datetime(2024, 1, 1, 0), 1.0), ("a", datetime(2024, 1, 1, 3), 2.0)]
    df = panel.densify_hours(spark.createDataFrame(rows, "Province string, Datetime timestamp_ntz, PM25 double"))
    assert [r.PM25 for r in df.orderBy("Datetime").collect()] == [1.0, None, None, 2.0]


@pytest.mark.parametrize("n", [1, 5, 10, 11, 23])
def test_ordered_split_takes_the_last_fifth(spark, n):
    rows = [(f"p{i % 3}", datetime(2024, 1, 1) + timedelta(hours=i // 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "Province string, Datetime timestamp_ntz")
    got = splits.ordered_split(df, "Datetime", "Province").orderBy("Datetime", "Province").collect()
    test = -(-n // 5)
    assert [r.split for r in got] == ["train"] * (n - test) + ["test"] * test


def test_time_split_bounds_are_inclusive(spark):
    rows = [(datetime(2024, 6, 30, 23),), (datetime(2024, 7, 1),), (datetime(2024, 12, 31, 23),), (datetime(2025, 1, 1),)]
    df = spark.createDataFrame(rows, "Datetime timestamp_ntz")
    got = splits.time_split(df, "Datetime", "2024-06-30 23:00:00", "2024-12-31 23:00:00").orderBy("Datetime")
    assert [r.split for r in got.collect()] == ["train", "validation", "validation", "test"]


def test_sample_is_independent_of_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in splits.seeded_sample(df.repartition(7), ["k"], 50).collect()}
    b = {r.k for r in splits.seeded_sample(df.coalesce(1), ["k"], 50).collect()}
    c = {r.k for r in splits.seeded_sample(df, ["k"], 50, seed=7).collect()}
    assert a == b and len(a) == 50 and a != c


def test_since_latest_includes_the_day(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3, 4)], "d date")
    assert splits.since_latest(df, "d", 1).count() == 2
    plan = splits.since_latest(df, "d", 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def laid_out(spark):
    """Two stations with an hour each in the plan's eyes, a thousand in fact."""
    hours = F.expr("explode(sequence(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-01' + INTERVAL 999 HOUR, INTERVAL 1 HOUR))")
    return spark.range(2).select(F.format_string("P%d", "id").alias("Province"), hours.alias("Datetime"), F.rand(1).alias("temperature_2m"))


def test_joins_of_hourly_tables_broadcast_neither(spark):
    weather = laid_out(spark)
    readings = weather.select("Province", "Datetime", F.lit(1.0).alias("PM25"))
    for joined in (panel.join_observations(readings, weather), panel.attach_pm25(weather, readings), panel.attach_pm25(weather, readings).where("PM25 > 0")):
        assert "BroadcastHashJoin" not in plan_of(joined)
        assert joined.count() == 2000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_hours_are_laid_out_by_several_tasks(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    for table in (tables.weather, tables.pm25):
        # a number of tasks that adaptive execution leaves alone
        assert "REPARTITION_BY_NUM" in plan_of(table)
