"""Domain tables derived by Spark from the generic ``events`` table.

Every station is one user of the events table, so the tables grow with it: 720 hours per user and
one fire detection per ``error`` or ``purchase`` event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazelake.functions.scalar import floor_hour, hour_index
from hazelake.operators import fires, geo, panel
from hazelake.operators.lookup import lookup
from hazelake.operators.splits import ntz
from hazelake.plans.batch import batch_frame
from hazelake.session import materialised

NOW = "2024-01-24 00:00:00"
TRAIN_END = "2024-01-20 23:00:00"
VALIDATION_END = "2024-01-25 23:00:00"
#: events for which the stations get one more task to lay out their hours in
EVENTS_PER_TASK = 16_384


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._batches: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.raw("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))

    @cached_property
    def stations(self) -> DataFrame:
        users = self.raw("events").select(F.col("user_id").alias("pid")).distinct()
        return users.select(
            "pid",
            F.concat(F.lit("P"), F.lpad(F.col("pid").cast("string"), 6, "0")).alias("Province"),
            F.expr("17.59D + (pid div 40) * 0.075D").alias("lat"),
            F.expr("97.39D + (pid % 40) * 0.1D").alias("lon"),
        )

    @cached_property
    def spread_stations(self) -> DataFrame:
        """The stations dealt out to tasks that grow in number with the events.

        Each becomes a row per hour. Adaptive execution sees a small table and would put all of them into one task.
        """
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.raw("events").count() // EVENTS_PER_TASK))
        # by a hash: Spark leaves out an exchange by ``pid`` where the one before happens to have as many parts
        return self.stations.repartition(tasks, F.xxhash64("pid"))

    @cached_property
    def polygons(self) -> DataFrame:
        x0, y0 = F.expr("97.3537D + (pid % 40) * 0.1D"), F.expr("17.5531D + (pid div 40) * 0.075D")
        corners = [(0.0, 0.0), (0.045, 0.02001), (0.09, 0.005), (0.095, 0.07), (0.005, 0.065), (0.0, 0.0)]
        ring = F.array(*[
            F.struct((x0 + F.lit(dx)).alias("x"), (y0 + F.lit(dy)).alias("y")) for dx, dy in corners
        ])
        return self.stations.select("Province", F.array(ring).alias("rings"))

    @cached_property
    def weather(self) -> DataFrame:
        moment = self.raw("events").select(floor_hour("ts").alias("h"))
        first = moment.select(F.min("h")).scalar()
        last = moment.select(F.max("h")).scalar()
        hours = F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("Datetime")
        grid = self.spread_stations.select("pid", "Province", hours).withColumn(
            "i", hour_index("Datetime") - 473352  # hours from 1970 to 2024
        )
        return grid.select(
            "pid",
            "Province",
            "Datetime",
            F.expr("15D + ((i * 7 + pid * 3) % 200) / 10D").alias("temperature_2m"),
            F.expr("30D + ((i * 11 + pid * 5) % 700) / 10D").alias("relative_humidity_2m"),
            F.expr("greatest(0, ((i * 13 + pid) % 50) - 40) / 10D").alias("precipitation"),
            F.expr("950D + ((i * 3 + pid * 17) % 400) / 10D").alias("surface_pressure"),
            F.expr("((i * 5 + pid * 7) % 150) / 10D").alias("wind_speed_10m"),
            F.expr("CAST((i * 37 + pid * 41) % 360 AS DOUBLE)").alias("wind_direction_10m"),
        )

    @cached_property
    def pm25(self) -> DataFrame:
        """Readings of a station follow the mean event value of its group in that hour."""
        cells = (
            self.observations.groupBy((F.col("user_id") % 8).alias("g"), floor_hour("ts").alias("Datetime"))
            .agg(F.avg("value").alias("v"))
            .withColumn("i", hour_index("Datetime") - 473352)
        )
        # 8 rows an hour, whatever the number of stations: an exchange by group would undo the dealing out
        joined = lookup(self.spread_stations.withColumn("g", F.col("pid") % 8), F.broadcast(cells), "g", "inner", salts=1)
        return joined.select(
            "pid",
            "Province",
            "Datetime",
            F.expr("(3D + (pid % 13) / 2D) * sqrt(v + ((i * 5 + pid * 11) % 17))").alias("PM25"),
        )

    @cached_property
    def hotspots(self) -> DataFrame:
        fires_only = self.observations.where(F.col("event_type").isin("error", "purchase"))
        return fires_only.select(
            "event_id",
            "ts",
            F.to_date("ts").alias("acq_date"),
            F.expr("(17550 + (user_id div 40) * 75 + (k * 11) % 83) / 1000D").alias("latitude"),
            F.expr("(9734 + (user_id % 40) * 10 + (k * 7) % 19) / 100D").alias("longitude"),
            F.expr("4D * sqrt(value)").alias("frp"),
            F.expr("300D + k").alias("bright_ti4"),
            F.expr(
                "CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 = 0 THEN 'l' WHEN k % 3 = 1 THEN 'n' ELSE 'h' END"
            ).alias("confidence"),
            F.expr("CASE WHEN user_id % 17 = 0 THEN 3 WHEN user_id % 19 = 0 THEN 2 ELSE 0 END").alias("type"),
        )

    # ---- what the operators make of them, in the order of the daily batch
    @cached_property
    def observed(self) -> DataFrame:
        """Weather hours with readings."""
        return panel.attach_pm25(self.weather, self.pm25)

    @cached_property
    def good_fires(self) -> DataFrame:
        return fires.quality_filter_archive(self.hotspots)

    @cached_property
    def located(self) -> DataFrame:
        return geo.spatial_join(self.good_fires, self.polygons)

    @cached_property
    def daily_sparse(self) -> DataFrame:
        return fires.daily_totals(self.located)

    @cached_property
    def daily(self) -> DataFrame:
        return fires.densify_daily(self.daily_sparse, self.stations)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.attach_daily_fires(self.observed, self.daily_sparse)

    @cached_property
    def shifted(self) -> DataFrame:
        """The panel with each station moved by some 30-day steps, to fill month columns."""
        return self.panel.withColumn(
            "Datetime", F.expr("Datetime + make_dt_interval(CAST(pid % 12 AS INT) * 30)")
        )

    @cached_property
    def upto_now(self) -> DataFrame:
        """The panel as it is known at NOW: later readings are unknown."""
        known = F.col("Datetime") <= F.lit(NOW).cast("timestamp_ntz")
        return self.panel.withColumn("PM25", F.when(known, F.col("PM25")))

    def batch(self, now: str = NOW) -> DataFrame:
        """What the daily batch knows at ``now``, written once; forecast weather is the actual one, a degree warmer."""
        ahead = self.weather.where(F.col("Datetime") >= ntz(now) - F.expr("INTERVAL 1 DAY"))
        warmer = ahead.withColumn("temperature_2m", F.col("temperature_2m") + 1)
        if now not in self._batches:
            self._batches[now] = materialised(batch_frame(self.observed, warmer, self.daily, now), "batch")
        return self._batches[now]
