"""Fire detections: quality filters, daily totals, dense date grid, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.constants import FIRE_COLUMNS, LOW_CONFIDENCE
from hazelake.functions import scalar as S
from hazelake.operators.lookup import lookup
from hazelake.operators.series import top_per_group
from hazelake.session import materialised

WATER_REFLECTION = 3
VEGETATION = 0
#: fires of all places for which their classes get one more task
FIRES_PER_TASK = 4096


def quality_filter_archive(hotspots: DataFrame) -> DataFrame:
    """Drop low confidence and water reflections; rows missing either attribute stay."""
    return hotspots.where(
        ~F.col("confidence").eqNullSafe(LOW_CONFIDENCE) & ~F.col("type").eqNullSafe(WATER_REFLECTION)
    )


def quality_filter_nrt(hotspots: DataFrame) -> DataFrame:
    """Near-real-time feed: drop low confidence; keep vegetation fires if the feed says the type."""
    keep = ~F.col("confidence").eqNullSafe(LOW_CONFIDENCE)
    if "type" in hotspots.columns:
        keep = keep & F.col("type").eqNullSafe(VEGETATION)
    return hotspots.where(keep)


def daily_totals(located: DataFrame, date: str = "acq_date", name: str = "Province") -> DataFrame:
    return located.groupBy(F.col(date).alias("date"), name).agg(
        F.count("frp").alias("hotspot_count"),
        F.sum("frp").alias("frp_sum"),
        F.avg("frp").alias("frp_mean"),
    )


def densify_daily(daily: DataFrame, names: DataFrame, date: str = "date", name: str = "Province") -> DataFrame:
    """Every name on every date between the first and last one, absent measures 0."""
    first = daily.select(F.min(date)).scalar()
    last = daily.select(F.max(date)).scalar()
    grid = names.select(name).distinct().select(name, F.explode(F.sequence(first, last)).alias(date))
    filled = grid.join(daily, [date, name], "left")
    return filled.select(
        date, name, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FIRE_COLUMNS]
    )


def recent_means(daily: DataFrame, days: int = 3) -> DataFrame:
    """Mean fire measures per name over the days up to ``days`` before the latest date."""
    latest = daily.select(F.max("date")).scalar()
    recent = daily.where(F.col("date") >= F.date_sub(latest, days))
    return recent.groupBy("Province").agg(*[F.avg(c).alias(f"_proxy_{c}") for c in FIRE_COLUMNS])


def fill_from_recent(panel: DataFrame, daily: DataFrame, days: int = 3) -> DataFrame:
    """Rows without a fire count take the recent means of their name for all measures, else 0."""
    unknown = F.col("hotspot_count").isNull()
    filled = lookup(panel, recent_means(daily, days), "Province").withColumns({
        c: F.coalesce(F.when(unknown, F.col(f"_proxy_{c}")).otherwise(F.col(c)), F.lit(0.0))
        for c in FIRE_COLUMNS
    })
    return filled.select(*panel.columns)


def priority(hotspots: DataFrame, lat: str, lon: str, wind: str) -> DataFrame:
    """Score detections against the place whose coordinates and wind direction the row carries."""
    scored = hotspots.withColumn("dist_km", S.haversine_km(lat, lon, "latitude", "longitude"))
    scored = scored.withColumn(
        "wind_factor",
        S.wind_factor(S.angle_between(S.bearing_deg(lat, lon, "latitude", "longitude"), wind)),
    )
    return scored.withColumn("priority", S.fire_priority("frp", "wind_factor", "dist_km"))


def priority_top(scored: DataFrame, n: int, key: str = "Province", rank: str = "rank") -> DataFrame:
    order = [
        F.col("priority").desc_nulls_last(),
        F.col("latitude").asc(),
        F.col("longitude").asc(),
        F.col("frp").asc(),
        F.col("acq_date").asc(),
    ]
    return top_per_group(scored.where(S.missing_to_null("priority").isNotNull()), key, order, n, rank)


def _distance_bound(lat, lon, cx, cy, cell: float):
    """At most the distance from a place to any point of a grid cell, in km."""
    south, west = cy * cell, cx * cell
    nearest = F.greatest(south, F.least(south + cell, lat))
    along = F.lit(S.EARTH_RADIUS_KM) * F.radians(F.abs(lat - nearest))
    gap = F.greatest(F.lit(0.0), west - lon, lon - west - cell)
    turned = F.least(gap, F.greatest(F.lit(0.0), F.lit(360.0 - cell) - gap), F.lit(180.0))
    flattest = F.least(F.cos(F.radians(south)), F.cos(F.radians(south + cell)))
    across = F.sqrt(F.greatest(F.cos(F.radians(lat)) * F.greatest(flattest, F.lit(0.0)), F.lit(0.0))) * F.sin(F.radians(turned) / 2)
    return F.greatest(along, F.lit(2 * S.EARTH_RADIUS_KM) * F.asin(F.least(across, F.lit(1.0))))


def priority_top_of_all(hotspots: DataFrame, places: DataFrame, n: int, cell: float = 0.5, key: str = "Province") -> DataFrame:
    """The ``n`` fires of highest priority for each place (lat, lon, wind), wherever they burn.

    Without scoring every fire against every place: fires lie in classes of grid cell and power (powers of two). The
    priority of a fire is at most 1.5 frp / (distance + 10), so a class whose strongest fire, at the nearest point of the
    cell, stays below the n-th best priority that a place has among the strongest fires around it has nothing to offer.
    Only places and classes that pass are joined. Classes are few: cells of a grid times some twenty powers. Places that
    have too few fires around them look at all classes.
    """
    cx, cy = F.floor(F.col("longitude") / cell), F.floor(F.col("latitude") / cell)
    known = hotspots.where(S.missing_to_null("frp").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    strength = F.when(F.col("frp") > 0, F.floor(F.log2("frp"))).otherwise(F.lit(-1100)).cast("int")
    # read by classes, floors and the last join: written once, in the columns that are ranked
    placed = materialised(known.withColumns({"_cx": cx, "_cy": cy, "_power": strength}), "placed-fires")
    classes = placed.groupBy("_cx", "_cy", "_power").agg(F.max("frp").alias("_most"))
    spots = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())

    # the n-th best among the strongest fires of the cells around
    strongest = top_per_group(placed, ["_cx", "_cy"], [F.desc("frp")], n, "_rn")
    around = F.sequence(F.lit(-1), F.lit(1))
    near = spots.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({
        "_cx": F.floor(F.col("lon") / cell) + F.col("_dx"), "_cy": F.floor(F.col("lat") / cell) + F.col("_dy"),
    })
    scored = priority(near.join(strongest, ["_cx", "_cy"]), "lat", "lon", "wind")
    floors = top_per_group(scored, key, [F.desc("priority")], n, "_rn").where(F.col("_rn") == n).select(key, F.col("priority").alias("_floor"))
    wanted = spots.join(floors, key, "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)))

    # cells that the strongest fire of all could count from
    extent = classes.agg(*[f(c).alias(f"{w}{c}") for w, f in (("lo", F.min), ("hi", F.max)) for c in ("_cx", "_cy")], F.max("_most").alias("most"))
    bounds = extent.select(F.struct("*")).scalar()
    lo_x, hi_x, lo_y, hi_y, most = (bounds[c] for c in ("lo_cx", "hi_cx", "lo_cy", "hi_cy", "most"))
    reach = F.when(F.col("_floor") > 0, F.lit(1.5) * F.greatest(most, F.lit(0.0)) / F.col("_floor") / 111.0 + cell).otherwise(F.lit(400.0))
    # degrees of longitude shrink towards the poles
    wide = reach / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.0)))), F.lit(0.02))

    def cells(at, half, lo, hi):
        first = F.greatest(F.floor((F.col(at) - half) / cell), lo)
        last = F.least(F.floor((F.col(at) + half) / cell), hi)
        # over the date line the range is not one piece: take all
        whole = (F.abs(F.col(at)) + half > 180) if at == "lon" else F.lit(False)
        first, last = F.when(whole, lo).otherwise(first), F.when(whole, hi).otherwise(last)
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    reached = wanted.withColumn("_cy", cells("lat", reach, lo_y, hi_y)).withColumn("_cx", cells("lon", wide, lo_x, hi_x))
    least = _distance_bound(F.col("lat"), F.col("lon"), F.col("_cx"), F.col("_cy"), cell)
    bound = F.lit(1.5 * (1 + 1e-9)) * F.greatest(F.col("_most"), F.lit(0.0)) / (least * (1 - 1e-9) + 10)
    chosen = reached.join(classes, ["_cx", "_cy"]).where(bound >= F.col("_floor")).drop("_most")
    # both sides are small next to what the join makes of them: adaptive execution would put them into a few tasks
    of_class = ["_cx", "_cy", "_power"]
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, -(-placed.count() // FIRES_PER_TASK))
    all_scored = priority(chosen.repartition(tasks, *of_class).join(placed.repartition(tasks, *of_class), of_class), "lat", "lon", "wind")
    # n fires reach the floor: the others are left out before rows are sorted by place
    return priority_top(all_scored.where(F.col("priority") >= F.col("_floor") * (1 - 1e-9)).drop("_floor"), n, key)
