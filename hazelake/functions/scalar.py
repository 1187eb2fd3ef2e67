"""Column functions: calendar, cyclic encodings, geometry on the sphere, risk levels, alerts.

All of them are built-in Catalyst expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from hazelake.constants import (
    AUDIENCE_THRESHOLDS,
    BAND_LOWER,
    BAND_UPPER,
    EARTH_RADIUS_KM,
    RISK_LEVELS,
    TREND_ICON_STEP,
    ZONE_AFFECTED,
    ZONE_DANGER,
)

TWO_PI = 2 * math.pi


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_hour(ts: str) -> Column:
    """Truncate a zone-less timestamp to the hour without a detour through the session zone."""
    return F.expr(f"{ts} - make_dt_interval(0, 0, minute({ts}), extract(SECOND FROM {ts}))")


def hour_index(ts: str) -> Column:
    """Whole hours since 1970-01-01 of a zone-less timestamp."""
    return F.expr(f"CAST(datediff(to_date({ts}), DATE'1970-01-01') AS BIGINT) * 24 + hour({ts})")


def missing_to_null(value) -> Column:
    """NaN is how other tools spell missing; Spark aggregates only skip NULL."""
    value = col(value)
    return F.when(~F.isnan(value), value)


def calendar_parts(ts: str) -> dict[str, Column]:
    ts = F.col(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "dayofyear": F.dayofyear(ts),
        "weekday": F.weekday(ts),
    }


def cyclic(value, period: float) -> tuple[Column, Column]:
    angle = F.lit(TWO_PI) * col(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def in_months(ts: str, months) -> Column:
    return F.month(ts).isin(list(months)).cast("int")


def clip_at_zero(value) -> Column:
    """``greatest`` alone would turn NULL into 0."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    inner = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_dlon), F.lit(2.0))
    inner = F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(inner))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Planar bearing from point 1 to point 2, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    return F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)), F.lit(360.0))


def angle_between(a, b) -> Column:
    """Smallest difference of two directions, in [0, 180]."""
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def wind_factor(angle) -> Column:
    return (F.cos(F.radians(col(angle))) + 1.0) / 2.0


def fire_priority(frp, wind, distance_km) -> Column:
    return clip_at_zero(frp) * (col(wind) + 0.5) / (col(distance_km) + 10.0)


def risk_attribute(value, attribute: int) -> Column:
    """Attribute of the first level whose bound holds the value.

    A missing value satisfies no comparison and so lands in the worst level, on purpose:
    an alerting table must not hide a station that stopped reporting. See ``is_missing``.
    """
    value = col(value)
    branches = [(value <= F.lit(level[0]), F.lit(level[attribute])) for level in RISK_LEVELS[:-1]]
    first = F.when(*branches[0])
    chain = reduce(lambda acc, branch: acc.when(*branch), branches[1:], first)
    return chain.otherwise(F.lit(RISK_LEVELS[-1][attribute]))


def risk_level(value) -> Column:
    return risk_attribute(value, 1)


def risk_label(value) -> Column:
    return risk_attribute(value, 2)


def risk_colour(value) -> Column:
    return risk_attribute(value, 3)


def risk_advice(value) -> Column:
    return risk_attribute(value, 4)


def is_missing(value) -> Column:
    value = col(value)
    return value.isNull() | F.isnan(value)


def audience_alerts(value) -> Column:
    """Array of (audience, is_alert); explode it for the long form."""
    value = col(value)
    entries = [
        F.struct(
            F.lit(audience).alias("audience"),
            F.coalesce(value > F.lit(bound), F.lit(False)).alias("is_alert"),
        )
        for audience, bound in AUDIENCE_THRESHOLDS
    ]
    return F.array(*entries)


def trend_icon(trend) -> Column:
    trend = col(trend)
    return (
        F.when(trend > TREND_ICON_STEP, F.lit("up"))
        .when(trend < -TREND_ICON_STEP, F.lit("down"))
        .otherwise(F.lit("flat"))
    )


def trend_direction(trend) -> Column:
    return F.when(col(trend) > 0, F.lit("rising")).otherwise(F.lit("falling"))


def band_lower(value) -> Column:
    return col(value) * F.lit(BAND_LOWER)


def band_upper(value) -> Column:
    return col(value) * F.lit(BAND_UPPER)


def zone(value) -> Column:
    value = col(value)
    return (
        F.when(value >= ZONE_DANGER, F.lit("danger"))
        .when(value >= ZONE_AFFECTED, F.lit("affected"))
        .when(value.isNotNull(), F.lit("normal"))
    )


def axis_bound(observed_max, forecast_max) -> Column:
    """Upper chart bound: 10 % above the larger maximum, 150 at least."""
    scaled = [F.coalesce(col(c), F.lit(0.0)) * 1.1 for c in (observed_max, forecast_max)]
    return F.greatest(F.lit(150.0), *scaled)


def with_unit(value, digits: int = 1, unit: str = "µg/m³") -> Column:
    return F.concat(F.format_string(f"%.{digits}f", col(value)), F.lit(f" {unit}"))


def safe_corr(a, b, over=None) -> Column:
    """Pearson r over the rows where both are present; NULL where one of them is constant.

    ``corr`` raises on a constant column in ANSI mode, hence the explicit quotient.
    """
    a, b = col(a), col(b)
    a_seen, b_seen = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = [F.covar_pop(a, b), F.var_pop(a_seen), F.var_pop(b_seen)]
    if over is not None:
        parts = [part.over(over) for part in parts]
    cov, var_a, var_b = parts
    return F.try_divide(cov, F.sqrt(var_a * var_b))
