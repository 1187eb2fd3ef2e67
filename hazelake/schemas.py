"""Declared schemas, so that no reader has to infer one."""

from pyspark.sql import types as T

from hazelake.constants import FIRE_COLUMNS, WEATHER_COLUMNS


def _doubles(names):
    return [T.StructField(name, T.DoubleType()) for name in names]


PM25 = T.StructType([
    T.StructField("Datetime", T.TimestampNTZType()),
    T.StructField("PM25", T.DoubleType()),
    T.StructField("Province", T.StringType()),
])
WEATHER = T.StructType([
    T.StructField("Datetime", T.TimestampNTZType()),
    T.StructField("Province", T.StringType()),
    *_doubles(WEATHER_COLUMNS),
])
HOTSPOTS = T.StructType([
    T.StructField("acq_date", T.DateType()),
    *_doubles(["latitude", "longitude", "frp", "bright_ti4"]),
    T.StructField("confidence", T.StringType()),
    T.StructField("type", T.IntegerType()),
])
HOTSPOT_DAILY = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("Province", T.StringType()),
    *_doubles(FIRE_COLUMNS),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def hourly_payload(columns):
    """Schema of a provider body: one object of parallel arrays under ``hourly``."""
    arrays = [T.StructField(name, T.ArrayType(T.DoubleType())) for name in columns]
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *arrays])
    return T.StructType([T.StructField("hourly", hourly)])
