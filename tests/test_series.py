import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from hazelake.operators import series

SCHEMA = "Province string, Datetime timestamp_ntz, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def gappy(hours, drop=0.3, n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for name in ("A", "B"):
        for h in hours(n):
            if rng.random() > drop:
                rows.append((name, h, None if rng.random() < 0.2 else rng.random() * 50))
    return rows + [("single", hours(1)[0], 5.0), ("empty", hours(1)[0], None)]


def pandas_of(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("block", [7, 24, 1000])
def test_blocks_equal_whole_series_with_gaps(spark, hours, block):
    df = frame(spark, gappy(hours))
    w = Window.partitionBy("Province").orderBy("Datetime")
    whole = df.withColumns({"l": F.lag("v", 30).over(w), "s": F.sum("v").over(w.rowsBetween(-40, -1))})
    cut = series.windowed(
        df, "Province", "Datetime",
        lambda w: {"l": f"lag(v, 30) OVER ({w})", "s": f"sum(v) OVER ({w} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"},
        back=40, block=block,
    )
    pd.testing.assert_frame_equal(pandas_of(whole, "Province", "Datetime"), pandas_of(cut, "Province", "Datetime"))


def test_blocks_look_ahead(spark, hours):
    df = frame(spark, gappy(hours))
    w = Window.partitionBy("Province").orderBy("Datetime")
    whole = df.withColumn("l", F.lead("v", 12).over(w))
    cut = series.windowed(df, "Province", "Datetime", lambda w: {"l": f"lead(v, 12) OVER ({w})"}, ahead=12, block=10)
    pd.testing.assert_frame_equal(pandas_of(whole, "Province", "Datetime"), pandas_of(cut, "Province", "Datetime"))


def test_unknown_spacing(spark, hours):
    with pytest.raises(ValueError):
        series.to_blocks(frame(spark, gappy(hours)), "Province", "Datetime", spacing="daily")


def test_ordinal(spark, hours):
    got = pandas_of(series.with_ordinal(frame(spark, gappy(hours)), "Province", "Datetime"), "Province", "Datetime")
    expected = got.groupby("Province").cumcount()
    assert (got["_position"] == expected).all()


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("spacing,drop", [("rows", 0.3), ("hourly", 0.0)])
def test_rolling_equals_pandas(spark, hours, inclusive, spacing, drop):
    rows = gappy(hours, drop)
    spec = series.Rolling("v", (3, 7, 24, 48), {"mean": "mean_{}", "std": "std_{}", "max": "max_{}", "sum": "sum_{}"})
    got = pandas_of(
        series.with_rolling(frame(spark, rows), "Province", "Datetime", [spec], inclusive, block=24, spacing=spacing),
        "Province", "Datetime",
    )
    for _, part in got.groupby("Province"):
        v = part["v"] if inclusive else part["v"].shift(1)
        for n in spec.lengths:
            roll = v.rolling(n) if inclusive else v.rolling(n, min_periods=1)
            for stat in ("mean", "std", "max", "sum"):
                np.testing.assert_allclose(
                    part[f"{stat}_{n}"].to_numpy(float), getattr(roll, stat)().to_numpy(float), rtol=1e-9, atol=1e-7
                )
    assert not [c for c in got.columns if c.startswith("_")]


def test_rolling_of_equal_values_has_no_spread(spark, hours):
    rows = [("A", h, 0.1 if i < 30 else 77.7) for i, h in enumerate(hours(120))]
    spec = series.Rolling("v", (24,), {"std": "std_{}", "mean": "mean_{}"})
    got = pandas_of(series.with_rolling(frame(spark, rows), "Province", "Datetime", [spec]), "Datetime")
    assert (got["std_24"].iloc[2:30] == 0.0).all() and (got["std_24"].iloc[60:] == 0.0).all()


def test_fill_gaps(spark, hours):
    df = frame(spark, gappy(hours))
    got = pandas_of(series.fill_gaps(df, "Province", "Datetime", ["v"], block=24), "Province", "Datetime")
    expected = pandas_of(df, "Province", "Datetime")
    expected["v"] = expected.groupby("Province")["v"].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_frame_equal(got, expected)


def test_keep_first_and_top(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, t string")
    assert {(r.k, r.t) for r in series.keep_first(df, "k", ["o"]).collect()} == {("a", "y"), ("b", "z")}
    top = series.top_per_group(df, "k", [F.desc("o")], 1)
    assert {(r.k, r.o, r.rank) for r in top.collect()} == {("a", 2, 1), ("b", 3, 1)}


def test_top_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = series.top_per_group(df, "k", [F.desc("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_label_encode_is_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "Province string")
    got = {r.Province: r.label for r in series.label_encode(df, "Province", "label").collect()}
    assert got == {"a": 0, "b": 1}


def test_ordinals_do_not_broadcast_the_rows(spark):
    hours = F.expr("explode(sequence(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-01-01' + INTERVAL 99 HOUR, INTERVAL 1 HOUR))")
    rows = spark.range(2).select("id", hours.alias("ts"))
    numbered = series.with_ordinal(rows, "id", "ts", "n")
    assert "BroadcastHashJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [r["n"] for r in numbered.where("id = 1").orderBy("ts").collect()] == list(range(100))


def test_ordinals_use_the_exchange_of_a_join_by_day(spark):
    hours = spark.range(300).selectExpr("'A' AS k", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id * 5 % 301 AS INT)) AS ts")
    dated = hours.withColumn("date", F.to_date("ts"))
    days = dated.select("k", "date").distinct().withColumn("v", F.lit(1))
    joined = dated.join(days.hint("merge"), ["date", "k"], "left")
    got, before = series.with_ordinal(joined, "k", "ts", day="date"), series.with_ordinal(joined, "k", "ts")
    for df in (got, before):
        assert [r._position for r in df.orderBy("ts").collect()] == list(range(300))
    dealt = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (got, before)]
    assert dealt[0] < dealt[1]
