import random
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazelake.constants import FEATURES, FIRE_COLUMNS, WEATHER_COLUMNS
from hazelake.operators import panel
from hazelake.plans import features as X


def sources(spark, hours, n=220):
    rng = random.Random(11)
    weather, pm25 = [], []
    for name in ("A", "B", "dry"):
        for h in hours(n):
            weather.append((name, h, *[round(rng.uniform(0, 90), 1) for _ in WEATHER_COLUMNS]))
            if name != "dry" and rng.random() > 0.1:
                pm25.append((name, h, rng.uniform(5, 80)))
    weather.append(("single", hours(1)[0], *[1.0] * len(WEATHER_COLUMNS)))
    days = [(date(2024, 1, d), p, float(d % 4), float(d), float(d) / 2) for d in range(1, 8, 2) for p in ("A", "B")]
    return (
        spark.createDataFrame(weather, "Province string, Datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in WEATHER_COLUMNS)),
        spark.createDataFrame(pm25, "Province string, Datetime timestamp_ntz, PM25 double"),
        spark.createDataFrame(days, "date date, Province string, " + ", ".join(f"{c} double" for c in FIRE_COLUMNS)),
    )


def assembled(weather, pm25, daily):
    return panel.attach_daily_fires(panel.attach_pm25(weather, pm25), daily)


def sorted_pandas(df):
    return df.toPandas().sort_values(["Province", "Datetime"]).reset_index(drop=True)


def test_names_and_order():
    assert len(FEATURES) == len(set(FEATURES)) == 69
    assert FEATURES[0] == "temperature_2m" and FEATURES[-1] == "humidity_delta_24h"


@pytest.fixture(scope="module")
def built(spark, hours):
    weather, pm25, daily = sources(spark, hours)
    whole = assembled(weather, pm25, daily).cache()
    encoding = X.target_encoding(weather, "2024-01-05 00:00:00", readings=pm25)
    return whole, encoding, sorted_pandas(X.feature_matrix(whole, encoding))


def test_both_routes_agree(spark, hours, built):
    whole, encoding, direct = built
    weather, pm25, daily = sources(spark, hours)
    merged = sorted_pandas(X.feature_matrix_from_sources(weather, pm25, daily, encoding, block=48))
    pd.testing.assert_frame_equal(direct, merged, check_exact=False, rtol=1e-9, atol=1e-7)
    blocked = sorted_pandas(X.feature_matrix(whole, encoding, block=24, spacing="hourly"))
    pd.testing.assert_frame_equal(direct, blocked, check_exact=False, rtol=1e-9, atol=1e-7)


def test_training_features_match_pandas(built):
    whole, _, got = built
    assert list(got.columns) == ["Province", "Datetime", "PM25", *FEATURES]
    source = sorted_pandas(whole)
    for name in ("A", "dry"):
        p = source[source["Province"] == name].reset_index(drop=True)
        g = got[got["Province"] == name].reset_index(drop=True)
        before = p["PM25"].shift(1)
        expected = {
            "pm25_lag_72h": p["PM25"].shift(72),
            "pm25_roll_mean_48h": before.rolling(48, min_periods=1).mean(),
            "pm25_roll_std_168h": before.rolling(168, min_periods=1).std(),
            "pm25_roll_max_12h": before.rolling(12, min_periods=1).max(),
            "frp_roll_sum_168h": p["frp_sum"].shift(1).rolling(168, min_periods=1).sum(),
            "hotspot_log_lag_24h": np.log1p(p["hotspot_count"].shift(24)).fillna(0),
            "pm25_delta_24h": p["PM25"].diff(24).shift(1),
            "humidity_delta_1h": p["relative_humidity_2m"].diff(1),
            "day_sin": np.sin(2 * np.pi * p["Datetime"].dt.day / 365),
            "temp_x_humidity": p["temperature_2m"] * p["relative_humidity_2m"] / 100,
        }
        for feature, values in expected.items():
            np.testing.assert_allclose(g[feature].to_numpy(float), values.to_numpy(float), rtol=1e-9, atol=1e-7, err_msg=feature)


def test_encodings(built):
    _, _, got = built
    codes = got.groupby("Province")[["province_label", "province_target_enc"]].first()
    assert codes["province_label"].to_dict() == {"A": 0, "B": 1, "dry": 2, "single": 3}
    assert codes.loc["dry", "province_target_enc"] == 0.0


def test_unseen_station_gets_defaults(spark, built):
    whole, encoding, _ = built
    other = whole.where("Province = 'A'").withColumn("Province", F.lit("new"))
    row = X.feature_matrix(other, encoding).first()
    assert row.province_label == -1 and row.province_target_enc == 0.0


def test_features_never_see_the_future(built):
    whole, encoding, before = built
    cut = pd.Timestamp("2024-01-06 05:00:00")
    later = F.col("Datetime") >= F.lit(str(cut)).cast("timestamp_ntz")
    changed = whole.withColumns({c: F.when(later, F.lit(999.0)).otherwise(F.col(c)) for c in ("PM25", "hotspot_count")})
    after = sorted_pandas(X.feature_matrix(changed, encoding))
    early = before["Datetime"] < cut
    pd.testing.assert_frame_equal(before[early], after[early], check_exact=False, rtol=1e-9, atol=1e-7)
    own_target = [c for c in FEATURES if c.startswith("pm25")]
    at = before["Datetime"] == cut
    pd.testing.assert_frame_equal(before.loc[at, own_target], after.loc[at, own_target], check_exact=False, rtol=1e-9, atol=1e-7)


def test_serving_profile(built):
    whole, _, _ = built
    got = sorted_pandas(X.feature_matrix(whole, X.frame_encoding(whole), profile="serving"))
    assert got["pm25_lag_72h"].notna().all() and set(got["Province"]) == {"A", "B"}
    source = sorted_pandas(whole)
    p = source[source["Province"] == "A"].reset_index(drop=True)
    g = got[got["Province"] == "A"]
    at = p["Datetime"].isin(g["Datetime"])
    np.testing.assert_allclose(g["pm25_roll_mean_3h"].to_numpy(), p["PM25"].rolling(3).mean()[at].to_numpy())
    np.testing.assert_allclose(g["pm25_delta_1h"].to_numpy(), p["PM25"].diff(1)[at].to_numpy())
    assert (g["is_haze_season"] == 1).all()
    assert (g["temp_x_humidity"].to_numpy() == (p["temperature_2m"] * p["relative_humidity_2m"])[at].to_numpy()).all()


def test_catalog(built):
    whole, encoding, direct = built
    rows = X.feature_catalog(X.feature_matrix(whole, encoding)).orderBy("ordinal").collect()
    assert [r.feature for r in rows] == FEATURES
    assert {r.feature: r.n_present for r in rows}["pm25_lag_72h"] == direct["pm25_lag_72h"].notna().sum()


def test_one_exchange_for_all_windows(spark, hours):
    weather, pm25, daily = sources(spark, hours)
    blocks = X.merge_sources(weather, pm25, daily)
    w = "PARTITION BY Province, _block ORDER BY Datetime"
    plan = X.rolling(blocks, w, [X.PM25_ROLLING, *X.FIRE_ROLLING], False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(Province") == 1 and "Join" not in plan
