import itertools
import random
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazelake.constants import FEATURES, FIRE_COLUMNS, WEATHER_COLUMNS
from hazelake.functions.trees import Ensemble, attribute, leaf_games
from hazelake.operators.splits import complete_cases
from hazelake.plans import explain, forecast, model
from hazelake.plans.features import feature_matrix, target_encoding


@pytest.fixture(scope="module")
def panel(spark, hours):
    rng = random.Random(21)
    rows = []
    for s, name in enumerate(("A", "B", "C", "dry")):
        level = 30.0 + 10 * s
        for i, h in enumerate(hours(400)):
            level = 0.9 * level + 0.1 * (30 + 10 * s) + rng.gauss(0, 3)
            value = None if name == "dry" or i >= 380 - s else max(level, 1.0)
            rows.append((name, h, value, *[rng.uniform(0, 50) for _ in WEATHER_COLUMNS], *[float(i // 24 % 3)] * 3))
    columns = ["PM25", *WEATHER_COLUMNS, *FIRE_COLUMNS]
    return spark.createDataFrame(
        rows, "Province string, Datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
    ).cache()


@pytest.fixture(scope="module")
def features(panel):
    return feature_matrix(panel, target_encoding(panel, "2024-01-14 00:00:00")).cache()


@pytest.fixture(scope="module")
def fitted(features):
    return model.fit(features, maxIter=4, maxDepth=3, stepSize=0.3)


@pytest.fixture(scope="module")
def complete(features):
    return complete_cases(features, [*FEATURES, "PM25"]).cache()


def test_flat_trees_predict_like_spark(complete, fitted):
    rows = model.score(complete, fitted, clip=False).toPandas()
    flat = fitted.ensemble.predict(rows[FEATURES].to_numpy(float))
    np.testing.assert_allclose(flat, rows["predicted"], rtol=1e-12)


def test_prefix_scoring(complete, fitted):
    both = model.score(model.score(complete, fitted), fitted, trees=4, name="flat").toPandas()
    np.testing.assert_allclose(both["predicted"], both["flat"], rtol=1e-12)
    one = model.score(complete, fitted, trees=1).toPandas()["predicted"]
    assert one.nunique() <= 8


def test_saved_model_loads(spark, complete, fitted, tmp_path):
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"))
    x = complete.limit(20).toPandas()[FEATURES].to_numpy(float)
    np.testing.assert_array_equal(again.ensemble.predict(x), fitted.ensemble.predict(x))


def test_contributions_add_up_to_the_prediction(complete, fitted):
    scored = model.score(complete, fitted, clip=False)
    rows = explain.with_contributions(scored, fitted).select(
        "predicted", (F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)).alias("sum")
    )
    assert rows.where(F.abs(F.col("predicted") - F.col("sum")) > 1e-9).count() == 0


def brute_force_shapley(tree: Ensemble, x, d):
    """Expectation over the training covers for every coalition, then the textbook formula."""

    def value(known, node):
        if tree.left[node] < 0:
            return tree.value[node]
        f, children = tree.feature[node], (tree.left[node], tree.right[node])
        if f in known:
            return value(known, children[0] if x[f] <= tree.threshold[node] else children[1])
        return sum(tree.cover[c] / tree.cover[node] * value(known, c) for c in children)

    phi = np.zeros(d)
    for f in range(d):
        others = [g for g in range(d) if g != f]
        for k in range(d):
            for known in itertools.combinations(others, k):
                weight = factorial(k) * factorial(d - k - 1) / factorial(d)
                phi[f] += weight * (value({*known, f}, 0) - value(set(known), 0))
    return phi


def test_contributions_are_shapley_values():
    # one feature is split on twice along a path
    nodes = pd.DataFrame(
        [
            (0, 0, 0, 0.5, 1, 2, 0.0, 100.0), (0, 1, 1, 0.3, 3, 4, 0.0, 60.0), (0, 2, 2, 0.6, 5, 6, 0.0, 40.0),
            (0, 3, 0, 0.2, 7, 8, 0.0, 25.0), (0, 4, -1, 0.0, -1, -1, 4.0, 35.0), (0, 5, -1, 0.0, -1, -1, -2.0, 10.0),
            (0, 6, -1, 0.0, -1, -1, 9.0, 30.0), (0, 7, -1, 0.0, -1, -1, 1.0, 5.0), (0, 8, -1, 0.0, -1, -1, 7.0, 20.0),
        ],
        columns=["tree", "id", "feature", "threshold", "left", "right", "value", "cover"],
    )
    tree = Ensemble.from_nodes(nodes, [1.0])
    games, expected = leaf_games(tree)
    assert expected == pytest.approx((35 * 4 - 2 * 10 + 9 * 30 + 5 + 7 * 20) / 100)
    x = np.random.default_rng(0).random((30, 3))
    got = attribute(games, x)
    for row, phi in zip(x, got):
        np.testing.assert_allclose(phi, brute_force_shapley(tree, row, 3), atol=1e-12)
    np.testing.assert_allclose(got.sum(axis=1) + expected, tree.predict(x))


def test_top_factors(spark):
    rows = [("a", 1.0, "f1", 5.0), ("a", 1.0, "f2", -6.0), ("a", 1.0, "f3", 1.0), ("a", 1.0, "pm25_lag_24h", 4.0)]
    long = spark.createDataFrame(rows, "k string, base double, feature string, contribution double")
    got = {r.feature: r for r in explain.top_factors(long, ["k"], n=3, leading=1).collect()}
    assert set(got) == {"f2", "f1", "pm25_lag_24h"}
    assert got["f2"]["rank"] == 1 and got["f1"].rise_rank == 1 and got["f2"].rise_rank is None
    assert got["f1"].share_pct == pytest.approx(5 / 16 * 100)
    assert got["pm25_lag_24h"].display != "pm25_lag_24h"


def reference_forecast(p, fitted, rows):
    """Plain hour-by-hour loop with pandas windows."""
    series = p["PM25"].to_numpy(float).copy()
    seen = np.flatnonzero(~np.isnan(series))
    out = []
    for i in range(seen[-1] + 1, len(series)):
        x = rows[FEATURES].iloc[i].astype(float).copy()
        past = pd.Series(series[:i])
        for k in (1, 2, 3, 6, 12, 24, 48, 72):
            x[f"pm25_lag_{k}h"] = series[i - k] if i >= k else np.nan
        for n in (3, 6, 12, 24, 48, 168):
            window = past.tail(n)
            x[f"pm25_roll_mean_{n}h"], x[f"pm25_roll_std_{n}h"] = window.mean(), window.std()
            x[f"pm25_roll_max_{n}h"] = window.max()
        x["pm25_delta_1h"] = series[i - 1] - series[i - 2]
        x["pm25_delta_24h"] = series[i - 1] - series[i - 25] if i >= 25 else 0
        series[i] = fitted.ensemble.predict(x.fillna(0).to_numpy(float)[None, :])[0]
        out.append(series[i])
    return out


def test_recursive_forecast(panel, fitted, monkeypatch):
    window = forecast.forecast_window(panel, "2024-01-16 19:00:00")
    inputs = forecast.recursive_inputs(window, target_encoding(panel, "2024-01-14 00:00:00")).cache()
    got = forecast.forecast_recursive(inputs, fitted).toPandas()
    assert set(got["Province"]) == {"A", "B", "C"}  # no rows without any reading
    rows = inputs.toPandas().sort_values(["Province", "Datetime"])
    for name, part in got.groupby("Province"):
        own = rows[rows["Province"] == name].reset_index(drop=True)
        expected = reference_forecast(own, fitted, own)
        np.testing.assert_allclose(part.sort_values("Datetime")["Predicted_PM25"], expected, rtol=1e-9)
    # the first hour equals batch scoring of the same feature row
    first = got.sort_values("Datetime").groupby("Province").first().reset_index()
    batch = model.score(inputs.na.fill(0.0, FEATURES), fitted, clip=False).select("Province", "Datetime", "predicted")
    both = first.merge(batch.toPandas(), on=["Province", "Datetime"])
    np.testing.assert_allclose(both["Predicted_PM25"], both["predicted"], rtol=1e-9)
    snapshot = forecast.horizon_snapshot(forecast.forecast_recursive(inputs, fitted), "x").toPandas().set_index("Province")
    assert snapshot.loc["A", "pred_1h"] == pytest.approx(first.set_index("Province").loc["A", "Predicted_PM25"])


def test_stations_are_regrouped_whole(monkeypatch):
    monkeypatch.setattr(forecast, "CHUNK", 2)
    rows = pd.DataFrame({"Province": sorted("abcdefg" * 5), "v": range(35)})
    chunks = list(forecast._whole_stations(iter([rows[i : i + 4] for i in range(0, 35, 4)])))
    assert pd.concat(chunks)["v"].tolist() == list(range(35))
    names = [n for c in chunks for n in c["Province"].unique()]
    assert len(names) == len(set(names)) == 7


def test_linear_forecast(spark, hours):
    h = hours(4)
    rows = [("a", h[0], 10.0, 0.0), ("a", h[1], None, 20.0), ("a", h[2], None, 40.0), ("b", h[0], None, 1.0)]
    df = spark.createDataFrame(rows, "Province string, Datetime timestamp_ntz, PM25 double, t double")
    got = forecast.forecast_linear(df, 0.8, 0.05, "t").orderBy("Datetime").collect()
    assert [r.Predicted_PM25 for r in got] == pytest.approx([9.0, 9.2])
    assert {r.Province for r in got} == {"a"}


def test_learning_curve_and_importance(complete, fitted):
    curve = model.learning_curve(fitted, complete, complete).orderBy("round").collect()
    assert len(curve) == 4 and sum(r.is_best for r in curve) == 1
    assert curve[-1].train_mae < curve[0].train_mae
    top = model.feature_importance(fitted).collect()
    assert len(top) == 20 and sum(r.importance for r in top) == pytest.approx(1.0, abs=0.05)
    assert {r.kind for r in top} <= {"history", "fire", "other"}


def test_best_round_has_patience():
    assert model.best_round([5, 4, 3, 3.5, 2], patience=50) == 4
    assert model.best_round([5, 4, 3, 3.5, 3.6, 2], patience=2) == 2


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = model.fit_scaler(df, ["a", "b"])
    assert {(r.feature, r["mean"], r.scale) for r in scaler.collect()} == {("a", 2.0, 1.0), ("b", 5.0, 1.0)}
    assert [tuple(r) for r in model.apply_scaler(df, scaler, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_mean_contributions_per_feature(spark):
    rows = spark.createDataFrame([([1.0, -2.0],), ([-3.0, 0.0],)], "contributions array<double>")
    got = {r.feature: (r.mean_abs, r["mean"], r.n) for r in explain.mean_absolute(rows, ["a", "b"]).collect()}
    assert got == {"a": (2.0, -1.0, 2), "b": (1.0, -1.0, 2)}
    assert explain.mean_absolute(rows.where("false"), ["a", "b"]).isEmpty()


def test_trees_read_only_the_columns_they_cut(spark):
    from hazelake.catalog.q_models import FIXED_FEATURES, fixed_trees

    fitted, rng = fixed_trees(), np.random.default_rng(4)
    slim, used = fitted.ensemble.over_used(fitted.features)
    assert sorted(FEATURES[i] for i in used) == sorted(FIXED_FEATURES)
    x = rng.uniform(0, 80, (200, len(FEATURES)))
    assert np.array_equal(slim.predict(x[:, used]), fitted.ensemble.predict(x))
    whole, expected = leaf_games(fitted.ensemble)
    part, same = leaf_games(slim)
    assert same == expected and np.array_equal(attribute(part, x[:, used]), attribute(whole, x)[:, used])

    rows = spark.createDataFrame([[float(v) for v in r] for r in x[:5]], FEATURES)
    explained = explain.with_contributions(rows, fitted)
    found = np.array([r["contributions"] for r in explained.collect()])
    assert np.array_equal(found, attribute(whole, x[:5]))
    long = explain.to_long(explained, FEATURES, [], only=FIXED_FEATURES)
    assert long.count() == 15


def test_trees_without_a_cut_still_score(spark):
    nodes = pd.DataFrame([(0, 0, -1, 0.0, -1, -1, 7.0, 10.0)], columns=["tree", "id", "feature", "threshold", "left", "right", "value", "cover"])
    fitted = model.Fitted(None, Ensemble.from_nodes(nodes, [1.0]), rounds=1)
    rows = spark.createDataFrame([[float(i) for i in range(len(FEATURES))]], FEATURES)
    assert model.score(rows, fitted).first()["predicted"] == 7.0
    assert explain.with_contributions(rows, fitted).first()["contributions"] == [0.0] * len(FEATURES)


def test_a_forecast_is_sent_only_the_columns_that_trees_cut_and_steps_do_not_redo(panel):
    from hazelake.catalog.q_models import fixed_trees

    window = forecast.forecast_window(panel, "2024-01-16 19:00:00")
    inputs = forecast.recursive_inputs(window, target_encoding(panel, "2024-01-14 00:00:00"))
    plan = forecast.forecast_recursive(inputs, fixed_trees())._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "MapInPandas run(" in line).split("MapInPandas run(")[1].split(")")[0]
    assert [c.split("#")[0] for c in sent.split(", ")] == ["Province", "Datetime", "PM25", "temperature_2m"]
    assert "pm25_roll" not in plan and "hotspot_roll" not in plan


def test_a_batch_is_dealt_out_by_day_once(spark, panel):
    from hazelake.plans.batch import batch_frame

    history = panel.select("Province", "Datetime", "PM25", *WEATHER_COLUMNS)
    daily = panel.groupBy(F.to_date("Datetime").alias("date"), "Province").agg(*[F.max(c).alias(c) for c in FIRE_COLUMNS])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = batch_frame(history, history.drop("PM25"), daily, "2024-01-16 19:00:00")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(Datetime" not in plan
        assert plan.count("hashpartitioning(date") >= 1
        assert frame.count() == frame.select("Province", "Datetime").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
