import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazelake.operators import quantiles, stats
from hazelake.operators.quantiles import column_quantiles, exact_quantiles


def test_quantiles_match_numpy_through_passes(spark):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 10)) for _ in range(5000)] + [("few", float(i)) for i in range(4)]
    rows += [("same", 2.5)] * 3000 + [("one", 7.0), ("none", None), ("nan", float("nan"))]
    rows += [("half", float(i % 2)) for i in range(3001)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = {"lo": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "hi": 0.99, "min": 0.0, "max": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "g", "v", probabilities, radix=8).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    assert set(got) == {"hot", "few", "same", "one", "half"}
    for g, part in frame.groupby("g"):
        for name, p in probabilities.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), abs=1e-12), (g, name)


@pytest.mark.parametrize("values", [
    [0.0] * 50 + [-0.0] * 50, [10.0 ** (i % 300) for i in range(600)], [-(2.0 ** (i - 500)) for i in range(1000)],
    [float("inf"), float("-inf"), 1.0, 2.0, 3.0] * 30, [5e-324 * i for i in range(200)], [1e308, -1e308, 0.5] * 40 + [0.25] * 99,
    [1.0 + i * 2.0 ** -52 for i in range(300)],
])
def test_quantiles_of_odd_distributions(spark, values):
    probabilities = {"min": 0.0, "low": 1 / 3, "q50": 0.5, "high": 0.9, "max": 1.0}
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    with np.errstate(all="ignore"):
        ranks = {n: np.quantile(values, p, method="lower") for n, p in probabilities.items()}
        tops = {n: np.quantile(values, p, method="higher") for n, p in probabilities.items()}
    for few in (True, False):
        got = exact_quantiles(df, "g", "v", probabilities, radix=8, few_groups=few).first()
        for n in probabilities:
            assert ranks[n] <= got[n] <= tops[n]


def test_quantiles_rank_nothing_in_a_window(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "sqrt(id) AS v")
    plan = exact_quantiles(df, "g", "v", {"q": 0.4})._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_correlations_match_pandas_with_gaps_and_constants(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        x = rng.random()
        rows.append((x, 3 * x + rng.random() if rng.random() > 0.2 else None, rng.random() if rng.random() > 0.4 else None, 0.1))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    expected = df.toPandas().corr()
    got = {(r.col_a, r.col_b): r.r for r in stats.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        if "k" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9)
    pairs = {(r.col_a, r.col_b): r.r for r in stats.correlation_pairs(df, [("a", "b"), ("b", "c"), ("a", "k")]).collect()}
    assert pairs[("a", "k")] is None
    assert pairs[("b", "c")] == pytest.approx(expected.loc["b", "c"])


def test_shape_matches_pandas_and_needs_enough_rows(spark):
    values = [1.0, 2.0, 2.5, 9.0, 4.0]
    rows = [("five", v) for v in values] + [("three", v) for v in values[:3]] + [("two", 1.0), ("two", 2.0)]
    got = {r.g: r for r in stats.shape_stats(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    s = pd.Series(values)
    assert got["five"].skewness == pytest.approx(s.skew()) and got["five"].kurtosis == pytest.approx(s.kurt())
    assert got["three"].kurtosis is None and got["three"].skewness == pytest.approx(s[:3].skew())
    assert got["two"].skewness is None


def test_histogram_matches_numpy(spark):
    rng = random.Random(9)
    values = [rng.gauss(5, 2) for _ in range(500)]
    rows = stats.histogram(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r.n for r in rows] == counts.tolist()
    np.testing.assert_allclose([r.lo for r in rows], edges[:-1])
    assert sum(r.density * (r.hi - r.lo) for r in rows) == pytest.approx(1.0)


def test_histogram_of_a_constant_and_of_nothing(spark):
    one = stats.histogram(spark.createDataFrame([(3.0,)] * 5, "v double"), "v", 4).collect()
    assert sum(r.n for r in one) == 5
    assert stats.histogram(spark.createDataFrame([(None,)], "v double"), "v", 4).count() == 0


def test_describe_matches_pandas(spark):
    rng = random.Random(4)
    rows = [(rng.random() if rng.random() > 0.3 else None, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double")
    expected = df.toPandas().describe()
    for r in stats.describe_long(df, ["a", "b"]).collect():
        got = [r.n, r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max]
        np.testing.assert_allclose(got, expected[r["column"]].to_numpy())


def test_describe_writes_no_row_per_value(spark, monkeypatch):
    from hazelake.operators import quantiles

    written, keep = [], quantiles.materialised

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "materialised", counted)
    monkeypatch.setattr(stats, "materialised", counted, raising=False)
    df = spark.createDataFrame([(float(i % 50), None if i % 3 else float(i), None) for i in range(200)], "a double, b double, c double")
    got = {r["column"]: (r.n, r.q25, r.q50, r.q75) for r in stats.describe_long(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (200, 12.0, 24.5, 37.0), "b": (67, 49.5, 99.0, 148.5), "c": (0, None, None, None)}
    assert max(written) == 200


def test_autocorrelation_matches_pandas(spark, hours):
    rng = random.Random(6)
    values = list(np.cumsum([rng.gauss(0, 1) for _ in range(300)]))
    df = spark.createDataFrame(
        [("a", h, float(v)) for h, v in zip(hours(300), values)] + [("flat", h, 1.0) for h in hours(60)],
        "Province string, Datetime timestamp_ntz, PM25 double",
    )
    got = {(r.Province, r.lag_h): r.r for r in stats.autocorrelation(df, "Province", "Datetime", "PM25", [1, 24], block=48).collect()}
    assert got[("a", 1)] == pytest.approx(pd.Series(values).autocorr(1))
    assert got[("a", 24)] == pytest.approx(pd.Series(values).autocorr(24))
    assert got[("flat", 1)] is None


def test_density_integrates_to_almost_one(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([("a", rng.gauss(0, 1)) for _ in range(400)], "k string, v double")
    curve = stats.density_curves(df, "k", "v").orderBy("point").toPandas()
    area = np.trapezoid(curve["density"], curve["grid"])
    assert len(curve) == 100 and 0.9 < area < 1.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0), (5.0, 5.0), (None, 1.0)], "y double, p double")
    r = stats.regression_metrics(df, "y", "p").first()
    assert r.n == 3 and r.mae == pytest.approx(4 / 3) and r.rmse == pytest.approx(np.sqrt(10 / 3))
    assert r.r2 == pytest.approx(1 - 10 / 8) and r.mape == pytest.approx(200 / 3)


def test_value_counts_and_pivot(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "p string, q string")
    got = {(r["column"], r.value): r.n for r in stats.value_counts(df, ["p", "q"]).collect()}
    assert got == {("p", "a"): 2, ("p", "b"): 1, ("q", "x"): 2}
    dated = df.withColumn("Datetime", F.lit("2024-03-05 00:00:00").cast("timestamp_ntz"))
    wide = stats.pivot_months(dated, "p", F.count(F.lit(1))).na.fill(0).orderBy("p").collect()
    assert [r.m03 for r in wide] == [2, 1] and wide[0].m01 == 0


def test_column_quantiles_equal_those_of_rows_per_value(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({
        "spread": rng.normal(size=4000) * 10.0 ** rng.integers(-3, 9, 4000), "few": rng.integers(0, 5, 4000) - 2.0, "same": 2.5,
        "none": np.nan, "holes": np.where(rng.random(4000) < 0.3, np.nan, rng.normal(size=4000)), "zero": np.where(rng.random(4000) < 0.5, 0.0, -0.0),
    })
    df = spark.createDataFrame(pdf).repartition(5)
    probabilities = {f"q{i}": i / 16 for i in range(17)}
    long = stats.to_long(df, list(pdf.columns), name="feature")
    expected = {r["feature"]: {q: r[q] for q in probabilities} for r in exact_quantiles(long, "feature", "value", probabilities).collect()}
    for cells in (64, 1 << 14):
        got = column_quantiles(df, list(pdf.columns), probabilities, cells)
        assert got == expected and "none" not in got
    np.testing.assert_allclose(list(got["spread"].values()), np.quantile(pdf["spread"], list(probabilities.values())), rtol=1e-12)


def test_column_quantiles_end_with_lists_of_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.gamma(2.0, size=3000), "c": np.round(rng.normal(size=3000), 1)})
    passes, counted = [], quantiles._cells_of_columns
    monkeypatch.setattr(quantiles, "_cells_of_columns", lambda *a: passes.append(1) or counted(*a))
    probabilities = {f"q{i}": i / 8 for i in range(9)}
    got = column_quantiles(spark.createDataFrame(pdf).repartition(4), list(pdf.columns), probabilities, 1 << 10, 400)
    assert len(passes) <= 3
    for c in pdf.columns:
        np.testing.assert_allclose(list(got[c].values()), np.quantile(pdf[c], list(probabilities.values())), rtol=1e-12)
