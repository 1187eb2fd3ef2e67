"""Exploratory statistics, each a partial + final aggregation over the panel."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from hazelake.functions import scalar as S
from hazelake.operators.lookup import lookup
from hazelake.operators.quantiles import column_quantiles, exact_quantiles
from hazelake.operators.series import lags, windowed
from hazelake.session import materialised


def to_long(df: DataFrame, columns, keys=(), name: str = "column", value: str = "value") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(
        *keys, f"_p.{name}", f"_p.{value}"
    )


def profile(df: DataFrame, ts: str, key: str, columns) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.countDistinct(key).alias("n_keys"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def describe_long(df: DataFrame, columns) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column.

    The moments are one wide aggregate turned into rows afterwards. The columns are written once, because the quartiles
    read them several times; no row is made per value.
    """
    df = materialised(df.select(*columns), "columns")
    moments = {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in columns for name, f in moments.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{c}").alias(name) for name in moments]) for c in columns
    ]
    base = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = column_quantiles(df, columns, wanted)
    quartiles = df.sparkSession.createDataFrame(
        [(c, *[float(found[c][q]) for q in wanted]) for c in columns if c in found], "column string, " + ", ".join(f"{q} double" for q in wanted)
    )
    return base.join(quartiles, "column", "left").select(
        "column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def shape_stats(df: DataFrame, column: str, by=()) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; Spark's own are the population moments."""
    moments = df.groupBy(*by).agg(
        F.count(column).cast("double").alias("_n"),
        F.skewness(column).alias("_g1"),
        F.kurtosis(column).alias("_g2"),
    )
    n, g1, g2 = F.col("_n"), F.col("_g1"), F.col("_g2")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    kurt = F.when(n > 3, scale * ((n + 1) * g2 + 6))
    return moments.select(
        *by, n.cast("long").alias("n"), skew.alias("skewness"), kurt.alias("kurtosis")
    )


def mean_by(df: DataFrame, column: str, **parts: Column) -> DataFrame:
    return df.groupBy(*[part.alias(name) for name, part in parts.items()]).agg(
        F.avg(column).alias("mean")
    )


def mean_std_by(df: DataFrame, column: str, **parts: Column) -> DataFrame:
    return df.groupBy(*[part.alias(name) for name, part in parts.items()]).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )


def pivot_months(df: DataFrame, key: str, aggregate: Column, ts: str = "Datetime", months=range(1, 13)) -> DataFrame:
    """One column per month; the months are listed, so no extra job looks for them."""
    months = list(months)
    wide = df.withColumn("_month", F.month(ts)).groupBy(key).pivot("_month", months).agg(aggregate)
    return wide.select(key, *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def value_counts(df: DataFrame, columns) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("_p")).select("_p.column", "_p.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def mean_median_by(df: DataFrame, by: str, columns) -> DataFrame:
    """Mean and exact median of several columns per group, in long form."""
    long = to_long(df.where(F.col(by).isNotNull()), columns, keys=[by])
    means = long.groupBy(by, "column").agg(F.avg("value").alias("mean"))
    return means.join(exact_quantiles(long, [by, "column"], "value", {"median": 0.5}), [by, "column"], "left")


def correlation_pairs(df: DataFrame, pairs, by=()) -> DataFrame:
    """Pairwise-complete Pearson r of many pairs in one pass, as (col_a, col_b, r)."""
    named = {f"_r{i}": S.safe_corr(a, b) for i, (a, b) in enumerate(pairs)}
    wide = df.groupBy(*by).agg(*[r.alias(name) for name, r in named.items()])
    rows = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("_p")).select(*by, "_p.*")


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Upper triangle with the diagonal, over the rows where both columns are present.

    Rows are grouped by which columns they have, usually one or two patterns. Per pattern one plain
    sum per pair of columns is enough; a pair then adds up the patterns that have both. Values
    are measured from the column minimum, so that a constant column has exactly no variance.
    """
    columns = list(columns)
    least = df.agg(*[F.min(c).alias(c) for c in columns])
    shifted = df.select(
        F.array(*[F.col(c).isNotNull() for c in columns]).alias("_has"),
        *[F.coalesce(F.col(c) - least.select(c).scalar(), F.lit(0.0)).alias(c) for c in columns],
    )
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    sums = shifted.groupBy("_has").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_p{i}_{j}") for i, j in pairs],
    )
    entries = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_s{i}").alias("si"), F.col(f"_s{j}").alias("sj"),
            F.col(f"_p{i}_{i}").alias("ii"), F.col(f"_p{j}_{j}").alias("jj"), F.col(f"_p{i}_{j}").alias("ij"),
        )
        for i, j in pairs
    ]
    long = sums.select("_has", "_n", F.explode(F.array(*entries)).alias("_e")).where("_has[_e.i] AND _has[_e.j]")
    merged = long.groupBy("_e.i", "_e.j").agg(
        F.sum("_n").alias("n"), *[F.sum(f"_e.{c}").alias(c) for c in ("si", "sj", "ii", "jj", "ij")]
    )
    names = F.array(*[F.lit(c) for c in columns])
    r = F.expr("try_divide(ij - si * sj / n, sqrt((ii - si * si / n) * (jj - sj * sj / n)))")
    return merged.select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), r.alias("r"))


def autocorrelation(df: DataFrame, key: str, ts: str, column: str, offsets, **blocking) -> DataFrame:
    """Correlation of a series with itself ``k`` rows earlier, per key, as (key, lag_h, r)."""
    offsets = list(offsets)
    lagged = windowed(
        df.select(key, ts, column), key, ts,
        build=lambda w: lags(w, column, offsets, "_lag_{}"), back=max(offsets), **blocking,
    )
    wide = lagged.groupBy(key).agg(*[S.safe_corr(column, f"_lag_{k}").alias(f"_r{k}") for k in offsets])
    rows = [F.struct(F.lit(k).alias("lag_h"), F.col(f"_r{k}").alias("r")) for k in offsets]
    return wide.select(key, F.explode(F.array(*rows)).alias("_p")).select(key, "_p.*")


def histogram(df: DataFrame, column, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; all bins are listed."""
    data = df.select(S.col(column).alias("_x")).where("_x IS NOT NULL")
    span = data.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("_x").alias("_n"))
    lo, hi, total = (span.select(c).scalar() for c in ("_lo", "_hi", "_n"))
    width = (hi - lo) / F.lit(float(bins))
    index = F.least(F.floor(F.try_divide(F.col("_x") - lo, width)), F.lit(bins - 1))
    counts = data.groupBy(F.coalesce(index, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    listed = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    n = F.coalesce("_c", F.lit(0))
    return listed.where(total > 0).select(
        F.col("bin").cast("int").alias("bin"),
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        n.alias("n"),
        F.try_divide(n, total * width).alias("density"),
    )


def linear_trend(y, x) -> list[Column]:
    """Aggregates of a least-squares line: slope, intercept, r, n."""
    y, x = S.col(y), S.col(x)
    return [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        S.safe_corr(x, y).alias("r"),
        F.regr_count(y, x).alias("n"),
    ]


def density_curves(df: DataFrame, key: str, column: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density per key on an even grid between its extremes, with the median.

    Each reading adds to one sum per grid point where it is read, so no reading is copied per point,
    and what is shuffled is one row of sums per key and task.
    """
    data = df.where(F.col(column).isNotNull()).select(key, column)
    scale = data.groupBy(key).agg(
        F.count(column).cast("double").alias("_n"),
        F.min(column).alias("_lo"),
        F.max(column).alias("_hi"),
        F.stddev_samp(column).alias("_sd"),
    )
    scale = scale.where("_sd > 0").select(
        key, "_n", "_lo", "_hi", (F.pow(F.col("_n"), F.lit(-0.2)) * F.col("_sd")).alias("_h")
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    at = F.col("_lo") + F.col("point") * step
    placed = lookup(data, scale, key, "inner").select(
        key, ((F.col("_lo") - F.col(column)) / F.col("_h")).alias("_from"), (step / F.col("_h")).alias("_by")
    )
    gaps = [F.col("_from") + F.lit(float(i)) * F.col("_by") for i in range(points)]
    wide = placed.groupBy(key).agg(*[F.sum(F.exp(g * g * F.lit(-0.5))).alias(f"_k{i}") for i, g in enumerate(gaps)])
    sums = wide.select(key, F.posexplode(F.array(*[f"_k{i}" for i in range(points)])).alias("point", "_k"))
    medians = exact_quantiles(data, key, column, {"median": 0.5})
    curve = sums.join(scale, key).join(medians, key)
    norm = F.col("_n") * F.col("_h") * F.sqrt(F.lit(S.TWO_PI))
    return curve.select(key, "point", at.alias("grid"), (F.col("_k") / norm).alias("density"), "median")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by=(), clip: bool = True) -> DataFrame:
    """MAE, RMSE, R2 and MAPE in one pass; rows missing either side are left out."""
    guess = S.clip_at_zero(predicted) if clip else F.col(predicted)
    pairs = df.select(*by, F.col(actual).alias("_y"), guess.alias("_p")).where(
        "_y IS NOT NULL AND _p IS NOT NULL"
    )
    error = F.col("_y") - F.col("_p")
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"),
        F.var_pop("_y").alias("_var"),
        (F.avg(F.abs(error / (F.col("_y") + 1e-8))) * 100.0).alias("mape"),
    )
    r2 = 1.0 - F.try_divide(F.col("_sse"), F.col("n") * F.col("_var"))
    return sums.select(*by, "n", "mae", "rmse", r2.alias("r2"), "mape")
