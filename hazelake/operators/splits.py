"""Row selection by time, by completeness, by order, by reproducible chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazelake.operators.series import running_total


def ntz(value) -> Column:
    """A moment given by the caller, as ISO text or datetime."""
    return F.lit(value).cast("timestamp_ntz")


def since(df: DataFrame, ts: str, now, days: int) -> DataFrame:
    """Rows from ``now - days`` on; ``now`` comes from the caller, never from a clock."""
    return df.where(F.col(ts) >= ntz(now) - F.expr(f"INTERVAL '{int(days)}' DAY"))


def since_latest(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows dated at most ``days`` before the latest date in the data, that day included.

    The latest date is a scalar subquery, so no join is planned for it.
    """
    latest = df.select(F.max(date)).scalar()
    return df.where(F.col(date) >= F.date_sub(latest, days))


def time_split(df: DataFrame, ts: str, train_end, validation_end, name: str = "split") -> DataFrame:
    moment = F.col(ts)
    return df.withColumn(
        name,
        F.when(moment <= ntz(train_end), F.lit("train"))
        .when(moment <= ntz(validation_end), F.lit("validation"))
        .when(moment.isNotNull(), F.lit("test")),
    )


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def ordered_split(df: DataFrame, ts: str, tiebreak: str, test_share: float = 0.2, name: str = "split") -> DataFrame:
    """Last ``ceil(test_share * n)`` rows in (ts, tiebreak) order are the test part.

    No row is ranked against all others. Counts per moment locate the moment the cut falls in and
    counts per tiebreak value inside it the exact row; both are summed up in ranges.
    """
    per_moment = running_total(df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")), ts, "_n", "_upto")
    total = per_moment.select(F.sum("_n")).scalar()
    placed = per_moment.withColumns({"_before": F.col("_upto") - F.col("_n"), "_train": total - F.ceil(total * test_share)})
    cut = placed.where("_before <= _train AND _before + _n > _train").select(
        F.col(ts).alias("_cut_ts"), (F.col("_train") - F.col("_before")).alias("_left")
    )
    cut_ts, left = cut.select("_cut_ts").scalar(), cut.select("_left").scalar()
    inside = df.where(F.col(ts) == cut_ts).groupBy(tiebreak).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(inside, tiebreak, "_n", "_upto")
    first_test = upto.where(F.col("_upto") > left).select(F.min(tiebreak)).scalar()
    is_train = (F.col(ts) < cut_ts) | ((F.col(ts) == cut_ts) & (F.col(tiebreak) < first_test))
    return df.withColumn(name, F.when(is_train, F.lit("train")).otherwise(F.lit("test")))


def seeded_sample(df: DataFrame, key, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of their key: the same rows on any cluster and layout."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    return df.withColumn("_order", F.md5(text)).orderBy("_order", *key).limit(n).drop("_order")
