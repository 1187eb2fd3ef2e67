"""Modelling, forecasting and attribution queries.

A model is fitted once per session and data folder, with the published settings of at most 1,000 rounds, until the
error of the validation part has not fallen for 50 rounds, and shared by the queries that read it. They use the
rounds up to the best one.
"""

import pandas as pd
from pyspark.sql import functions as F

from hazelake.catalog.q_features import training_features
from hazelake.catalog.q_tables import BATCH_COLUMNS, LINEAR, batch_serving, batch_tables
from hazelake.catalog.register import query
from hazelake.catalog.tables import NOW, TRAIN_END, VALIDATION_END
from hazelake.constants import FEATURES
from hazelake.functions.trees import Ensemble
from hazelake.operators import splits, stats
from hazelake.operators.series import keep_first
from hazelake.plans import alerts, boosting, explain, forecast, model
from hazelake.plans.features import target_encoding
from hazelake.session import fresh_path

#: the variant with penalties, least gain, columns per level and early stopping
SETTINGS = model.FULL
_STORE: dict[tuple[str, str], tuple] = {}


def prepared(t):
    """(split feature rows, fitted model) of this folder; the model is fitted to all training rows."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORE:
        rows = splits.complete_cases(training_features(t), [*FEATURES, "PM25"])
        path = fresh_path(t.spark, "features")
        splits.time_split(rows, "Datetime", TRAIN_END, VALIDATION_END).write.parquet(path)
        table = t.spark.read.parquet(path)
        _STORE[key] = (table, model.fit_boosted(table.where("split = 'train'"), table.where("split = 'validation'"), settings=SETTINGS))
    return _STORE[key]


@query("train_predict")
def train_predict(t):
    rows, fitted = prepared(t)
    scored = model.score(rows, fitted)
    return scored.select("Province", "Datetime", "split", "PM25", "predicted")


@query("model_metrics")
def model_metrics(t):
    return stats.regression_metrics(train_predict(t), "PM25", "predicted", ["split"])


@query("prediction_table")
def prediction_table(t):
    test = train_predict(t).where("split = 'test'")
    return test.select("Datetime", "Province", "PM25", "predicted", (F.col("predicted") - F.col("PM25")).alias("residual"))


@query("learning_curve")
def learning_curve(t):
    rows, fitted = prepared(t)
    return model.learning_curve(fitted, rows.where("split = 'train'"), rows.where("split = 'validation'"))


@query("feature_importance")
def feature_importance(t):
    return model.feature_importance(prepared(t)[1])


def _stepped(t, fitted):
    inputs = forecast.recursive_inputs(t.batch(), target_encoding(t.weather, TRAIN_END, readings=t.pm25), spacing="hourly")
    return forecast.forecast_recursive(inputs, fitted)


@query("forecast_recursive")
def forecast_recursive(t):
    """Hours after the last reading, from what the daily batch knows: forecast weather, recent means of fires."""
    _, fitted = prepared(t)
    return _stepped(t, fitted)


@query("forecast_snapshot")
def forecast_snapshot(t):
    return forecast.horizon_snapshot(forecast_recursive(t), "2024-01-24 07:00")


def _attributed(t):
    rows, fitted = prepared(t)
    test = rows.where("split = 'test'")
    return explain.with_contributions(test, fitted), fitted


@query("attribution")
def attribution(t):
    rows, fitted = _attributed(t)
    return explain.to_long(rows, fitted.features, ["Province", "Datetime"])


@query("attribution_summary")
def attribution_summary(t):
    rows, fitted = _attributed(t)
    return explain.mean_absolute(rows, fitted.features).orderBy(F.desc("mean_abs"))


@query("attribution_top_factors")
def attribution_top_factors(t):
    """Strongest factors of each station's latest complete hour."""
    rows, fitted = prepared(t)
    latest = keep_first(rows, "Province", [F.desc("Datetime")])
    long = explain.to_long(explain.with_contributions(latest, fitted), fitted.features, ["Province", "Datetime"])
    return explain.top_factors(long, ["Province", "Datetime"])


@query("attribution_worst_row")
def attribution_worst_row(t):
    """Strongest factors of the hour with the highest reading of the test part."""
    rows, fitted = prepared(t)
    worst = rows.where("split = 'test'").orderBy(F.desc("PM25"), "Province", "Datetime").limit(1)
    long = explain.to_long(explain.with_contributions(worst, fitted), fitted.features, ["Province", "Datetime"])
    return explain.top_factors(long, ["Province", "Datetime"])


# ------------------------------------------------------------------ the same code on fixed trees
# Two small trees whose scores, Shapley values and recursion can be written down in SQL.
#   tree 1: pm25_lag_1h <= 40 ? (temperature_2m <= 20 ? 15 : 25) : 55     covers 30, 20, 50
#   tree 2: pm25_roll_mean_3h <= 45 ? -20 : 30, weight 0.1                covers 60, 40
FIXED_FEATURES = ["pm25_lag_1h", "temperature_2m", "pm25_roll_mean_3h"]


def fixed_trees() -> model.Fitted:
    lag, temperature, mean = (FEATURES.index(f) for f in FIXED_FEATURES)
    nodes = pd.DataFrame(
        [
            (0, 0, lag, 40.0, 1, 2, 0.0, 100.0),
            (0, 1, temperature, 20.0, 3, 4, 0.0, 50.0),
            (0, 2, -1, 0.0, -1, -1, 55.0, 50.0),
            (0, 3, -1, 0.0, -1, -1, 15.0, 30.0),
            (0, 4, -1, 0.0, -1, -1, 25.0, 20.0),
            (1, 0, mean, 45.0, 1, 2, 0.0, 100.0),
            (1, 1, -1, 0.0, -1, -1, -20.0, 60.0),
            (1, 2, -1, 0.0, -1, -1, 30.0, 40.0),
        ],
        columns=["tree", "id", "feature", "threshold", "left", "right", "value", "cover"],
    )
    return model.Fitted(None, Ensemble.from_nodes(nodes, [1.0, 0.1]))


def _known_rows(t):
    return splits.complete_cases(training_features(t), FIXED_FEATURES)


FIXED_ROWS = """SELECT * FROM (SELECT Province, Datetime, temperature_2m,
  lag(PM25, 1) OVER (PARTITION BY Province ORDER BY Datetime) AS pm25_lag_1h,
  avg(PM25) OVER (PARTITION BY Province ORDER BY Datetime ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm25_roll_mean_3h
  FROM observed) AS w WHERE pm25_lag_1h IS NOT NULL AND pm25_roll_mean_3h IS NOT NULL"""


def _fixed_score(lag, temperature, mean):
    return (
        f"CASE WHEN {lag} <= 40 THEN CASE WHEN {temperature} <= 20 THEN 15e0 ELSE 25e0 END ELSE 55e0 END"
        f" + 0.1e0 * CASE WHEN {mean} <= 45 THEN -20e0 ELSE 30e0 END"
    )


@query(
    "score_fixed_trees",
    "Province Datetime predicted~",
    f"SELECT Province, Datetime, {_fixed_score(*FIXED_FEATURES)} AS predicted FROM fixed_rows",
    fixed_rows=FIXED_ROWS,
)
def score_fixed_trees(t):
    return model.score(_known_rows(t), fixed_trees(), trees=2)


@query(
    "attribution_fixed_trees",
    "Province Datetime feature value~ contribution~ base~",
    """SELECT Province, Datetime, 'pm25_lag_1h' AS feature, pm25_lag_1h AS value,
        ((va - 37) + (vab - vb)) / 2 AS contribution, 37e0 AS base FROM games
      UNION ALL SELECT Province, Datetime, 'temperature_2m', temperature_2m, ((vb - 37) + (vab - va)) / 2, 37e0 FROM games
      UNION ALL SELECT Province, Datetime, 'pm25_roll_mean_3h', pm25_roll_mean_3h,
        0.1e0 * CASE WHEN pm25_roll_mean_3h <= 45 THEN -20e0 ELSE 30e0 END, 37e0 FROM games""",
    fixed_rows=FIXED_ROWS,
    games="""SELECT *, CASE WHEN pm25_lag_1h <= 40 THEN 19e0 ELSE 55e0 END AS va,
      0.5e0 * CASE WHEN temperature_2m <= 20 THEN 15e0 ELSE 25e0 END + 27.5e0 AS vb,
      CASE WHEN pm25_lag_1h <= 40 THEN CASE WHEN temperature_2m <= 20 THEN 15e0 ELSE 25e0 END ELSE 55e0 END AS vab
      FROM fixed_rows""",
)
def attribution_fixed_trees(t):
    fitted = fixed_trees()
    rows = explain.with_contributions(_known_rows(t), fitted)
    return explain.to_long(rows, fitted.features, ["Province", "Datetime"], only=FIXED_FEATURES)


# ------------------------------------------------------------------ one boosted tree on bins that are written down
BINNED = {"pm25_lag_1h": [15.0, 25.0, 35.0, 50.0, 70.0, 100.0], "temperature_2m": [18.0, 21.0, 25.0, 30.0, 33.0], "pm25_roll_mean_3h": [20.0, 30.0, 45.0, 60.0, 90.0]}
ONE_TREE = boosting.Settings(
    rounds=1, depth=2, step=0.1, row_share=1.0, tree_columns=1.0, level_columns=1.0, min_rows=5, l1=25.0, l2=10.0, min_gain=50.0, chunk=1
)


def _gain(g, n):
    return f"pow(greatest(abs({g}) - {ONE_TREE.l1!r}, 0e0), 2) / ({n} + {ONE_TREE.l2!r})"


def _cuts(source):
    """The best cut of each part of ``source`` (path, feature, value, g): of equal gains the first feature and bin."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, place, edge) AS rn FROM (
      SELECT *, {_gain('gl', 'nl')} + {_gain('(gall - gl)', '(nall - nl)')} - {_gain('gall', 'nall')} AS gain FROM (
      SELECT path, feature, e.place, e.edge, sum(CASE WHEN value <= e.edge THEN g ELSE 0 END) AS gl, count(*) FILTER (value <= e.edge) AS nl,
        sum(g) AS gall, count(*) AS nall FROM {source} s JOIN bin_edges e USING (feature) GROUP BY path, feature, e.place, e.edge) AS a
      WHERE nl >= {ONE_TREE.min_rows} AND nall - nl >= {ONE_TREE.min_rows}) AS b WHERE gain > 1e-6) AS c WHERE rn = 1"""


@query(
    "boosted_tree_fixed_bins",
    "path feature edge~ n_rows# value~ gain_per_row~",
    f"""SELECT n.path, c.feature, c.edge, n.n_rows, -sign(n.g) * greatest(abs(n.g) - {ONE_TREE.l1!r}, 0e0) / (n.n_rows + {ONE_TREE.l2!r}) AS value,
      coalesce(c.gain, 0e0) / n.n_rows AS gain_per_row FROM tree_nodes n LEFT JOIN kept_cuts c ON c.path = n.path""",
    fixed_rows=FIXED_ROWS,
    bin_edges="SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, {e!r}e0)" for i, (f, edges) in enumerate(BINNED.items()) for e in edges) + ") AS v(feature, place, edge)",
    labelled="""SELECT row_number() OVER () AS rid, f.*, o.PM25 AS y FROM fixed_rows f JOIN observed o ON o.Province = f.Province AND o.Datetime = f.Datetime
      WHERE o.PM25 IS NOT NULL AND f.Datetime <= TIMESTAMP '""" + TRAIN_END + "'",
    at_root="""SELECT '' AS path, rid, feature, value, (SELECT avg(y) FROM labelled) - y AS g FROM (SELECT rid, y, unnest(['pm25_lag_1h', 'temperature_2m', 'pm25_roll_mean_3h']) AS feature,
      unnest([pm25_lag_1h, temperature_2m, pm25_roll_mean_3h]) AS value FROM labelled)""",
    root_cut=_cuts("at_root"),
    at_sides="""SELECT CASE WHEN x.value <= r.edge THEN 'L' ELSE 'R' END AS path, a.rid, a.feature, a.value, a.g FROM root_cut r
      JOIN at_root x ON x.feature = r.feature JOIN at_root a ON a.rid = x.rid""",
    side_cuts=_cuts("at_sides"),
    good_sides=f"SELECT * FROM side_cuts WHERE gain >= {ONE_TREE.min_gain!r}",
    kept_cuts=f"SELECT * FROM good_sides UNION ALL SELECT * FROM root_cut WHERE gain >= {ONE_TREE.min_gain!r} OR (SELECT count(*) FROM good_sides) > 0",
    at_leaves="""SELECT c.path || CASE WHEN x.value <= c.edge THEN 'L' ELSE 'R' END AS path, x.rid, x.g FROM good_sides c JOIN at_sides x ON x.path = c.path AND x.feature = c.feature""",
    tree_nodes="""SELECT path, sum(g) AS g, count(*) AS n_rows FROM (SELECT path, rid, g FROM at_root WHERE feature = 'pm25_lag_1h'
      UNION ALL SELECT path, rid, g FROM at_sides WHERE feature = 'pm25_lag_1h' AND (SELECT count(*) FROM kept_cuts WHERE path = '') > 0
      UNION ALL SELECT path, rid, g FROM at_leaves) GROUP BY path""",
)
def boosted_tree_fixed_bins(t):
    """The first tree of a boosted model over three features: its cuts, gains and leaf values."""
    rows = splits.complete_cases(training_features(t).where(F.col("Datetime") <= splits.ntz(TRAIN_END)), [*FIXED_FEATURES, "PM25"])
    rows = rows.select(*FIXED_FEATURES, "PM25")
    names = list(BINNED)
    tree = boosting.fit(rows, rows.where("false"), "PM25", names, ONE_TREE, edges=list(BINNED.values())).state.trees[0]
    paths, out = {0: ""}, []
    for i, n in enumerate(tree):
        inner = n["left"] >= 0
        if inner:
            paths |= {n["left"]: paths[i] + "L", n["right"]: paths[i] + "R"}
        value = boosting.leaf_value(n, {"l1": ONE_TREE.l1, "l2": ONE_TREE.l2})
        cut = (names[n["feature"]], BINNED[names[n["feature"]]][n["bin"]]) if inner else (None, None)
        out.append((paths[i], *cut, n["rows"], value, n["gain"] / n["rows"] if inner else 0.0))
    return t.spark.createDataFrame(out, "path string, feature string, edge double, n_rows long, value double, gain_per_row double")


TREE_STEPS = dict(
    tree_start="""SELECT r.Province, r.Datetime, r.PM25 AS p1, r.p2, r.p3 FROM (SELECT *,
      lag(PM25, 1) OVER (PARTITION BY Province ORDER BY Datetime) AS p2,
      lag(PM25, 2) OVER (PARTITION BY Province ORDER BY Datetime) AS p3 FROM recent) AS r
      JOIN (SELECT DISTINCT Province, last_ts FROM ahead) l ON l.Province = r.Province AND l.last_ts = r.Datetime""",
    tree_steps=f"""SELECT Province, CAST(0 AS BIGINT) AS n, Datetime, p1, p2, p3 FROM tree_start UNION ALL
      SELECT a.Province, a.n, a.Datetime, {_fixed_score('s.p1', 'a.temperature_2m', '((s.p1 + coalesce(s.p2, 0) + coalesce(s.p3, 0)) / (1e0 + (s.p2 IS NOT NULL)::INT + (s.p3 IS NOT NULL)::INT))')},
        s.p1, s.p2 FROM tree_steps s JOIN ahead a ON a.Province = s.Province AND a.n = s.n + 1""",
)


@query(
    "forecast_fixed_trees",
    "Province Datetime Predicted_PM25~",
    "SELECT Province, Datetime, p1 AS Predicted_PM25 FROM tree_steps WHERE n > 0",
    **{k: LINEAR[k] for k in ("recent", "ahead")},
    **TREE_STEPS,
)
def forecast_fixed_trees(t):
    window = forecast.forecast_window(t.upto_now, NOW)
    inputs = forecast.recursive_inputs(window, target_encoding(t.weather, TRAIN_END, readings=t.pm25), spacing="hourly")
    return forecast.forecast_recursive(inputs, fixed_trees())


@query(
    "daily_batch_fixed_trees",
    BATCH_COLUMNS,
    batch_serving("(SELECT Province, Datetime, p1 AS Predicted_PM25 FROM tree_steps WHERE n > 0)"),
    **{k: v for k, v in batch_tables(NOW).items() if k != "steps"},
    **TREE_STEPS,
)
def daily_batch_fixed_trees(t):
    """The daily batch from sources to the serving frame, with a tree model."""
    return alerts.serving_frame(t.batch(), _stepped(t, fixed_trees()), NOW)
