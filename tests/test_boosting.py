"""Boosting against a search of every cut written out in numpy."""

from dataclasses import asdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hazelake.plans import boosting
from hazelake.plans.boosting import Settings

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n, seed, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    x[:, 3] = rng.integers(0, 5, n)
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 3] > 2) + noise * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=COLUMNS).assign(y=y)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def soft(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0.0)


def brute_tree(bins, g, s: Settings, rows, level, sets):
    """(feature, bin, left, right) or the leaf's value, by looking at every cut of every column."""

    def score(part):
        return soft(part.sum(), s.l1) ** 2 / (len(part) + s.l2) if len(part) + s.l2 else 0.0

    best = None
    if level < s.depth:
        for f in sets[level]:
            for b in np.unique(bins[rows, f])[:-1]:
                left = bins[rows, f] <= b
                if min(left.sum(), (~left).sum()) < s.min_rows:
                    continue
                gain = score(g[rows][left]) + score(g[rows][~left]) - score(g[rows])
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b, left)
    leaf = -soft(g[rows].sum(), s.l1) / (len(rows) + s.l2)
    if best is None:
        return leaf
    gain, f, b, left = best
    sides = [brute_tree(bins, g, s, rows[part], level + 1, sets) for part in (left, ~left)]
    if gain < s.min_gain and not any(isinstance(x, tuple) for x in sides):
        return leaf
    return f, b, *sides


def brute_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("settings", [
    Settings(rounds=3, depth=3, step=0.5, row_share=1.0, tree_columns=1.0, level_columns=1.0, l1=2.0, l2=3.0, min_gain=4.0, min_rows=7, chunk=2),
    Settings(rounds=3, depth=4, step=0.3, row_share=0.7, tree_columns=0.8, level_columns=0.7, l1=0.0, l2=0.0, min_gain=0.0, min_rows=1, chunk=5),
])
@pytest.mark.parametrize("one_task", [0, boosting.ONE_TASK])
def test_trees_equal_a_search_of_every_cut(spark, settings, one_task):
    pdf, rows = table(spark, 400, 1)
    fitted = boosting.fit(rows, rows.limit(0), "y", COLUMNS, settings, bins=16, one_task=one_task)
    edges = [np.unique(np.quantile(pdf[c], np.arange(1, 16) / 16)) for c in COLUMNS]
    for a, b in zip(fitted.state.edges, edges):
        np.testing.assert_allclose(a, b, atol=1e-12)
    bins = np.column_stack([np.searchsorted(e, pdf[c]) for e, c in zip(edges, COLUMNS)])
    y, guess = pdf["y"].to_numpy(), np.full(len(pdf), pdf["y"].mean())
    if settings.row_share < 1:
        # which rows are drawn depends on how they are numbered
        assert len(fitted.state.trees) == 3 and all(0.5 * 400 < t[0]["rows"] < 0.9 * 400 for t in fitted.state.trees)
        return
    for t in range(settings.rounds):
        tree = brute_tree(bins, guess - y, settings, np.arange(len(y)), 0, boosting.column_sets(settings, 4, t))
        guess = guess + settings.step * np.array([brute_predict(tree, r) for r in bins])
    np.testing.assert_allclose(fitted.ensemble().predict(pdf[COLUMNS].to_numpy()), guess, atol=1e-6)


def test_column_sets_are_nested_samples():
    sets = boosting.column_sets(Settings(), 69, 3)
    assert len(sets) == 6 and all(len(s) == 44 for s in sets) and len(set(np.concatenate(sets))) <= 55
    assert [s.tolist() for s in sets] == [s.tolist() for s in boosting.column_sets(Settings(), 69, 3)] != [s.tolist() for s in boosting.column_sets(Settings(), 69, 4)]


def test_cuts_without_gain_are_taken_back_from_the_leaves_up():
    N = boosting.Node
    tree = [N(0, 9, 0, 0, 5.0, 1, 2), N(0, 5, 1, 0, 0.5, 3, 4), N(0, 4, 1, 1, 3.0, 5, 6), N(0, 2, 2, 0, 0.2, 7, 8), N(0, 3), N(0, 2), N(0, 2), N(0, 1), N(0, 1)]
    out = boosting.pruned(tree, 1.0)
    assert [(n.left, n.right) for n in out] == [(1, 2), (-1, -1), (3, 4), (-1, -1), (-1, -1)]


def test_stops_while_fitting_and_goes_on_after_a_lost_driver(spark, tmp_path):
    settings = Settings(rounds=200, depth=3, step=0.5, row_share=0.9, patience=5, chunk=4, min_gain=0.0)
    _, train = table(spark, 500, 3, noise=2.0)
    pdf, validation = table(spark, 300, 4, noise=2.0)
    whole = boosting.fit(train, validation, "y", COLUMNS, settings, str(tmp_path / "whole"), bins=16)
    assert whole.best + 5 == whole.rounds_fitted < 200
    errors = [v for _, v in whole.state.errors]
    assert whole.best == int(np.argmin(errors)) and len(errors) == whole.rounds_fitted + 1
    x = pdf[COLUMNS].to_numpy()
    by_hand = np.abs(whole.ensemble().predict(x) - pdf["y"]).mean()
    assert errors[whole.best] == pytest.approx(by_hand, abs=1e-6)

    path = str(tmp_path / "broken")
    part = boosting.fit(train, validation, "y", COLUMNS, settings, path, bins=16, stop_after=1)
    assert part.rounds_fitted == 4 and not part.state.finished
    # a driver lost while a chunk was written leaves it without its mark: the chunk before it counts
    spark.createDataFrame([("{",)], "value string").write.text(f"{path}/state-00002")
    import os
    os.remove(f"{path}/state-00002/_SUCCESS")
    again = boosting.fit(train, validation, "y", COLUMNS, settings, path)
    assert again.best == whole.best and again.rounds_fitted == whole.rounds_fitted
    np.testing.assert_array_equal(again.ensemble().predict(x), whole.ensemble().predict(x))
    assert boosting.fit(train, validation, "y", COLUMNS, settings, path).rounds_fitted == whole.rounds_fitted


def test_the_same_trees_whatever_the_partitions_and_the_size(spark, tmp_path):
    settings = Settings(rounds=4, depth=3, row_share=1.0, chunk=3)
    _, rows = table(spark, 300, 6)
    one, two = (boosting.fit(r, rows.limit(0), "y", COLUMNS, settings).state.trees for r in (rows, rows.repartition(7)))
    spread = boosting.fit(rows, rows.limit(0), "y", COLUMNS, settings, one_task=0).state
    assert one == two == spread.trees
    # the same row numbers, so the same samples
    sampled = Settings(rounds=4, depth=3, chunk=3)
    path = str(tmp_path / "a")
    boosting.fit(rows, rows, "y", COLUMNS, sampled, path, stop_after=0)
    import shutil
    shutil.copytree(path, str(tmp_path / "b"))
    a, b = (boosting.fit(rows, rows, "y", COLUMNS, sampled, str(tmp_path / p), one_task=k).state for p, k in (("a", 0), ("b", boosting.ONE_TASK)))
    assert a == b and len(a.trees) == 4


def test_nothing_to_learn_from(spark):
    _, rows = table(spark, 10, 7)
    with pytest.raises(ValueError, match="no training row"):
        boosting.fit(rows.limit(0), rows, "y", COLUMNS)
    flat = boosting.fit(rows.selectExpr("a", "b", "c", "d", "1.5D AS y"), rows, "y", COLUMNS, Settings(rounds=2))
    assert flat.ensemble().predict(np.zeros((2, 4))).tolist() == [1.5, 1.5]


def test_filled_trees_predict_what_descending_gives():
    rng, settings = np.random.default_rng(5), {"l1": 0.1, "l2": 1.0, "step": 0.05}

    def grown():
        tree = [{"left": -1, "right": -1, "feature": -1, "bin": -1, "gradient": rng.normal(), "rows": 9}]
        for i in range(40):
            if i < len(tree) and (i == 0 or rng.random() < 0.7):
                tree[i] |= {"left": len(tree), "right": len(tree) + 1, "feature": int(rng.integers(7)), "bin": int(rng.integers(64))}
                tree += [{"left": -1, "right": -1, "feature": -1, "bin": -1, "gradient": rng.normal(), "rows": 9} for _ in range(2)]
        return tree

    bins, start = rng.integers(0, 64, (500, 7)).astype(np.uint8), rng.normal(size=500)
    trees = [grown() for _ in range(6)] + [[{"left": -1, "right": -1, "feature": -1, "bin": -1, "gradient": 2.0, "rows": 3}]]
    expected = start.copy()
    for tree in trees:
        expected += settings["step"] * np.array([boosting.leaf_value(n, settings) for n in tree])[boosting._descend(bins, tree)]
    assert np.array_equal(boosting._predicted(bins, start, trees, settings), expected)
    assert np.array_equal(boosting._filled(trees[-1], np.array([7.0]))[3], [7.0])


def test_tasks_that_run_together_grow_the_trees_of_level_jobs(spark, tmp_path, monkeypatch):
    settings = Settings(rounds=7, depth=4, step=0.3, row_share=0.8, tree_columns=1.0, level_columns=0.6, min_rows=3, chunk=2)
    _, rows = table(spark, 600, 11)
    boosting.fit(rows, rows, "y", COLUMNS, settings, str(tmp_path / "levels"), stop_after=0)
    import shutil
    for name in ("together", "broken"):
        shutil.copytree(tmp_path / "levels", tmp_path / name)
    levels = boosting.fit(rows, rows, "y", COLUMNS, settings, str(tmp_path / "levels"), one_task=0, held=0).state
    assert len(levels.trees) == 7 and max(len(t) for t in levels.trees) > 15
    together = boosting.fit(rows, rows, "y", COLUMNS, settings, str(tmp_path / "together"), one_task=0).state
    assert (together.trees, together.errors) == (levels.trees, levels.errors)
    # the predictions of five chunks are written once; a fit that broke off goes on from there
    assert sorted(p.name for p in (tmp_path / "together").glob("chunk-*")) == ["chunk-00000", "chunk-00004"]
    with monkeypatch.context() as m:  # a shared folder that tasks cannot open files in
        m.setattr(boosting, "_files_in", lambda spark, path: None)
        part = boosting.fit(rows, rows, "y", COLUMNS, settings, str(tmp_path / "broken"), one_task=0, stop_after=1)
    assert part.rounds_fitted == 2 and not (tmp_path / "broken" / "messages").exists()
    assert boosting.fit(rows, rows, "y", COLUMNS, settings, str(tmp_path / "broken"), one_task=0).state.trees == levels.trees


def test_bins_are_made_from_one_column_sent_to_python(spark):
    names = [f"x{i}" for i in range(30)]
    rows = spark.range(7).selectExpr("CAST(id AS DOUBLE) AS y", "0 AS part", *[f"CAST(id * {i} AS INT) AS x{i}" for i in range(30)])
    made = boosting.binned(rows, names, [[1.0, 4.5]] * 30)
    plan = made._jdf.queryExecution().executedPlan().toString()
    sent = next(line for line in plan.splitlines() if "MapInArrow run(" in line).split("MapInArrow run(")[1].split(")")[0]
    assert sent.count(",") == 2
    got = {int(r.y): list(r.bins) for r in made.collect()}
    assert got == {k: [int(k * i > 1) + int(k * i > 4.5) for i in range(30)] for k in range(7)}


@pytest.mark.parametrize("n", [300, 40_000])
def test_cells_of_two_columns_are_counted_in_one_pass(n, monkeypatch):
    rng = np.random.default_rng(2)
    bins, part = rng.integers(0, 64, (n, 7)).astype(np.uint8), np.zeros(n, np.int32)
    y = rng.normal(size=n)
    state = boosting.State([f"x{i}" for i in range(7)], [], 0.0, 2.0**20, n, asdict(Settings(row_share=1.0)))
    columns = [np.arange(n), [r.tobytes() for r in bins], y, part, np.zeros(n)]
    held = boosting._Rows([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "bins", "y", "part", "start"])], state)
    held.draw(Settings(row_share=1.0), 0, state.scale)
    held.node = rng.integers(0, 5, n)
    passes = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: passes.append(1) or count(*a, **b))
    g, rows = held.sums([1, 4], wanted := np.array([0, 2, 3, 5, 6]), 5)
    assert len(passes) == (8 if n == 40_000 else 10)  # of gradients and of rows: pairs, or columns where rows are few
    for k, c in enumerate(wanted):
        for i, node in enumerate((1, 4)):
            own = held.node == node
            assert np.array_equal(rows[k, i], count(bins[own, c], minlength=64))
            assert np.array_equal(g[k, i], count(bins[own, c], weights=held.gradient[own], minlength=64))
    # rows go where their bins say
    tree = [{"left": 1, "right": 2, "feature": 5, "bin": 20}, {"left": -1, "right": -1, "feature": -1, "bin": -1}, {"left": -1, "right": -1, "feature": -1, "bin": -1}]
    held.node = np.zeros(n, dtype=np.int64)
    held.step_down(tree)
    assert np.array_equal(held.node, np.where(bins[:, 5] <= 20, 1, 2))
    full = [t | {"gradient": float(i), "rows": 9} for i, t in enumerate(tree)]
    held.add(full, state.settings)
    assert np.array_equal(held.guess, boosting._predicted(bins, np.zeros(n), [full], state.settings))
