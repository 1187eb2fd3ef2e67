"""Boosted trees as flat arrays, for scoring and attribution inside Python workers.

The arrays hold one entry per node, so their size is set by the model (rounds x 2^depth), never
by the data; that is what makes shipping them to every worker safe.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import factorial

import numpy as np


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees one after the other; ``left < 0`` marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    @staticmethod
    def from_nodes(nodes, weights) -> "Ensemble":
        """``nodes``: frame of tree, id, feature, threshold, left, right, value, cover."""
        nodes = nodes.sort_values(["tree", "id"]).reset_index(drop=True)
        starts = nodes.groupby("tree").size().cumsum().shift(1, fill_value=0).to_numpy()
        offset = starts[nodes["tree"].to_numpy()]
        inner = nodes["left"].to_numpy() >= 0
        left = np.where(inner, nodes["left"].to_numpy() + offset, -1)
        right = np.where(inner, nodes["right"].to_numpy() + offset, -1)
        depth, level = 0, np.asarray(starts)
        while (level := level[left[level] >= 0]).size:
            level = np.concatenate([left[level], right[level]])
            depth += 1
        return Ensemble(
            nodes["feature"].to_numpy().astype(np.int64),
            nodes["threshold"].to_numpy().astype(float),
            left.astype(np.int64),
            right.astype(np.int64),
            nodes["value"].to_numpy().astype(float),
            nodes["cover"].to_numpy().astype(float),
            np.asarray(starts, dtype=np.int64),
            np.asarray(weights, dtype=float),
            depth,
        )

    def first(self, trees: int) -> "Ensemble":
        """The ensemble after the first ``trees`` rounds."""
        return Ensemble(
            self.feature, self.threshold, self.left, self.right, self.value, self.cover,
            self.roots[:trees], self.weights[:trees], self.depth,
        )

    def over_used(self, features: list[str]) -> tuple["Ensemble", list[int]]:
        """The same trees over those columns alone that some cut reads, and the numbers of these columns."""
        nodes, level = [self.roots], self.roots
        while (level := level[self.left[level] >= 0]).size:
            level = np.concatenate([self.left[level], self.right[level]])
            nodes.append(level)
        reached = np.concatenate(nodes)
        used = np.unique(self.feature[reached[self.left[reached] >= 0]])
        if not used.size:
            used = np.arange(min(1, len(features)))  # a struct needs a column
        place = np.full(max(len(features), self.feature.max() + 1), -1, dtype=np.int64)
        place[used] = np.arange(used.size)
        feature = np.where(self.feature >= 0, place[self.feature], -1)
        return replace(self, feature=feature), used.tolist()

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of ``x``; all trees descend one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[node] >= 0
            goes_left = x[rows, np.where(inner, self.feature[node], 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return self.value[node] @ self.weights


@dataclass(frozen=True)
class LeafGame:
    """What one leaf contributes to each of its features, for every way a row can meet its path."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray


def leaf_games(model: Ensemble) -> tuple[list[LeafGame], float]:
    """Path-dependent Shapley values of every leaf, and the expected prediction.

    A leaf reached through conditions on ``d`` distinct features is a product game: with the
    features in S known, its weight is the product of "row meets the condition" over S and of the
    share of training rows meeting it over the rest. Only which of the d conditions a row meets
    matters, so the 2^d possible answers are tabulated once per model.
    """
    games, expected = [], 0.0
    for root, weight in zip(model.roots, model.weights):
        stack = [(int(root), {})]
        while stack:
            node, path = stack.pop()
            if model.left[node] >= 0:
                f, cut = int(model.feature[node]), float(model.threshold[node])
                for child, is_left in ((model.left[node], True), (model.right[node], False)):
                    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                    low, high = (low, min(high, cut)) if is_left else (max(low, cut), high)
                    ratio = model.cover[child] / model.cover[node]
                    stack.append((int(child), {**path, f: (low, high, share * ratio)}))
                continue
            scaled = float(model.value[node] * weight)
            shares = np.array([s for _, _, s in path.values()])
            expected += scaled * float(np.prod(shares))
            if path:
                games.append(
                    LeafGame(
                        np.array(list(path), dtype=np.int64),
                        np.array([lo for lo, _, _ in path.values()]),
                        np.array([hi for _, hi, _ in path.values()]),
                        _pattern_table(shares, scaled),
                    )
                )
    return games, expected


def _pattern_table(shares: np.ndarray, scaled: float) -> np.ndarray:
    """Rows: bit patterns of met conditions. Columns: Shapley value of each feature."""
    d = len(shares)
    met = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    table = np.empty((2**d, d))
    for f in range(d):
        # coefficient k of the polynomial sums the games of all coalitions of size k
        poly = np.zeros((2**d, d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j != f:
                grown = poly * shares[j]
                grown[:, 1:] += poly[:, :-1] * met[:, [j]]
                poly = grown
        table[:, f] = scaled * (met[:, f] - shares[f]) * (poly @ weight)
    return table


def attribute(games: list[LeafGame], x: np.ndarray) -> np.ndarray:
    """Additive contributions, one column per feature of ``x``."""
    out = np.zeros_like(x, dtype=float)
    for game in games:
        values = x[:, game.features]
        pattern = ((values > game.low) & (values <= game.high)) @ (1 << np.arange(len(game.features)))
        out[:, game.features] += game.table[pattern]
    return out
