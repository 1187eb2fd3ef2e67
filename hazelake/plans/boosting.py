"""Regularised gradient boosting on histograms, with early stopping while it fits.

Values become numbers of bins between exact quantiles. A tree grows level by level: tasks sum gradients and rows by
(node, feature, bin) of what they read, these sums are shuffled and added up by (node, feature), running totals over
the bins give the gain of every cut, and one best cut per node reaches the driver, which holds nothing but trees. With
T the soft threshold by ``l1``, a leaf of gradient sum G over H rows is worth ``-T(G) / (H + l2)`` and a cut gains
``T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2)``. Cuts leave ``min_rows`` on either side; those that
gain less than ``min_gain`` are taken back from the leaves up once the tree is grown. Rows are drawn per tree by a hash
of their number, columns per tree and again per level.

Gradients are summed as integers, so trees do not depend on partitions or on the order of tasks. That also lets a table of
no more than ``ONE_TASK`` bytes of bins skip the jobs per level: one task grows the trees of a whole chunk, the same
trees to the last bit. Larger tables that fit the running tasks, ``HELD`` bytes of bins in each, are held by tasks that run
together (a barrier stage) for some chunks; they tell each other their sums, and of two siblings sum up the smaller one.
Still larger ones get a job per level.

The first job of a round also sums the absolute errors of training and validation rows under the trees so far: fitting
ends as soon as ``patience`` rounds have brought no better validation error, and the rounds up to the best one count.
Every ``chunk`` rounds the predictions are written to the shared folder, with trees and errors as text beside
them. A fit given the ``path`` of one that broke off goes on from its last chunk.
"""

from __future__ import annotations

import base64
import json
import os
import re
import time
import uuid
import zlib
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hazelake.functions.trees import Ensemble
from hazelake.operators.quantiles import column_quantiles
from hazelake.session import fresh_path

BINS = 64
#: bits of a bin's number, and rows that a task looks at at a time
BITS, BLOCK = 6, 1 << 16
#: bytes of bins, a byte per row and feature, up to which one task grows the trees of a chunk
ONE_TASK = 1 << 24
#: bytes of bins that each of several tasks may hold, how many tasks tell each other their sums, chunks between two writes
HELD, TOGETHER, CHUNKS = 1 << 29, 32, 5
TRAIN, VALIDATION = 0, 1
_CELL = "node int, feature int, bin int, g long, n long"


@dataclass(frozen=True)
class Settings:
    rounds: int = 1000
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    tree_columns: float = 0.8
    level_columns: float = 0.8
    min_rows: int = 5
    l1: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.1
    patience: int = 50
    seed: int = 42
    chunk: int = 20


@dataclass
class Node:
    gradient: float
    rows: int
    feature: int = -1
    bin: int = -1
    gain: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class State:
    """All there is to a fit: written as text after each chunk."""

    features: list[str]
    edges: list[list[float]]
    base: float
    scale: float
    rows: int
    settings: dict
    trees: list[list[dict]] = field(default_factory=list)
    errors: list[list[float]] = field(default_factory=list)
    rounds_written: int = 0
    finished: bool = False


@dataclass(frozen=True)
class Boosted:
    """Trees up to the best round, and the errors of all rounds that were fitted."""

    state: State
    best: int

    @property
    def rounds_fitted(self) -> int:
        return len(self.state.trees)

    def ensemble(self, rounds: int | None = None) -> Ensemble:
        """Flat trees; the base score is a tree of one leaf, so ``first(k + 1)`` has k rounds."""
        step = self.state.settings["step"]
        rows = [(0, 0, -1, 0.0, -1, -1, self.state.base, 1.0)]
        for t, tree in enumerate(self.state.trees[:self.best if rounds is None else rounds], 1):
            for i, n in enumerate(tree):
                cut = self.state.edges[n["feature"]][n["bin"]] if n["left"] >= 0 else 0.0
                rows.append((t, i, n["feature"], cut, n["left"], n["right"], step * leaf_value(n, self.state.settings), float(n["rows"])))
        columns = ["tree", "id", "feature", "threshold", "left", "right", "value", "cover"]
        return Ensemble.from_nodes(pd.DataFrame(rows, columns=columns), np.ones(rows[-1][0] + 1))

    def gains(self) -> np.ndarray:
        """Mean gain of the cuts by each feature in the rounds up to the best one, as shares."""
        total, cuts = np.zeros(len(self.state.features)), np.zeros(len(self.state.features))
        for tree in self.state.trees[:self.best]:
            for n in tree:
                if n["left"] >= 0:
                    total[n["feature"]] += n["gain"]
                    cuts[n["feature"]] += 1
        mean = total / np.maximum(cuts, 1)
        return mean / mean.sum() if mean.sum() else mean


# ------------------------------------------------------------------ arithmetic
def _threshold(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(node: dict, settings: dict) -> float:
    held = node["rows"] + settings["l2"]
    return float(-_threshold(node["gradient"], settings["l1"]) / held) if held else 0.0


def gain_column(g, n, l1: float, l2: float):
    """What gradients ``g`` over ``n`` rows contribute to a gain."""
    over = F.greatest(F.abs(g) - F.lit(l1), F.lit(0.0))
    return F.try_divide(over * over, n + F.lit(l2))


def pruned(tree: list[Node], min_gain: float) -> list[Node]:
    """Cuts above two leaves that gain less than ``min_gain`` taken back, again and again; numbers are closed up."""
    for node in reversed(tree):  # children come after their parents
        if node.left >= 0 and node.gain < min_gain and tree[node.left].left < 0 and tree[node.right].left < 0:
            node.left = node.right = node.feature = node.bin = -1
    place, out = {0: 0}, [0]
    for i in out:
        if tree[i].left >= 0:
            for child in (tree[i].left, tree[i].right):
                place[child] = len(out)
                out.append(child)
    return [replace(tree[i], left=place.get(tree[i].left, -1), right=place.get(tree[i].right, -1)) for i in out]


def column_sets(settings: Settings, columns: int, tree: int) -> list[np.ndarray]:
    """Columns that each level of a tree may cut."""
    rng = np.random.default_rng([settings.seed, tree])
    of_tree = rng.choice(columns, max(1, int(settings.tree_columns * columns)), replace=False)
    return [np.sort(rng.choice(of_tree, max(1, int(settings.level_columns * len(of_tree))), replace=False)) for _ in range(settings.depth)]


def drawn(rows: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    """Whether each row number is in the sample of a tree."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((settings.seed * 1_000_003 + tree) * 0xD1B54A32D192ED03 % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((h ^ h >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53 < settings.row_share


# ------------------------------------------------------------------ inside tasks
def _descend(bins: np.ndarray, tree: list[dict]) -> np.ndarray:
    """The leaf that each row falls into."""
    feature, cut, left, right = (np.array([n[k] for n in tree]) for k in ("feature", "bin", "left", "right"))
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while (inner := left[node] >= 0).any():
        goes_left = bins[rows, np.where(inner, feature[node], 0)] <= cut[node]
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
    return node


def _filled(tree: list[dict], values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, columns, cuts and leaf values of a tree filled up to a whole one: rows in an early leaf go on to the left."""
    depth, level = 0, [0]
    while level := [c for i in level if tree[i]["left"] >= 0 for c in (tree[i]["left"], tree[i]["right"])]:
        depth += 1
    feature, cut, value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, 255, np.uint8), np.zeros(1 << depth)
    stack = [(0, 0, 0)]
    while stack:
        i, at, down = stack.pop()
        if tree[i]["left"] >= 0:
            feature[at], cut[at] = tree[i]["feature"], tree[i]["bin"]
            stack += [(tree[i]["left"], 2 * at + 1, down + 1), (tree[i]["right"], 2 * at + 2, down + 1)]
        else:
            value[((at + 1) << (depth - down)) - (1 << depth)] = values[i]
    return depth, feature, cut, value


def _predicted(bins: np.ndarray, start: np.ndarray, trees: list[list[dict]], settings: dict) -> np.ndarray:
    """Predictions after more trees; places in a whole tree are numbers, so a level takes three lookups a row."""
    out, flat = start.copy(), np.ascontiguousarray(bins).ravel()
    base = np.arange(len(bins)) * bins.shape[1]
    for tree in trees:
        depth, feature, cut, value = _filled(tree, np.array([leaf_value(n, settings) for n in tree]))
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (flat.take(base + feature.take(at)) > cut.take(at))
        out += settings["step"] * value.take(at - ((1 << depth) - 1))
    return out


def _matrix(column, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def _sums(rows, bins, y, part, guess, tree: list[dict] | None, wanted: np.ndarray, columns: np.ndarray, settings: Settings, number: int, scale: float):
    """Gradients and rows of the nodes ``wanted`` by column, node and bin, and (errors, rows) of training and validation."""
    errors = [(int(np.rint(np.abs(guess - y)[part == p] * scale).astype(np.int64).sum()), int((part == p).sum())) for p in (TRAIN, VALIDATION)]
    g = np.zeros((len(columns), len(wanted) * BINS))
    n = np.zeros_like(g)
    if len(wanted):
        used = np.flatnonzero((part == TRAIN) & drawn(rows, settings, number))
        bins = bins[used]
        place = np.full(len(tree or [0]), -1, dtype=np.int64)
        place[wanted] = np.arange(len(wanted))
        node = place[_descend(bins, tree)] if tree else np.zeros(len(used), dtype=np.int64)
        used, bins, node = used[node >= 0], bins[node >= 0], node[node >= 0] * BINS
        gradient = np.rint((guess - y)[used] * scale)  # whole numbers, so sums are exact
        for k, c in enumerate(columns.tolist()):
            cell = node + bins[:, c]
            g[k] = np.bincount(cell, weights=gradient, minlength=g.shape[1])
            n[k] = np.bincount(cell, minlength=g.shape[1])
    return g, n, errors


def _cells(state: State, settings: Settings, tree: list[dict] | None, frontier: list[int], columns: np.ndarray, with_errors: bool):
    """Per task: gradients and rows by (node, feature, bin), and errors as node -1 (training) and -2 (validation)."""
    features, later, number, scale = len(state.features), state.trees[state.rounds_written:], len(state.trees), state.scale
    plain, wanted = asdict(settings), np.array(frontier, dtype=np.int64)

    def run(batches):
        g, error, seen = 0.0, [0, 0], [0, 0]
        n = np.zeros((len(columns), len(wanted) * BINS))
        for batch in batches:
            bins, y, part, start = _matrix(batch.column(1), features), *[batch.column(i).to_numpy() for i in (2, 3, 4)]
            guess = _predicted(bins, start, later, plain)
            more_g, more_n, errors = _sums(batch.column(0).to_numpy(), bins, y, part, guess, tree, wanted, columns, settings, number, scale)
            g, n = g + more_g, n + more_n
            error, seen = [a + b for a, (b, _) in zip(error, errors)], [a + b for a, (_, b) in zip(seen, errors)]
        k, cell = np.nonzero(n)
        out = [wanted[cell // BINS], columns[k], cell % BINS, g[k, cell].astype(np.int64) if len(k) else k, n[k, cell].astype(np.int64)]
        if with_errors:
            extra = [[-1, -2], [0, 0], [0, 0], error, seen]
            out = [np.concatenate([a, np.array(b)]) for a, b in zip(out, extra)]
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(out, kinds)], names=["node", "feature", "bin", "g", "n"])

    return run


def cuts_in_task(g, n, errors, wanted, columns, settings: Settings, scale: float) -> dict[int, dict]:
    """What ``best_cuts`` finds, from the sums of all rows: the same numbers in the same order of operations."""
    out = {-1 - p: {"g": e / scale, "n": k} for p, (e, k) in enumerate(errors)}
    shape = (len(columns), len(wanted), BINS)
    gl, nl = np.cumsum(g.reshape(shape), axis=2) / scale, np.cumsum(n.reshape(shape), axis=2)

    def part(g, n):
        over = np.maximum(np.abs(g) - settings.l1, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return over * over / (n + settings.l2)

    all_g, all_n = gl[:, :, -1:], nl[:, :, -1:]
    allowed = (nl >= settings.min_rows) & (all_n - nl >= settings.min_rows) & (nl > 0) & (all_n - nl > 0)
    gain = np.where(allowed, part(gl, nl) + part(all_g - gl, all_n - nl) - part(all_g, all_n), -np.inf)
    for k, node in enumerate(wanted.tolist()):
        if not all_n[0, k, 0]:
            continue
        c, b = divmod(int(gain[:, k].argmax()), BINS)  # the first of equals: the smallest feature and bin
        found = bool(np.isfinite(gain[c, k, b]))
        out[node] = {"g": float(all_g[0, k, 0]), "n": int(all_n[0, k, 0]), "gain": float(gain[c, k, b]) if found else None, "feature": int(columns[c]),
                     "bin": b, "gl": float(gl[c, k, b]), "nl": int(nl[c, k, b])}
    return out


def _chunk_in_task(given: str):
    """The state after the rounds of one chunk, all rows being in this task."""

    def run(batches):
        state = State(**json.loads(given))
        settings, held = Settings(**state.settings), list(batches)
        rows, y, part, start = (np.concatenate([b.column(i).to_numpy() for b in held] or [np.zeros(0)]) for i in (0, 2, 3, 4))
        bins = np.concatenate([_matrix(b.column(1), len(state.features)) for b in held])
        guess = _predicted(bins, start, state.trees[state.rounds_written:], state.settings)

        def cuts(tree, frontier, columns, with_errors):
            wanted = np.array(frontier, dtype=np.int64)
            g, n, errors = _sums(rows, bins, y, part, guess, tree, wanted, columns, settings, len(state.trees), state.scale)
            return cuts_in_task(g, n, errors, wanted, columns, settings, state.scale)

        while True:
            tree = _grow(cuts, state, settings)
            state.finished = tree is None
            if tree is not None:
                state.trees.append([asdict(n) for n in tree])
                guess = _predicted(bins, guess, state.trees[-1:], state.settings)
            if state.finished or len(state.trees) % settings.chunk == 0:
                break
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(state))])], names=["value"])

    return run


class _Rows:
    """The rows that a task holds: bins by pairs of columns, and the node that each row drawn for the tree is in.

    Two neighbouring columns share a number, their bins next to each other: a pass over the rows counts the cells of both, and
    each column's are sums of them. Rows are taken in blocks that stay in the processor's cache.
    """

    def __init__(self, batches, state: State):
        pieces, others = [], [[], [], [], []]
        for b in batches:
            bins = _matrix(b.column(1), len(state.features)).T
            piece = np.left_shift(bins[::2], BITS, dtype=np.uint16)
            piece[:len(bins) // 2] |= bins[1::2]
            pieces.append(piece)
            for kept, i in zip(others, (0, 2, 3, 4)):
                kept.append(b.column(i).to_numpy())
        self.rows, self.y, self.part, self.guess = (np.concatenate(x or [np.zeros(0)]) for x in others)
        self.n = len(self.y)
        self.pairs = np.empty((-(-len(state.features) // 2), self.n), np.uint16)
        at = 0
        while pieces:  # given back one by one
            piece = pieces.pop(0)
            self.pairs[:, at:at + piece.shape[1]] = piece
            at += piece.shape[1]
        for tree in state.trees[state.rounds_written:]:
            self.add(tree, state.settings)

    def _bins(self, feature: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The bin of a feature for each of some rows."""
        return self.pairs.ravel().take((feature >> 1) * self.n + rows) >> (BITS * (1 - (feature & 1))).astype(np.uint16) & np.uint16(BINS - 1)

    def add(self, tree: list[dict], settings: dict) -> None:
        """Predictions after one more tree."""
        depth, feature, cut, value = _filled(tree, np.array([leaf_value(n, settings) for n in tree]))
        value = settings["step"] * value
        for start in range(0, self.n, BLOCK):
            own = np.arange(start, min(start + BLOCK, self.n))
            at = np.zeros(len(own), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (self._bins(feature.take(at), own) > cut.take(at))
            self.guess[start:start + BLOCK] += value.take(at - ((1 << depth) - 1))

    def errors(self, scale: float) -> list[tuple[int, int]]:
        off = np.rint(np.abs(self.guess - self.y) * scale)
        return [(int(off[self.part == p].astype(np.int64).sum()), int((self.part == p).sum())) for p in (TRAIN, VALIDATION)]

    def draw(self, settings: Settings, number: int, scale: float) -> None:
        self.used = np.flatnonzero((self.part == TRAIN) & drawn(self.rows, settings, number))
        self.gradient = np.rint((self.guess - self.y)[self.used] * scale)  # whole numbers, so sums are exact
        self.node = np.zeros(len(self.used), dtype=np.int64)

    def step_down(self, tree: list[dict]) -> None:
        """From nodes of the level before to their children."""
        feature, cut, left, right = (np.array([n[k] for n in tree]) for k in ("feature", "bin", "left", "right"))
        for start in range(0, len(self.used), BLOCK):
            held = self.node[start:start + BLOCK]
            going = np.flatnonzero(left.take(held) >= 0)
            node = held[going]
            goes_left = self._bins(feature.take(node), self.used[start:start + BLOCK][going]) <= cut.take(node)
            held[going] = np.where(goes_left, left.take(node), right.take(node))

    def sums(self, nodes: list[int], columns: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and rows by column, node and bin."""
        place = np.full(most, -1, dtype=np.int64)
        place[nodes] = np.arange(len(nodes))
        at = place.take(self.node)
        mine = np.flatnonzero(at >= 0)
        own, gradient, at = self.used[mine], self.gradient[mine], at[mine]
        shape = (len(columns), len(nodes), BINS)
        g, n = np.zeros(shape), np.zeros(shape, dtype=np.int64)
        cells = len(nodes) * BINS * BINS
        if len(own) < cells:  # few rows: cells of two columns would be more than they are
            for k, c in enumerate(columns.tolist()):
                cell = at * BINS + self._bins(np.int64(c), own)
                g[k] = np.bincount(cell, weights=gradient, minlength=len(nodes) * BINS).reshape(shape[1:])
                n[k] = np.bincount(cell, minlength=len(nodes) * BINS).reshape(shape[1:])
            return g, n
        pairs = np.unique(columns >> 1).tolist()
        both_g, both_n = np.zeros((len(pairs), cells)), np.zeros((len(pairs), cells), dtype=np.int64)
        step = max(BLOCK, 8 * cells)
        for start in range(0, len(own), step):
            rows, weights, first = own[start:start + step], gradient[start:start + step], at[start:start + step] * (BINS * BINS)
            for k, pair in enumerate(pairs):
                cell = first + self.pairs[pair].take(rows)
                both_g[k] += np.bincount(cell, weights=weights, minlength=cells)
                both_n[k] += np.bincount(cell, minlength=cells)
        for k, c in enumerate(columns.tolist()):
            pair, other = pairs.index(c >> 1), 1 if c & 1 else 2
            for out, both in ((g, both_g), (n, both_n)):
                out[k] = both[pair].reshape(len(nodes), BINS, BINS).sum(axis=other)
        return g, n


def _told(g: np.ndarray, n: np.ndarray, errors: list) -> str:
    return json.dumps(errors) + "|" + base64.b64encode(zlib.compress(g.astype("<i8").tobytes() + n.astype("<i8").tobytes(), 1)).decode()


def _added(messages: list[str], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list]:
    """Sums over all tasks; whole numbers, so that every task comes to the same."""
    total, errors = np.zeros((2, *shape), dtype=np.int64), np.zeros((2, 2), dtype=object)
    for message in messages:
        own, cells = message.split("|")
        total += np.frombuffer(zlib.decompress(base64.b64decode(cells)), "<i8").reshape(total.shape)
        errors += np.array(json.loads(own), dtype=object)
    return total[0].astype(float), total[1].astype(float), [tuple(e) for e in errors]


def _teller(context, folder: str | None):
    """Sends a message to all tasks that run together and returns those of all, in the order of the tasks.

    Spark's own exchange looks for answers once a second only. Where the shared folder is one of files, messages are files in
    it, named anew by each attempt; a task removes its message once all have answered the next one.
    """
    if folder is None:
        return context.allGather
    folder = os.path.join(folder, context.allGather(uuid.uuid4().hex)[0])
    os.makedirs(folder, exist_ok=True)
    own, tasks, step = context.partitionId(), len(context.getTaskInfos()), 0

    def told(message: str) -> list[str]:
        nonlocal step
        mine, out = os.path.join(folder, f"{step}-{own}"), []
        with open(mine + ".part", "w") as f:
            f.write(message)
        os.replace(mine + ".part", mine)
        for k in range(tasks):
            while not os.path.exists(path := os.path.join(folder, f"{step}-{k}")):
                time.sleep(0.002)
            with open(path) as f:
                out.append(f.read())
        if step:
            os.remove(os.path.join(folder, f"{step - 1}-{own}"))
        step += 1
        return out

    return told


def _chunks_together(given: str, until: int, folder: str | None):
    """The state after ``until`` rounds, or the last one, from tasks that hold the rows and grow the same trees side by side."""

    def run(batches):
        context, state = BarrierTaskContext.get(), State(**json.loads(given))
        settings, held, before = Settings(**state.settings), _Rows(batches, state), {}
        tell = _teller(context, folder)

        def cuts(tree, frontier, columns, with_errors):
            number, most = len(state.trees), len(tree or [0])
            if with_errors:
                sets = column_sets(settings, len(state.features), number)
                before.update(columns=np.unique(np.concatenate(sets)), sums={})
                errors = held.errors(state.scale)
                held.draw(settings, number, state.scale)
            else:
                errors = [(0, 0), (0, 0)]
                held.step_down(tree)
            # siblings stand side by side: the larger one is what its parent has and the smaller one has not
            pairs = [] if with_errors else list(zip(frontier[::2], frontier[1::2]))
            small = [min(p, key=lambda i: (tree[i]["rows"], i)) for p in pairs] or frontier
            g, n, errors = _added(tell(_told(*held.sums(small, before["columns"], most), errors)), (len(before["columns"]), len(small), BINS))
            sums = {i: (g[:, k], n[:, k]) for k, i in enumerate(small)}
            parent = {n["left"]: i for i, n in enumerate(tree or ()) if n["left"] >= 0}
            for (left, right), i in zip(pairs, small):
                sums[left + right - i] = tuple(a - b for a, b in zip(before["sums"][parent[left]], sums[i]))
            before["sums"] = sums
            at = np.searchsorted(before["columns"], columns)
            g, n = (np.concatenate([sums[i][k][at] for i in frontier], axis=1) for k in (0, 1))
            return cuts_in_task(g, n, errors, np.array(frontier), columns, settings, state.scale)

        while not state.finished and len(state.trees) < until:
            tree = _grow(cuts, state, settings)
            state.finished = tree is None
            if tree is not None:
                state.trees.append([asdict(n) for n in tree])
                held.add(state.trees[-1], state.settings)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(state))])], names=["value"])

    return run


def _files_in(spark: SparkSession, path: str) -> str | None:
    """The folder of messages below ``path`` if tasks can open files there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/messages")
    return target.toUri().getPath() if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file" else None


def _slots(spark: SparkSession) -> int:
    """Tasks that can run together; 0 if that is not known, or may change."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    local = re.fullmatch(r"local\[(\d+)(?:,.*)?\]", spark.sparkContext.master)
    cores = int(local[1]) if local else 0 if conf.get("spark.default.parallelism") else spark.sparkContext.defaultParallelism
    return min(cores // int(conf.get("spark.task.cpus", "1")), TOGETHER)


# ------------------------------------------------------------------ jobs
def best_cuts(cells: DataFrame, l1: float, l2: float, min_rows: int, scale: float) -> DataFrame:
    """Per node the cut of most gain: node, feature, bin, gain, sums on the left and in all.

    ``cells`` has (node, feature, bin, g, n), g being gradients times ``scale``. Of equal gains the smallest feature and bin is
    taken. Nodes below zero hold errors: they come back with their sums and no cut.
    """
    wide = "decimal(38,0)"
    summed = cells.repartition("node", "feature").groupBy("node", "feature", "bin").agg(
        F.sum(F.col("g").cast(wide)).cast("double").alias("g"), F.sum("n").alias("n")
    )
    bins = Window.partitionBy("node", "feature")  # as many rows as bins
    upto = bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = summed.select(
        "node", "feature", "bin", *[(F.sum(c).over(w) / k).alias(f"{c}{s}") for c, k in (("g", scale), ("n", 1)) for s, w in (("l", upto), ("", bins))]
    )
    right_g, right_n = F.col("g") - F.col("gl"), F.col("n") - F.col("nl")
    gain = gain_column(F.col("gl"), F.col("nl"), l1, l2) + gain_column(right_g, right_n, l1, l2) - gain_column(F.col("g"), F.col("n"), l1, l2)
    allowed = (F.col("node") >= 0) & (F.col("nl") >= min_rows) & (right_n >= min_rows) & (F.col("nl") > 0) & (right_n > 0)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "nl")
    best = sums.groupBy("node").agg(F.max(F.when(allowed, cut)).alias("cut"), F.max(F.struct("g", "n")).alias("all"))
    return best.select(
        "node", (-F.col("cut.f")).alias("feature"), (-F.col("cut.b")).alias("bin"), F.col("cut.gain").alias("gain"),
        F.col("cut.gl").alias("gl"), F.col("cut.nl").alias("nl"), F.col("all.g").alias("g"), F.col("all.n").alias("n"),
    )


def quantile_edges(train: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper ends of the bins of each column: its quantiles, without repeats; the last bin has none."""
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    found = column_quantiles(train, features, wanted)
    return [sorted(set(found.get(f, {}).values())) for f in features]


def binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """(id, bins, y, part): a byte per feature, the number of edges below its value."""

    def run(batches):
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            bins = np.column_stack([np.searchsorted(np.array(e), np.ascontiguousarray(values[:, i])) for i, e in enumerate(edges)])
            data = np.ascontiguousarray(bins, dtype=np.uint8).tobytes()
            width = len(edges)
            packed = [data[k:k + width] for k in range(0, len(data), width)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(0), batch.column(1)], names=["bins", "y", "part"])

    # one array, not many columns: Spark asks each column sent to Python for its size at every row
    numbers = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    values = rows.select(F.col("y").cast("double").alias("y"), F.col("part").cast("int").alias("part"), numbers)
    return values.mapInArrow(run, "bins binary, y double, part int").select(F.monotonically_increasing_id().alias("id"), "bins", "y", "part")


def _put(spark: SparkSession, path: str, state: State) -> None:
    spark.createDataFrame([(json.dumps(asdict(state)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> State | None:
    """The state after the last chunk that was written in whole below ``path``."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return None
    last = max(f.getPath().getParent().getName() for f in found)
    return State(**json.loads(spark.read.text(f"{path}/{last}", wholetext=True).first()[0]))


def _start(
    train: DataFrame, validation: DataFrame, label: str, features: list[str], settings: Settings, path: str, bins: int, edges: list[list[float]] | None
) -> State:
    spark = train.sparkSession
    held = [df.dropna(subset=[*features, label]).select(F.col(label).alias("y"), F.lit(p).alias("part"), *features) for p, df in ((TRAIN, train), (VALIDATION, validation))]
    edges = edges or quantile_edges(held[0], features, bins)
    binned(held[0].unionByName(held[1]), features, edges).write.mode("overwrite").parquet(f"{path}/chunk-00000")
    rows = spark.read.parquet(f"{path}/chunk-00000")
    facts = rows.agg(F.avg(F.when(F.col("part") == TRAIN, F.col("y").cast("decimal(30,9)"))).cast("double").alias("base"), F.max(F.abs("y")).alias("most"), F.count("*").alias("n")).first()
    if facts["base"] is None:
        raise ValueError("no training row has a label and all features")
    # sums of as many gradients stay whole numbers in doubles
    scale = 2.0 ** np.floor(52 - np.log2(4 * max(facts["most"], 1e-9) * facts["n"]))
    state = State(list(features), edges, facts["base"], float(scale), facts["n"], asdict(settings))
    _put(spark, f"{path}/state-00000", state)
    return state


def _rows_of(spark: SparkSession, path: str, state: State) -> DataFrame:
    """(id, bins, y, part, start) as written last; before the first round all rows start from the base."""
    table = spark.read.parquet(f"{path}/chunk-{-(-state.rounds_written // state.settings['chunk']):05d}")
    return table.select("id", "bins", "y", "part", "start" if state.rounds_written else F.lit(state.base).alias("start"))


def _write_chunk(spark: SparkSession, path: str, table: DataFrame, state: State) -> DataFrame:
    features, later, settings = len(state.features), state.trees[state.rounds_written:], state.settings

    def run(batches):
        for batch in batches:
            start = _predicted(_matrix(batch.column(1), features), batch.column(4).to_numpy(), later, settings)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(start)], names=batch.schema.names)

    state.rounds_written = len(state.trees)
    chunk = -(-state.rounds_written // settings["chunk"])
    table.mapInArrow(run, table.schema).write.mode("overwrite").parquet(f"{path}/chunk-{chunk:05d}")
    _put(spark, f"{path}/state-{chunk:05d}", state)
    return spark.read.schema(table.schema).parquet(f"{path}/chunk-{chunk:05d}")


def _cuts_of(table: DataFrame, state: State, settings: Settings):
    """Best cuts of a level by a job over the table."""

    def cuts(tree, frontier, columns, with_errors):
        found = table.mapInArrow(_cells(state, settings, tree, frontier, columns, with_errors), _CELL)
        best = best_cuts(found, settings.l1, settings.l2, settings.min_rows, state.scale)
        return {r["node"]: r for r in best.collect()}  # one row per node

    return cuts


def _grow(cuts_of, state: State, settings: Settings) -> list[Node] | None:
    """One more tree; None if its first level shows that fitting is over. Notes the errors before it."""
    sets = column_sets(settings, len(state.features), len(state.trees))
    tree: list[Node] = []
    frontier = [0]
    for level in range(settings.depth):
        cuts = cuts_of([asdict(n) for n in tree] or None, frontier, sets[level], level == 0)
        if level == 0:
            state.errors.append([cuts[k]["g"] / cuts[k]["n"] if k in cuts and cuts[k]["n"] else None for k in (-1, -2)])
            if is_over(state, settings):
                return None
            root = cuts.get(0)
            tree.append(Node(root["g"], int(root["n"])) if root else Node(0.0, 0))
        following = []
        for i in frontier:
            cut = cuts.get(i)
            if cut is None or cut["gain"] is None or cut["gain"] <= 1e-6:
                continue
            node = tree[i]
            node.feature, node.bin, node.gain, node.left, node.right = int(cut["feature"]), int(cut["bin"]), cut["gain"], len(tree), len(tree) + 1
            following += [len(tree), len(tree) + 1]
            tree += [Node(cut["gl"], int(cut["nl"])), Node(cut["g"] - cut["gl"], int(cut["n"] - cut["nl"]))]
        frontier = following
        if not frontier:
            break
    return pruned(tree, settings.min_gain)


def best_round(errors: list[list[float]]) -> int:
    """Rounds with the smallest validation error, of training rows where there are none for validation."""
    own = [v if v is not None else t for t, v in errors]
    return min(range(len(own)), key=lambda i: (own[i], i))


def is_over(state: State, settings: Settings) -> bool:
    spent = len(state.errors) - 1 - best_round(state.errors) >= settings.patience
    return len(state.trees) >= settings.rounds or state.errors[-1][1] is not None and spent


def fit(
    train: DataFrame, validation: DataFrame, label: str, features: list[str], settings: Settings = Settings(),
    path: str | None = None, bins: int = BINS, edges: list[list[float]] | None = None, stop_after: int | None = None,
    one_task: int = ONE_TASK, held: int = HELD,
) -> Boosted:
    """Trees fitted to the training rows until the validation error no longer falls.

    Rows without label or with a missing feature are left out; without validation rows all rounds are fitted. ``path`` is
    a folder that all executors share: a fit that broke off there goes on from its last chunk. ``edges`` are upper ends of
    bins for each feature, rising, in place of quantiles. Tables of up to ``one_task`` bytes of bins are one task's work,
    larger ones of up to ``held`` bytes a task that of tasks running together. ``stop_after`` ends the call after so many chunks, as
    a lost driver would.
    """
    if bins > BINS or any(len(e) >= BINS for e in edges or ()):
        raise ValueError(f"bins are numbered by a byte and counted in {BINS}")
    spark = train.sparkSession
    path = path or fresh_path(spark, "boosting")
    state = load(spark, path) or _start(train, validation, label, features, settings, path, bins, edges)
    settings = Settings(**state.settings)
    table = _rows_of(spark, path, state)
    size, slots, chunks = state.rows * len(features), _slots(spark), 0
    while not state.finished and (stop_after is None or chunks < stop_after):
        if size <= one_task:
            state = State(**json.loads(table.coalesce(1).mapInArrow(_chunk_in_task(json.dumps(asdict(state))), "value string").first()[0]))
        elif size <= held * slots:
            more = CHUNKS if stop_after is None else min(CHUNKS, stop_after - chunks)
            until = (len(state.trees) // settings.chunk + more) * settings.chunk
            grown = table.repartition(slots).mapInArrow(_chunks_together(json.dumps(asdict(state)), until, _files_in(spark, path)), "value string", barrier=True)
            state = State(**json.loads(grown.collect()[0][0]))  # one row
            chunks += more - 1
        else:
            tree = _grow(_cuts_of(table, state, settings), state, settings)
            state.finished = tree is None
            if tree is not None:
                state.trees.append([asdict(n) for n in tree])
        if state.finished or len(state.trees) % settings.chunk == 0:
            table = _write_chunk(spark, path, table, state) if len(state.trees) > state.rounds_written else table
            if state.finished:
                _put(spark, f"{path}/state-{-(-state.rounds_written // settings.chunk):05d}", state)
            chunks += 1
    return Boosted(state, best_round(state.errors) if state.errors else 0)
