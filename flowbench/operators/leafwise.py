"""Gradient-boosted trees with second-order leaf values, penalties on leaves and growth by the best leaf.

Features are binned once. A pass over the drawn rows sums gradients and hessians by open leaf, allowed feature and bin; split gains follow on the
driver from sums of a size set by leaves, features and bins. Leaves are split in the order of their gains (the best leaf first), but a pass
histograms every leaf that could come next, so that a tree takes about as many passes as it is deep. Of two children the smaller one is counted;
the other follows by subtraction from their parent. The rows of small leaves come to the driver, at most ``FETCHED`` in a pass, and what grows below
these needs no further pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.session import few_rows

# Bytes of sums up to which the driver adds up those of all tasks itself, without a second stage.
SMALL_SUMS = 1_000_000
# Rows of small leaves that come to the driver in one pass.
FETCHED = 20_000


@dataclass
class Tree:
    """Nodes in order of their making, the root first: a row goes left if its cell is at most ``limit``; ``left`` is -1 at a leaf."""

    feature: list[int]
    limit: list[float]  # or numbers of bins
    left: list[int]
    right: list[int]
    value: list[float]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row of ``x`` falls into."""
        feature, limit, left, right = map(np.asarray, (self.feature, self.limit, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(left[node] >= 0)
        while inner.size:
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] <= limit[at], left[at], right[at])
            inner = inner[left[node[inner]] >= 0]
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf_of(x)]


@dataclass
class FittedBoosting:
    features: list[str]
    classes: list[int]
    start: list[float]
    trees: list[list[Tree]]  # of each round, one for each class that has a margin

    def margins(self, x: np.ndarray) -> np.ndarray:
        """A column for each tree of a round: one for two classes, else one a class."""
        out = np.tile(np.asarray(self.start), (len(x), 1))
        for round_ in self.trees:
            for k, tree in enumerate(round_):
                out[:, k] += tree.values(x)
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` and ``probability`` of the larger class, or the array ``probabilities`` for more than two classes."""
        require_columns(df, self.features, numeric=True)
        # Sent to each task: its size follows from rounds and leaves.
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for cells in parts:
                x = np.stack(cells.to_numpy()) if len(cells) else np.empty((0, len(model.value.features)))
                yield pd.Series(list(_probabilities(model.value.margins(x), len(model.value.classes))))

        p = probabilities(F.array(*[finite_or(c).cast("double") for c in self.features]))
        out = df.withColumn("probabilities", p)
        best = F.array_position("probabilities", F.array_max("probabilities"))
        out = out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), best.cast("int")).cast("int"))
        if len(self.classes) == 2:
            out = out.withColumn("probability", F.col("probabilities")[1]).drop("probabilities")
        return out


def _probabilities(margins: np.ndarray, classes: int) -> np.ndarray:
    if classes == 1:
        return np.ones((len(margins), 1))
    if classes == 2:
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -700, 700)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LeafWiseBoosting:
    """``leaves`` bounds a tree, ``depth`` (None: no bound) its levels; with ``leaves = 2 ** depth`` growth is level by level in effect.

    ``l2`` and ``l1`` are penalties on leaf values, ``rows`` and ``columns`` the shares drawn for each tree (rows by a hash of their
    number and the round), ``least_rows`` and ``least_hessian`` what a leaf must hold, ``least_gain`` what a split must bring beyond nothing.
    A feature with at most ``bins`` distinct values is split between any two of them, others at quantiles. Ties go to the first
    feature and the smallest limit. One class only gives a model that predicts it.
    """

    rounds: int = 300
    leaves: int = 31
    depth: int | None = None
    rate: float = 0.1
    rows: float = 0.9
    columns: float = 0.9
    l2: float = 1.0
    l1: float = 0.0
    least_rows: int = 20
    least_hessian: float = 1e-3
    least_gain: float = 0.0
    bins: int = 255
    balanced: bool = True
    settle_every: int = 10
    seed: int = 42
    name: str = "leafwise_boosting"

    @staticmethod
    def by_level(**settings) -> "LeafWiseBoosting":
        """Trees of six full levels, with the usual settings of that kind of growth."""
        usual = {"rounds": 200, "leaves": 64, "depth": 6, "rows": 0.8, "columns": 0.8, "least_rows": 1, "least_hessian": 1.0, "balanced": False, "name": "levelwise_boosting"}
        return LeafWiseBoosting(**{**usual, **settings})

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedBoosting:
        features = list(require_columns(train, features, numeric=True))
        y = F.col(label).cast("int")
        clean = train.select(*[finite_or(c).alias(f"_f{i}") for i, c in enumerate(features)], y.alias("_y"))
        tallies = {r["_y"]: r["n"] for r in few_rows(clean.groupBy("_y").agg(F.count("*").alias("n")), "classes")}
        if not tallies:
            raise ValueError("the training table is empty")
        classes, total = sorted(tallies), sum(tallies.values())
        if len(classes) == 1:
            return FittedBoosting(features, classes, [0.0], [])
        weights = {c: total / (len(classes) * n) if self.balanced else 1.0 for c, n in tallies.items()}
        limits = _limits(clean, len(features), self.bins)
        codes = F.coalesce(*[F.when(F.col("_y") == c, F.lit(i)) for i, c in enumerate(classes)])
        weight = F.coalesce(*[F.when(F.col("_y") == c, F.lit(w)) for c, w in weights.items()])
        cells = [F.col(f"_f{i}") for i in range(len(features))]
        raw = Blocks.of(clean, cells, {"y": codes, "w": weight, "row": F.monotonically_increasing_id()})
        mass = np.array([tallies[c] * weights[c] for c in classes])
        share = mass / mass.sum()
        start = [math.log(share[1] / share[0])] if len(classes) == 2 else np.log(share).tolist()
        blocks = raw.updated(lambda b: _binned(b, limits, start))
        raw.release()
        trees: list[list[Tree]] = []
        newest: list[Tree] = []
        rng = np.random.default_rng(self.seed)
        try:
            for round_ in range(self.rounds):
                n = max(1, round(self.columns * len(features)))
                allowed = [np.sort(rng.permutation(len(features))[:n]) for _ in start]
                # Margins and gradients are worked out once a round, with its first pass.
                before, blocks = blocks, blocks.stepped(lambda b, newest=newest, r=round_: _begun(b, newest, r, self.rows, self.seed), cut=round_ % self.settle_every == self.settle_every - 1)
                grown = self._round(blocks, allowed, limits)
                before.release()
                if all(len(t.left) == 1 for t in grown) and self.rows >= 1 and self.columns >= 1:
                    break  # nothing was drawn: no later round can find more
                newest = grown
                trees.append([_in_values(t, limits) for t in grown])
        finally:
            blocks.release()
        return FittedBoosting(features, classes, start, trees)

    def _round(self, blocks: Blocks, allowed: list[np.ndarray], limits: list[list[float]]) -> list[Tree]:
        """One tree for each margin, in bins."""
        growing = [_Growing(self, a, [len(v) for v in limits]) for a in allowed]
        while True:
            asked = [(g.tree_and_open(), g.widths) for g in growing]
            if not any(counted or fetched for (_, counted, fetched), _ in asked):
                return [g.finished() for g in growing]
            # Every row is in one leaf of each tree: a block gives its rows' sums for the leaves to count.
            size = sum(24 * len(counted) * sum(widths.values()) for (_, counted, _), widths in asked)
            found = blocks.sums(lambda b: [x for k, (own, widths) in enumerate(asked) for x in _histogram(b, k, *own, widths)], small=size <= SMALL_SUMS)
            for k, g in enumerate(growing):
                g.histogrammed(found[2 * k], found[2 * k + 1])


# Split of a node whose histogram has not been taken yet.
_UNKNOWN = "unknown"


class _Growing:
    """A tree under construction, in bins. Nodes are known further than they are used: their gains decide which are split."""

    def __init__(self, settings: LeafWiseBoosting, allowed: np.ndarray, sizes: list[int]):
        self.s, self.allowed, self.sizes = settings, allowed, sizes
        # Bins of the features that may be split; sums hold them one after another.
        self.widths = {int(f): sizes[f] + 1 for f in allowed}
        self.cells = np.concatenate([f * (max(sizes) + 1) + np.arange(n) for f, n in self.widths.items()])
        self.tables: dict[int, np.ndarray] = {}  # sums of nodes whose children have none yet
        self.held: dict[int, tuple] = {}  # bins, gradients and hessians of fetched rows, by the lowest nodes they are in
        self.depth, self.feature, self.limit, self.left, self.right = [0], [0], [0], [-1], [-1]
        self.sums: list[np.ndarray] = [np.zeros(3)]
        self.split: list = [_UNKNOWN]
        self.counted: list[tuple] = []  # node to count, its sibling and their parent
        self.fetched: list[tuple] = []

    def _best_first(self) -> tuple[list[int], list[int], bool]:
        """Nodes split in the order of their gains, the leaves then, and whether a gain that may come next is still unknown."""
        chosen, front = [], [0]
        while len(chosen) < self.s.leaves - 1:
            if any(self.split[i] is _UNKNOWN for i in front):
                return chosen, front, True
            ready = [i for i in front if self.split[i]]
            if not ready:
                break
            best = min(ready, key=lambda i: (-self.split[i][0], i))
            chosen.append(best)
            front.remove(best)
            front += self._children(best)
        return chosen, front, False

    def _children(self, node: int) -> list[int]:
        """The two nodes below a split, made when they are first asked for."""
        if self.left[node] < 0:
            _, self.feature[node], self.limit[node], *sides = self.split[node]
            self.left[node], self.right[node] = len(self.left), len(self.left) + 1
            last = self.s.depth is not None and self.depth[node] + 1 >= self.s.depth
            for own in sides:
                # Too little for two leaves: known without another pass.
                small = own[2] < 2 * self.s.least_rows or own[1] < 2 * self.s.least_hessian
                self.depth.append(self.depth[node] + 1)
                self.sums.append(own)
                self.split.append(None if last or small else _UNKNOWN)
                for values, new in ((self.feature, 0), (self.limit, 0), (self.left, -1), (self.right, -1)):
                    values.append(new)
            if node in self.held:
                bins, *more = self.held.pop(node)
                low = bins[self.feature[node]] <= self.limit[node]
                for side, own in ((self.left[node], low), (self.right[node], ~low)):
                    self.held[side] = (bins[:, own], *(v[own] for v in more))
        return [self.left[node], self.right[node]]

    def tree_and_open(self) -> tuple[Tree, list[int], list[int]]:
        """The tree as far as it is known, and the nodes to count and to fetch for the histograms that are wanted: of leaves, and of what would come below leaves."""
        while True:
            chosen, front, more = self._best_first()
            wanted = [i for i in front if self.split[i] is _UNKNOWN] if more else []
            near = [i for i in wanted if i in self.held]
            if not near:
                break
            for i in near:
                if self.split[i] is _UNKNOWN:
                    node, sibling, parent = self._pair(i)
                    self._take(node, sibling, parent, _sums(*self.held[node], self.widths))
        if wanted:
            # Of the leaves whose gains are known, no more than the splits that are left will be split.
            ready = sorted((i for i in front if self.split[i] and self.split[i] is not _UNKNOWN), key=lambda i: (-self.split[i][0], i))
            for node in ready[: self.s.leaves - 1 - len(chosen)]:
                if node not in self.held:
                    wanted += [i for i in self._children(node) if self.split[i] is _UNKNOWN]
        self.counted, self.fetched, left = [], [], FETCHED
        # Few rows are fetched rather than counted: the smaller side, or both.
        for node, sibling, parent in sorted(set(map(self._pair, wanted)), key=lambda p: (self.sums[p[0]][2], p[0])):
            rows = self.sums[node][2]
            if parent is None or rows > left:
                self.counted.append((node, sibling, parent))
                continue
            self.fetched.append((node, sibling, parent))
            left -= rows
            if self.sums[sibling][2] <= left:
                self.fetched.append((sibling, node, parent))
                left -= self.sums[sibling][2]
        tree = Tree(self.feature, self.limit, self.left, self.right, [0.0] * len(self.left))
        return tree, [p[0] for p in self.counted], [p[0] for p in self.fetched]

    def _pair(self, node: int) -> tuple:
        """The smaller one of the node and its sibling, the other, and their parent."""
        parent = next((i for i in self.tables if node in (self.left[i], self.right[i])), None)
        if parent is None:
            return node, None, None
        return *sorted((self.left[parent], self.right[parent]), key=lambda i: (self.sums[i][2], i)), parent

    def histogrammed(self, table: np.ndarray, rows: list[tuple]) -> None:
        """Takes the sums by counted node and cell, and the fetched rows."""
        for own, pair in zip(table, self.counted):
            self._take(*pair, own)
        if self.fetched:
            place, bins, *more = (np.concatenate(v, axis=-1) for v in zip(*rows))
            for i, (node, sibling, parent) in enumerate(self.fetched):
                own = place == i
                self.held[node] = (bins[:, own], *(v[own] for v in more))
                if parent in self.tables:
                    self._take(node, sibling, parent, _sums(*self.held[node], self.widths))

    def _take(self, node: int, sibling: int | None, parent: int | None, own: np.ndarray) -> None:
        """Finds the splits of a node and its sibling from the sums of the node."""
        if node == 0:
            self.sums[0] = own[: self.widths[int(self.allowed[0])]].sum(axis=0)
        for here, sums in ((node, own), *(() if sibling is None else ((sibling, self.tables.pop(parent) - own),))):
            if self.split[here] is _UNKNOWN:
                whole = np.zeros((len(self.sizes) * (max(self.sizes) + 1), 3))
                whole[self.cells] = sums
                self.split[here] = self._best_split(whole.reshape(len(self.sizes), -1, 3))
                if self.split[here]:
                    self.tables[here] = sums

    def _best_split(self, table: np.ndarray) -> tuple | None:
        """Gain, feature, bin and the sums on both sides of the best split into bins up to and beyond the bin."""
        s = self.s
        below = table.cumsum(axis=1)[:, :-1]
        whole = table.sum(axis=1, keepdims=True)
        above = whole - below
        # What subtraction leaves of an empty side is rounding.
        below, above = (np.where(np.abs(v[..., 2:]) < 0.5, 0.0, v) for v in (below, above))
        enough = (np.minimum(below[..., 2], above[..., 2]) >= s.least_rows) & (np.minimum(below[..., 1], above[..., 1]) >= s.least_hessian)
        gain = _worth(below, s.l1, s.l2) + _worth(above, s.l1, s.l2) - _worth(whole, s.l1, s.l2)
        usable = np.zeros(gain.shape, bool)
        for f in self.allowed:
            usable[f, : self.sizes[f]] = True
        gain = np.where(enough & usable, gain, -np.inf)
        # Gains that differ by rounding alone are ties: the first feature and the smallest limit win.
        best = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max()))) if gain.max() > s.least_gain + 1e-10 else None
        if best is None:
            return None
        f, at = divmod(best, gain.shape[1])
        return float(gain[f, at]), f, at, below[f, at], above[f, at]

    def finished(self) -> Tree:
        """The tree of the chosen splits alone, with leaf values."""
        keep = set(self._best_first()[0])
        tree, order = Tree([], [], [], [], []), [0]
        for node in order:
            inner = node in keep
            children = [self.left[node], self.right[node]] if inner else []
            tree.feature.append(self.feature[node] if inner else 0)
            tree.limit.append(self.limit[node] if inner else 0)
            tree.left.append(len(order) if inner else -1)
            tree.right.append(len(order) + 1 if inner else -1)
            g, h, _ = self.sums[node]
            tree.value.append(0.0 if inner else self.s.rate * leaf_value(float(g), float(h), self.s.l1, self.s.l2))
            order += children
        return tree


def leaf_value(g: float, h: float, l1: float, l2: float) -> float:
    """Newton step of a leaf: minus the gradient sum, shrunk by the first penalty, over the hessian sum and the second."""
    shrunk = math.copysign(max(abs(g) - l1, 0.0), g)
    return -shrunk / (h + l2) if h + l2 > 0 else 0.0


def _worth(sums: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """What a leaf with these sums gains."""
    g = np.maximum(np.abs(sums[..., 0]) - l1, 0.0)
    h = sums[..., 1] + l2
    return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)


def _limits(clean: DataFrame, features: int, bins: int) -> list[list[float]]:
    """Ascending limits of each feature, none at or above its largest value."""
    names = [f"_f{i}" for i in range(features)]
    kinds = clean.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    steps = [i / bins for i in range(1, bins)]
    # Few distinct values are taken as they are: an estimate this far below the bound is sure.
    few = [kinds[c] <= 0.9 * bins for c in names]
    row = clean.agg(*[F.array_sort(F.collect_set(c)).alias(c) if f else F.percentile_approx(c, steps, 10_000).alias(c) for c, f in zip(names, few)], *[F.max(c).alias(f"max{c}") for c in names]).first()
    return [sorted({v for v in (row[c] or []) if v < row[f"max{c}"]}) for c in names]


def _in_values(tree: Tree, limits: list[list[float]]) -> Tree:
    """The tree with limits in place of bins."""
    values = [limits[f][int(b)] if left >= 0 else 0.0 for f, b, left in zip(tree.feature, tree.limit, tree.left)]
    return Tree(tree.feature, values, tree.left, tree.right, tree.value)


def _binned(block: Block, limits: list[list[float]], start: list[float]) -> Block:
    """``bin`` (a line for each feature: the smallest bin whose limit is at least the cell) instead of cells, and the margins to begin with."""
    kind = np.uint8 if max(map(len, limits), default=0) < 256 else np.uint16
    x = block["x"]
    bins = np.stack([np.searchsorted(np.asarray(v), x[:, f], "left").astype(kind) for f, v in enumerate(limits)])
    return {"bin": bins, "y": block["y"].astype(np.int16), "w": block["w"], "row": block["row"].astype(np.uint64), "margin": np.tile(np.asarray(start), (len(x), 1))}


def ends(tree: Tree, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node at which each of the rows ends; a line of ``bins`` for each feature."""
    feature, limit = np.asarray(tree.feature), np.asarray(tree.limit)
    sides = np.stack([tree.right, tree.left], axis=1).ravel()
    n, cells = bins.shape[1], bins.ravel()
    node = np.zeros(len(rows), np.int64)
    inner = np.arange(len(rows) if sides[0] >= 0 else 0)
    at, rows = node[inner], rows.astype(np.int64)
    while inner.size:
        at = sides.take(2 * at + (cells.take(feature.take(at) * n + rows.take(inner)) <= limit.take(at)))
        node[inner] = at
        more = np.flatnonzero(sides.take(2 * at) >= 0)
        inner, at = inner.take(more), at.take(more)
    return node


def _begun(block: Block, newest: list[Tree], round_: int, share: float, seed: int) -> Block:
    """The block as a round sees it: margins with the newest trees, the rows drawn and their gradients, a line for each tree."""
    margin = block["margin"].copy()
    whole = np.arange(len(margin))
    for k, tree in enumerate(newest):
        if len(tree.left) > 1 or tree.value[0]:
            margin[:, k] += np.asarray(tree.value)[ends(tree, block["bin"], whole)]
    own = np.flatnonzero(drawn(block["row"], round_, share, seed)) if share < 1 else whole
    g, h = gradients(margin[own], block["y"][own], block["w"][own])
    return {**block, "margin": margin, "g": np.ascontiguousarray(g.T), "h": np.ascontiguousarray(h.T), "own": own.astype(np.min_scalar_type(len(whole)))}


def draws(row: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """A hash of number, round and seed, from 0 to 1."""
    salt = np.uint64((seed * 1_000_003 + round_ + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    h = (row + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ salt
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def drawn(row: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Whether a round sees the rows of these numbers: their draw is below the share."""
    return draws(row, round_, seed) < share


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by each margin."""
    p = _probabilities(margin, 2)[:, 1:] if margin.shape[1] == 1 else _probabilities(margin, margin.shape[1])
    truth = (y[:, None] == (1 if margin.shape[1] == 1 else np.arange(margin.shape[1]))).astype(float)
    return (p - truth) * w[:, None], np.maximum(p * (1 - p), 1e-16) * w[:, None]


def _histogram(block: Block, k: int, tree: Tree, counted: list[int], fetched: list[int], widths: dict[int, int]) -> tuple[np.ndarray, list[tuple]]:
    """Of tree ``k``: sums by counted node and cell, and the rows of fetched nodes, with the places of these in the list."""
    if not counted and not fetched:
        return np.zeros((0, sum(widths.values()), 3)), []
    bins, rows = block["bin"], block["own"].astype(np.int64)
    place = np.full(len(tree.left), -1)
    place[counted + fetched] = np.arange(len(counted) + len(fetched))
    at = place[ends(tree, bins, rows)]
    here = np.flatnonzero(at >= len(counted))
    some = [(at[here] - len(counted), bins[:, rows[here]], block["g"][k][here], block["h"][k][here])] if fetched else []
    here = np.flatnonzero((at >= 0) & (at < len(counted)))
    return _sums(bins, block["g"][k][here], block["h"][k][here], widths, at[here], len(counted), rows[here]), some


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, widths: dict[int, int], at: np.ndarray | None = None, nodes: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums by cell (the bins of each allowed feature in turn) of gradients, hessians and rows, also by node."""
    out, first = np.zeros((nodes or 1, sum(widths.values()), 3)), 0
    for f, width in widths.items():
        cell = bins[f] if rows is None else at * width + bins[f].take(rows)
        for j, values in enumerate((g, h, None)):
            out[:, first : first + width, j] = np.bincount(cell, values, len(out) * width).reshape(len(out), width)
        first += width
    return out[0] if nodes is None else out[:nodes]
