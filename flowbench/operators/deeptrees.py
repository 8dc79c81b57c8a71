"""Decision trees and forests without a limit of depth.

While a node holds many rows, its split is found from class histograms of the features drawn for it, summed over all rows: cells are coded once, and
blocks keep the rows that are still in open nodes and where they are. Once a node holds few rows, they come together in one task, which finishes the subtree on their exact values, however deep. The finished subtrees are a table: a model on very
many rows need not fit the driver. Scoring sends the subtrees to every task if their counted size allows it, and else deals rows
and subtrees out by node.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import finite_or
from flowbench.operators.blocks import Block, Blocks
from flowbench.operators.leafwise import _limits
from flowbench.operators.stumps import impurity
from flowbench.session import checkpoint, few_rows

# A node with at most so many rows is finished in one task.
SMALL = 20_000
# Nodes of all subtrees that are sent to every task; with more, rows and subtrees meet by node.
BROADCAST_NODES = 500_000
# Trees whose first nodes grow together.
TOGETHER = 25
# Cells of the histograms of one pass over the rows; nodes beyond that wait for a later pass.
CELLS = 4_000_000


@dataclass
class Part:
    """A tree or a part of one: a row goes left if its cell is at most ``limit``; ``left`` is -1 at an end, which holds the weights by class."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    weights: list[list[float]]

    def ends(self, x: np.ndarray) -> np.ndarray:
        feature, limit = np.asarray(self.feature), np.asarray(self.limit)
        sides = np.stack([self.right, self.left], axis=1).ravel()
        node, cells, width = np.zeros(len(x), np.int64), np.ascontiguousarray(x).ravel(), x.shape[1]
        inner = np.arange(len(x) if sides[0] >= 0 else 0)
        at = node[inner]
        while inner.size:
            at = sides.take(2 * at + (cells.take(inner * width + feature.take(at)) <= limit.take(at)))
            node[inner] = at
            more = np.flatnonzero(sides.take(2 * at) >= 0)
            inner, at = inner.take(more), at.take(more)
        return node

    def shares(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        w = np.asarray(self.weights)[ends]
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)

    def levels(self) -> np.ndarray:
        """By node, the splits above it."""
        out = np.zeros(len(self.left), np.int64)
        for i, left in enumerate(self.left):
            if left >= 0:
                out[[left, self.right[i]]] = out[i] + 1
        return out


def grafted(top: Part, parts: dict[int, Part]) -> Part:
    """One tree, as arrays: the finished parts in the place of the ends of ``top`` that they belong to."""
    own = [np.array(v) for v in (top.feature, top.limit, top.left, top.right, top.weights)]
    pieces, n = [own], len(top.left)
    for node, part in parts.items():
        feature, limit, left, right, weights = map(np.array, (part.feature, part.limit, part.left, part.right, part.weights))
        # Node 0 of the part is the end itself; the others follow behind.
        left, right = (np.where(left >= 0, v + n - 1, -1) for v in (left, right))
        for values, piece in zip(own, (feature, limit, left, right, weights)):
            values[node] = piece[0]
        pieces.append([v[1:] for v in (feature, limit, left, right, weights)])
        n += len(left) - 1
    return Part(*(np.concatenate(v) for v in zip(*pieces)))


def copies(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample holds the rows of these numbers: Poisson draws with mean 1 from a hash."""
    salt = np.uint64((seed * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    h = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ salt
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
    # Shares of a Poisson distribution with mean 1, added up.
    steps = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    out = np.zeros(len(u), np.int64)
    for step in steps:
        out += u >= step
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, columns: int, leaf: int, rng: np.random.Generator, depth: int | None = None) -> Part:
    """A whole tree on exact values: least Gini impurity over ``columns`` drawn features a node, until nodes are pure, cannot be split or are ``depth`` splits deep."""
    part = Part([], [], [], [], [])
    todo = [(np.arange(len(y)), -1, 0, 0)]
    while todo:
        own, parent, side, level = todo.pop()
        here = len(part.left)
        if parent >= 0:
            (part.left if side == 0 else part.right)[parent] = here
        whole = np.bincount(y[own], w[own], k)
        for values, new in ((part.feature, 0), (part.limit, 0.0), (part.left, -1), (part.right, -1), (part.weights, whole.tolist())):
            values.append(new)
        if (whole > 0).sum() < 2 or len(own) < 2 * leaf or level == depth:
            continue
        best = None
        # Features that are the same in all rows do not count as drawn.
        drawn = 0
        for f in rng.permutation(x.shape[1]).tolist():
            cells = x[own, f]
            by = np.argsort(cells, kind="stable")
            cells = cells[by]
            ends = np.flatnonzero(cells[1:] > cells[:-1])
            if not len(ends):
                continue
            drawn += 1
            ends = ends[(ends + 1 >= leaf) & (len(own) - ends - 1 >= leaf)]
            if len(ends):
                sums = np.zeros((len(own), k))
                sums[np.arange(len(own)), y[own][by]] = w[own][by]
                below = sums.cumsum(axis=0)[ends]
                value = impurity(below) + impurity(whole - below)
                at = int(np.argmin(value))
                found = (float(value[at]), f, (cells[ends[at]], cells[ends[at] + 1]))
                if best is None or found[:2] < best[:2]:
                    best = found
            if drawn >= columns:
                break
        if best is None:
            continue
        _, f, (low, high) = best
        limit = low + (high - low) / 2
        part.feature[here], part.limit[here] = f, float(limit if low <= limit < high else low)
        left = x[own, f] <= part.limit[here]
        todo += [(own[~left], here, 1, level + 1), (own[left], here, 0, level + 1)]
    return part


@dataclass
class FittedForest:
    kind: str
    features: list[str]
    classes: list[int]
    tops: list[Part]
    parts: DataFrame  # tree, node, nodes, depth, body
    nodes: int

    def depth(self) -> int:
        """Levels of the deepest subtree, those above it not counted."""
        return self.parts.agg(F.max("depth")).first()[0] or 0

    def score(self, df: DataFrame) -> DataFrame:
        """``prediction`` and ``probability`` of the larger class, or ``probabilities``: means of the trees' shares."""
        require_columns(df, self.features, numeric=True)
        return self._named(self.shared(df, F.array(*[finite_or(c).cast("double") for c in self.features])))

    def shared(self, df: DataFrame, cells: Column) -> DataFrame:
        """The rows with ``probabilities``, the mean shares by class, from an array of their cells."""
        return self._sent(df, cells) if self.nodes <= BROADCAST_NODES else self._dealt(df, cells)

    def _named(self, df: DataFrame) -> DataFrame:
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        out = df.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), best).cast("int"))
        if len(self.classes) == 2:
            out = out.withColumn("probability", F.col("probabilities")[1]).drop("probabilities")
        return out

    def _sent(self, df: DataFrame, cells: Column) -> DataFrame:
        # Counted: at most BROADCAST_NODES nodes.
        parts: list[dict[int, Part]] = [{} for _ in self.tops]
        for r in self.parts.select("tree", "node", "body").toLocalIterator():
            parts[r["tree"]][r["node"]] = Part(**json.loads(r["body"]))
        shared = df.sparkSession.sparkContext.broadcast(([grafted(top, own) for top, own in zip(self.tops, parts)], len(self.classes)))

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees, k = shared.value
            for cells in batches:
                x = np.stack(cells.to_numpy()) if len(cells) else np.empty((0, 1))
                total = np.zeros((len(x), k))
                for tree in trees:
                    total += tree.shares(x, tree.ends(x))
                yield pd.Series(list(total / len(trees)))

        return df.withColumn("probabilities", shares(cells))

    def _dealt(self, df: DataFrame, cells: Column) -> DataFrame:
        """Rows travel to the subtrees of the nodes they fall into, one row a tree; shares return and are added up."""
        rows = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
        tops, k, n = self.tops, len(self.classes), len(self.tops)

        def fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for tree, top in enumerate(tops):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(top.ends(x)), batch.column("_row"), batch.column("x")], names=["tree", "node", "row", "x"])

        dealt = rows.select("_row", cells.alias("x")).mapInArrow(fallen, "tree int, node long, row long, x array<double>")

        def finish(own: pa.Table, parts: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.table({"row": pa.array([], pa.int64()), "shares": pa.array([], pa.list_(pa.float64()))})
            x = own.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            tree, node = own.column("tree")[0].as_py(), own.column("node")[0].as_py()
            if parts.num_rows:
                part = Part(**json.loads(parts.column("body")[0].as_py()))
                shares = part.shares(x, part.ends(x))
            else:
                shares = tops[tree].shares(x, np.full(len(x), node))
            return pa.table({"row": own.column("row"), "shares": pa.array(list(shares), pa.list_(pa.float64()))})

        # Rows of one node are cut up by their number, so that a node with very many rows is not one group.
        cut = F.pmod(F.xxhash64("row"), F.lit(64)).cast("int")
        parts = self.parts.select("tree", "node", "body").withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(63))))
        found = dealt.withColumn("cut", cut).groupBy("tree", "node", "cut").cogroup(parts.groupBy("tree", "node", "cut")).applyInArrow(finish, "row long, shares array<double>")
        sums = found.groupBy("row").agg(F.array(*[F.sum(F.col("shares")[i]) / n for i in range(k)]).alias("probabilities"))
        return rows.join(sums, rows["_row"] == sums["row"]).drop("_row", "row")


@dataclass
class DeepForest:
    """``trees`` trees on samples drawn with repetition (one tree: on the rows as they are), ``columns`` features drawn a node ("sqrt" or None for all).

    A node is split as long as it is impure, both sides keep ``leaf`` rows, and its rows differ; ``depth`` (None: no bound) bounds the splits above it.
    ``balanced`` weighs classes alike.
    """

    trees: int = 200
    columns: str | None = "sqrt"
    balanced: bool = True
    leaf: int = 1
    depth: int | None = None
    seed: int = 42
    name: str = "deep_forest"

    @staticmethod
    def one(**settings) -> "DeepForest":
        """A single tree on all features."""
        return DeepForest(**{"trees": 1, "columns": None, "name": "deep_tree", **settings})

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> FittedForest:
        features = list(require_columns(train, features, numeric=True))
        y = F.col(label).cast("int")
        clean = train.select(F.array(*[finite_or(c).cast("double") for c in features]).alias("x"), y.alias("y"), F.monotonically_increasing_id().alias("row"))
        columns = len(features) if self.columns is None else max(1, int(len(features) ** 0.5))
        return self.grown(clean, features, columns)

    def grown(self, clean: DataFrame, features: list[str], columns: int, weights: dict[int, float] | None = None) -> FittedForest:
        """The forest of rows with an array of cells ``x``, a class ``y`` and a number ``row``; ``weights`` by class take the place of ``balanced``."""
        clean = checkpoint(clean)
        tallies = {r["y"]: r["n"] for r in few_rows(clean.groupBy("y").agg(F.count("*").alias("n")), "classes")}
        if not tallies:
            raise ValueError("the training table is empty")
        classes, total = sorted(tallies), sum(tallies.values())
        k = len(classes)
        weights = weights or {c: total / (k * tallies[c]) if self.balanced else 1.0 for c in classes}
        weight = np.array([weights[c] for c in classes])
        tops = self._tops(clean, features, classes, weight, columns, total)
        fallen = clean.mapInArrow(self._fallen(tops, classes), "tree int, node long, x array<double>, y int, times int")
        seed, leaf, depth = self.seed, self.leaf, self.depth
        levels = [top.levels() for top in tops]

        def finish(own: pa.Table) -> pa.Table:
            x = own.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            tree, node = own.column("tree")[0].as_py(), own.column("node")[0].as_py()
            y, times = own.column("y").to_numpy(), own.column("times").to_numpy()
            # The same tree wherever the rows come from.
            by = np.lexsort((times, y, *x.T))
            left = None if depth is None else depth - int(levels[tree][node])
            part = grow(x[by], y[by], (weight[y] * times)[by], k, columns, leaf, np.random.default_rng([seed, tree, node]), left)
            return pa.table({"tree": own.column("tree")[:1], "node": own.column("node")[:1], "nodes": [len(part.left)], "depth": [int(part.levels().max())], "body": [json.dumps(asdict(part))]})

        parts = checkpoint(fallen.groupBy("tree", "node").applyInArrow(finish, "tree int, node long, nodes long, depth long, body string"))
        return FittedForest(self.name, features, classes, tops, parts, parts.agg(F.sum("nodes")).first()[0] or 0)

    def _fallen(self, tops: list[Part], classes: list[int]):
        """Rows with the trees and nodes that they help to finish."""
        seed, sample, names = self.seed, self.trees > 1, np.array(classes)
        # A node at the bound of depth stays as it is.
        unfinished = [np.array([len(w) == 0 or sum(v > 0 for v in w) > 1 for w in top.weights]) for top in tops]
        if self.depth is not None:
            unfinished = [own & (top.levels() < self.depth) for own, top in zip(unfinished, tops)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                row, y = batch.column("row").to_numpy(), np.searchsorted(names, batch.column("y").to_numpy()).astype(np.int32)
                for tree, top in enumerate(tops):
                    ends = top.ends(x)
                    own = np.flatnonzero(unfinished[tree][ends])
                    times = copies(row[own], tree, seed) if sample else np.ones(len(own), np.int64)
                    own, times = own[times > 0], times[times > 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), tree, np.int32)), pa.array(ends[own]), batch.column("x").take(pa.array(own)), pa.array(y[own]), pa.array(times.astype(np.int32))],
                        names=["tree", "node", "x", "y", "times"],
                    )

        return run

    def _tops(self, clean: DataFrame, features: list[str], classes: list[int], weight: np.ndarray, columns: int, total: int) -> list[Part]:
        """The trees as far as nodes hold more than SMALL rows; ends of several classes are finished later."""
        k = len(classes)
        roots = lambda: Part([0], [0.0], [-1], [-1], [[1.0] * max(k, 1)])
        tops = [roots() for _ in range(self.trees)]
        if (total <= SMALL and self.depth != 0) or k < 2:
            return tops
        wide = clean.select(*[F.col("x")[i].alias(f"_f{i}") for i in range(len(features))], "y", "row")
        limits = [np.array(v) for v in _limits(wide, len(features), 255)]
        code = F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(classes)])
        raw = Blocks.of(wide, [F.col(f"_f{i}") for i in range(len(features))], {"y": code, "row": F.col("row")})
        binned = raw.updated(lambda b: _binned(b, limits))
        try:
            for first in range(0, self.trees, TOGETHER):
                self._grow_tops(binned, {t: tops[t] for t in range(first, min(first + TOGETHER, self.trees))}, limits, weight, columns)
        finally:
            binned.release()
        return tops

    def _grow_tops(self, binned: Blocks, tops: dict[int, Part], limits: list[np.ndarray], weight: np.ndarray, columns: int) -> None:
        """Grows the first nodes of some trees, a level or a further draw of features in a pass over the rows in open nodes."""
        k, width = len(weight), max(map(len, limits)) + 1
        # One feature more than are wanted saves the pass for those that turn out not to be usable.
        slots = min(columns + 1, len(limits))
        sample, seed = self.trees > 1, self.seed
        open_ = {t: [self._opened(t, 0, set(), len(limits))] for t in tops}
        now, before = binned.stepped(lambda b: _sampled(b, list(tops), sample, seed), cut=False), None
        try:
            while open_:
                most = max(1, CELLS // (slots * width * k * len(open_)))
                drawn = {t: np.array([(o.order + [-1] * slots)[:slots] for o in some[:most]]) for t, some in open_.items()}
                found = now.sums(lambda b: [_class_histogram(b, t, own, width, k) for t, own in drawn.items()])
                if before is not None:
                    before.release()
                steps = {}
                for (t, some), tables in zip(list(open_.items()), found):
                    more, after, step = [], [], np.empty((4, len(some)), np.int64)
                    for place, own in enumerate(some):
                        if place < len(tables) and self._weighed(tops[t], own, tables[place], limits, weight, columns):
                            step[:, place] = self._split(t, tops[t], own, weight, after, len(limits))
                        else:
                            # All rows stay where they are, for a pass over further features.
                            step[:, place] = 0, width, len(more), len(more)
                            more.append(own)
                    # Places of new nodes are behind those that stay.
                    step[2:] = np.where(step[2:] <= -2, len(more) - 2 - step[2:], step[2:])
                    open_[t] = more + after
                    if open_[t]:
                        steps[t] = step
                open_ = {t: some for t, some in open_.items() if some}
                if open_:
                    before, now = now, now.stepped(lambda b, steps=steps: _moved(b, steps), cut=False)
        finally:
            now.release()
            if before is not None:
                before.release()

    def _opened(self, tree: int, node: int, dead: set[int], features: int, level: int = 0) -> "_Open":
        order = np.random.default_rng([self.seed, tree, node]).permutation(features).tolist()
        return _Open(node, [f for f in order if f not in dead], set(dead), level)

    def _weighed(self, top: Part, own: "_Open", table: np.ndarray, limits: list[np.ndarray], weight: np.ndarray, columns: int) -> bool:
        """Takes the class counts (slot, bin, class) of the features asked for; whether the node's split is settled."""
        own.counts = counts = table[0].sum(axis=0)
        top.weights[own.node] = (counts * weight).tolist()
        if counts.sum() <= SMALL or (counts > 0).sum() < 2:
            return True
        for slot in range(min(len(table), len(own.order))):
            f = own.order.pop(0)
            below = table[slot].cumsum(axis=0)[: len(limits[f])]
            rows = below.sum(axis=1)
            usable = np.flatnonzero((rows >= self.leaf) & (counts.sum() - rows >= self.leaf))
            if not len(usable):
                # Nor can it be usable further down.
                own.dead.add(f)
                continue
            own.drawn += 1
            value = impurity(below[usable] * weight) + impurity((counts - below[usable]) * weight)
            at = int(np.argmin(value))
            if own.best is None or (float(value[at]), f) < own.best[:2]:
                own.best = (float(value[at]), f, int(usable[at]), below[usable[at]], float(limits[f][usable[at]]))
            if own.drawn >= columns:
                return True
        return not own.order

    def _split(self, tree: int, top: Part, own: "_Open", weight: np.ndarray, after: list["_Open"], features: int) -> tuple[int, int, int, int]:
        """Splits a settled node; children that still hold many rows come to ``after``. Gives feature, bin and where the rows of both sides go:
        -2 and below count the nodes in ``after``, -1 is nowhere."""
        if own.best is None or own.level == self.depth:
            return 0, 0, -1, -1
        _, f, at, below, limit = own.best
        top.feature[own.node], top.limit[own.node] = f, limit
        top.left[own.node], top.right[own.node] = len(top.left), len(top.left) + 1
        sides = []
        for counts in (below, own.counts - below):
            sides.append(-1)
            if counts.sum() > SMALL and (counts > 0).sum() > 1 and own.level + 1 != self.depth:
                sides[-1] = -2 - len(after)
                after.append(self._opened(tree, len(top.left), own.dead, features, own.level + 1))
            for values, new in ((top.feature, 0), (top.limit, 0.0), (top.left, -1), (top.right, -1), (top.weights, (counts * weight).tolist())):
                values.append(new)
        return f, at, *sides


@dataclass
class _Open:
    """A node that is still to be split: the features to draw next, those that no node below can use, and the best split so far."""

    node: int
    order: list[int]
    dead: set[int]
    level: int = 0
    drawn: int = 0
    best: tuple | None = None
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _binned(block: Block, limits: list[np.ndarray]) -> Block:
    """``bin`` (a line for each feature: the smallest bin whose limit is at least the cell), class and number of each row."""
    kind = np.uint8 if max(map(len, limits)) < 256 else np.uint16
    bins = np.stack([np.searchsorted(edges, block["x"][:, f], "left").astype(kind) for f, edges in enumerate(limits)])
    return {"bin": bins, "y": block["y"].astype(np.int16), "row": block["row"].astype(np.uint64)}


def _sampled(block: Block, trees: list[int], sample: bool, seed: int) -> Block:
    """The rows that each tree's sample holds, how often, and their place among the tree's open nodes: the root."""
    out = {"bin": block["bin"], "y": block["y"]}
    for t in trees:
        times = copies(block["row"], t, seed) if sample else np.ones(len(block["y"]), np.int64)
        rows = np.flatnonzero(times)
        # Numbers in as few bytes as they need: what a pass costs is mostly to move them.
        out |= {f"rows{t}": rows.astype(np.min_scalar_type(len(times))), f"times{t}": times[rows].astype(np.uint8), f"at{t}": np.zeros(len(rows), np.uint8)}
    return out


def _moved(block: Block, steps: dict[int, np.ndarray]) -> Block:
    """Rows go to the open nodes below theirs; rows that come into no open node are left out, and so are trees without steps."""
    out = {"bin": block["bin"], "y": block["y"]}
    for t, step in steps.items():
        rows = block[f"rows{t}"]
        feature, limit, left, right = step[:, block[f"at{t}"]]
        at = np.where(block["bin"][feature, rows] <= limit, left, right)
        kept = np.flatnonzero(at >= 0)
        out |= {f"rows{t}": rows[kept], f"times{t}": block[f"times{t}"][kept], f"at{t}": at[kept].astype(np.min_scalar_type(step.shape[1] * 2))}
    return out


def _class_histogram(block: Block, tree: int, drawn: np.ndarray, width: int, k: int) -> np.ndarray:
    """Rows by open node, slot of its drawn features, bin and class."""
    nodes, slots = drawn.shape
    at, rows, times = (block[f"{n}{tree}"] for n in ("at", "rows", "times"))
    if len(at) and at.max() >= nodes:
        own = np.flatnonzero(at < nodes)
        at, rows, times = at[own], rows[own], times[own]
    at, rows, y, times = at.astype(np.int64), rows.astype(np.int64), block["y"][rows], times.astype(np.float64)
    out = np.zeros((nodes, slots, width, k))
    bins, n, first = block["bin"].ravel(), block["bin"].shape[1], at * (width * k) + y
    for slot in range(slots):
        # A slot without a feature takes the first one and is not looked at.
        cell = bins.take(np.maximum(drawn[:, slot], 0).take(at) * n + rows).astype(np.int64)
        cell *= k
        cell += first
        out[:, slot] = np.bincount(cell, times, nodes * width * k).reshape(nodes, width, k)
    return out
