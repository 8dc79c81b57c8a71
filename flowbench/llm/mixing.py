"""Mixing overlapping sources to target weights as a minimum-cost flow over membership patterns.

A text belongs to every source that holds a copy of it; its pattern is that set of sources. Documents are counted by pattern and
own source. The flow routes words from patterns to the sources' targets: the first use of a text is free, further uses, of a
row or of its copies elsewhere, cost more and more. Rows are then selected in seeded order until each (pattern, source) has its words.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import word_count, written

# A row is taken this many times at most.
MOST = 3
WEIGHTS = (1, 2, 3)
# Ranges of the seeded order in which a cell's words are added up.
BUCKETS = 4096


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the total by weight, none above ``MOST`` times its source's size; the excess is shared again by weight."""
    total, goal, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        rest = total - sum(goal[i] for i in range(len(sizes)) if i not in open_)
        above = {i for i in open_ if rest * weights[i] / weight > MOST * sizes[i]}
        if not above:
            for i in open_:
                goal[i] = rest * weights[i] / weight
            break
        for i in above:
            goal[i] = float(MOST * sizes[i])
        open_ -= above
    return goal


class Flow:
    """Minimum-cost maximum flow by rising path cost; on the arcs of each cost, by blocking flows."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        rise = [0] * len(self.out)
        while True:
            far = self._distances(source, rise)
            if sink not in far:
                return
            most = max(far.values())
            rise = [p + far.get(i, most) for i, p in enumerate(rise)]
            while (level := self._levels(source, rise)).get(sink) is not None:
                ahead = [0] * len(self.out)
                while self._push(source, sink, level, ahead, rise):
                    pass

    def _distances(self, source: int, rise: list[int]) -> dict[int, int]:
        far, heap = {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in far:
                continue
            far[x] = d
            for e in self.out[x]:
                if self.room[e] and self.to[e] not in far:
                    heapq.heappush(heap, (d + self.cost[e] + rise[x] - rise[self.to[e]], self.to[e]))
        return far

    def _levels(self, source: int, rise: list[int]) -> dict[int, int]:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] and y not in level and self.cost[e] + rise[x] == rise[y]:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def _push(self, source: int, sink: int, level: dict[int, int], ahead: list[int], rise: list[int]) -> int:
        path, x = [], source
        while x != sink:
            while ahead[x] < len(self.out[x]):
                e = self.out[x][ahead[x]]
                y = self.to[e]
                if self.room[e] and level.get(y) == level[x] + 1 and self.cost[e] + rise[x] == rise[y]:
                    break
                ahead[x] += 1
            if ahead[x] < len(self.out[x]):
                path.append(self.out[x][ahead[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                ahead[x] += 1
            else:
                return 0
        least = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= least
            self.room[e ^ 1] += least
        return least


def route(cells: dict[tuple[int, int], tuple[int, int]], goals: list[int]) -> dict[tuple[int, int], int]:
    """Words to take from each cell (pattern, source), given its words and its pattern's distinct words.

    Taking a cell's rows for the k-th time costs k - 1 a word. Using a pattern's texts beyond once costs 1 a word, beyond twice 2,
    beyond four times 3, and so on: rising steps, so that the flow takes the cheap ones first.
    """
    patterns = sorted({p for p, _ in cells})
    volume, most = {}, defaultdict(int)
    for (p, _), (words, distinct) in cells.items():
        volume[p] = distinct
        most[p] += MOST * words
    node = {p: 2 + i for i, p in enumerate(patterns)}
    goal = {s: 2 + len(patterns) + s for s in range(len(goals))}
    flow = Flow(2 + len(patterns) + len(goals))
    for p in patterns:
        used, step, cost = 0, max(1, volume[p]), 0
        while used < most[p]:
            flow.arc(0, node[p], min(step, most[p] - used), cost)
            used, step, cost = used + step, max(step, used + step) if used else step, cost + 1
    arcs = {}
    for (p, s), (words, _) in sorted(cells.items()):
        arcs[p, s] = [flow.arc(node[p], goal[s], words, k) for k in range(MOST)]
    for s, words in enumerate(goals):
        flow.arc(goal[s], 1, words, 0)
    flow.run(0, 1)
    return {c: sum(flow.room[a ^ 1] for a in own) for c, own in arcs.items()}


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (words), ``source_size``, ``target`` (of its source), ``taken`` (words, repeats counted), ``row``.

    Sources in code-point order, null last, have the weights in turn and share all words by them (``targets``). ``taken`` is 0, 1, 2 or 3
    times the size; a source's taken words miss its target by less than one document, and by little where it has many. The choice
    depends on the seed, the ids, the sources and the texts; of rows with one id, the first read comes first. Null texts have size 0, null ids come first in seeded order; repeated rows are rows of
    their own, told apart by ``row`` (their place as read, or ``row_col``, a long that differs from row to row). Other columns are not returned. An empty table gives no row.
    Sources, and the different sets of sources that hold a text, must fit the driver; all sets go into the flow as they are, however many.
    """
    spark = docs.sparkSession
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), source.alias("source"), word_count(text).alias("size"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("same"),
            F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string")).alias("draw"),
            (F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")).alias("row"),
        ),
        "mix-rows",
    )
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, str(r["source"])))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    # One row for each source.
    listed = [(r["source"], i, sizes[i], wanted[i]) for i, r in enumerate(found)]
    kind = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame(listed, f"source {kind}, s int, source_size long, target double")
    rows = rows.alias("r").join(F.broadcast(sources).alias("s"), F.expr("r.source <=> s.source")).select("r.*", "s.s", "s.source_size", "s.target").drop("source")
    # The pattern of a text: the sources that hold it. Copies are merged before the shuffle.
    texts = rows.groupBy("same").agg(F.array_sort(F.collect_set("s")).alias("pattern"), F.first("size").alias("words"))
    texts = written(texts, "mix-texts")
    shapes = texts.groupBy("pattern").agg(F.sum("words").alias("distinct"))
    shapes = [(r["pattern"], i, r["distinct"]) for i, r in enumerate(sorted(shapes.collect(), key=lambda r: r["pattern"]))]
    patterns = spark.createDataFrame(shapes, "pattern array<int>, p int, distinct long")
    texts = texts.join(patterns, "pattern").select("same", "p", "distinct")
    rows = written(rows.join(texts, "same").drop("same").withColumn("bucket", F.shiftrightunsigned("draw", 52).cast("int")), "mix-cells")
    cells = {(r["p"], r["s"]): (r["words"], r["distinct"]) for r in rows.groupBy("p", "s").agg(F.sum("size").alias("words"), F.first("distinct").alias("distinct")).collect()}
    routed = route(cells, [round(t) for t in wanted])
    # Whole documents miss a cell's words a little; each source's largest cell makes up for what its other cells missed.
    largest: dict[int, tuple[int, int]] = {}
    for c in sorted(cells, key=lambda c: (-cells[c][0], c)):
        largest.setdefault(c[1], c)
    main = F.broadcast(spark.createDataFrame([(*c, True) for c in largest.values()], "p int, s int, main boolean"))  # one row for each source
    rows = rows.join(main, ["p", "s"], "left")
    others = written(_select(rows.where("main IS NULL"), {c: w for c, w in routed.items() if largest[c[1]] != c}, cells), "mix-others")
    got = {r["s"]: r["taken"] for r in others.groupBy("s").agg(F.sum("taken").alias("taken")).collect()}
    left = {c: min(MOST * cells[c][0], max(0, round(wanted[c[1]]) - got.get(c[1], 0))) for c in largest.values()}
    rows = others.unionByName(_select(rows.where("main"), left, cells))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "row")


def _select(rows: DataFrame, words: dict[tuple[int, int], int], cells: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Adds ``taken``: every row of a cell as often as its words allow, then rows in seeded order up to the rest, and last the one
    row whose size comes nearest to what is still missing, if it helps."""
    spark = rows.sparkSession
    plan = [(p, s, w // max(1, cells[p, s][0]), w % max(1, cells[p, s][0])) for (p, s), w in words.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "p int, s int, whole long, rest long"))  # a row for each cell
    # Words before each range of a cell's seeded order, then before each row of the one range in which the rest ends.
    ranges = rows.groupBy("p", "s", "bucket").agg(F.sum("size").alias("inside"))
    ranges = ranges.withColumn("before", F.expr("sum(inside) OVER (PARTITION BY p, s ORDER BY bucket) - inside"))
    ends = ranges.join(plan, ["p", "s"]).where("before < rest AND before + inside >= rest")
    ends = F.broadcast(ends.select("p", "s", F.col("bucket").alias("end"), "before"))  # at most one row for each cell
    placed = rows.join(plan, ["p", "s"]).join(ends, ["p", "s"], "left")
    sure = placed.where("end IS NULL OR bucket <> end").withColumn("more", F.expr("CASE WHEN bucket < end THEN 1 ELSE 0 END"))
    edge = placed.where("bucket = end").withColumn("until", F.expr("before + sum(size) OVER (PARTITION BY p, s ORDER BY draw, id, row ROWS UNBOUNDED PRECEDING)"))
    edge = edge.withColumn("more", F.expr("CASE WHEN until <= rest THEN 1 ELSE 0 END")).drop("until")
    rows = written(sure.unionByName(edge).drop("end", "before"), "mix-taken")
    gaps = rows.groupBy("p", "s").agg((F.first("rest") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
    spare = rows.where(f"more = 0 AND whole < {MOST} AND size > 0").join(F.broadcast(gaps.where("gap > 0")), ["p", "s"])
    spare = spare.where("abs(size - gap) < gap").groupBy("p", "s").agg(F.min_by("row", F.struct(F.abs(F.col("size") - F.col("gap")), "draw", "row")).alias("row"))
    rows = rows.join(F.broadcast(spare.select("row", F.lit(1).alias("last"))), "row", "left")  # at most one row for each cell
    times = F.least(F.col("whole") + F.col("more") + F.coalesce("last", F.lit(0)), F.lit(MOST))
    return rows.withColumn("taken", F.col("size") * times).drop("whole", "rest", "more", "last")
