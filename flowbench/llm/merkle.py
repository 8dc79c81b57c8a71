"""A manifest of a table as hash trees, stored in blocks whose nodes lie in van Emde Boas order.

Every row is a leaf of the tree of its group; a node is the hash of up to eight nodes below it. A tree is cut into aligned
subtrees of four levels above 4,096 leaves (a block). Inside a block the nodes are laid out by splitting the levels in half again and
again: the upper half first, then each subtree of the lower half as one run of bytes. A node's place follows from its depth and
number by arithmetic alone, when the block is built and when siblings are looked up, whatever the size of a cache line or page.
The roots of the blocks are the leaves of the next band of blocks, until a tree has one block; the trees' roots, in order, are
the leaves of the top tree, which is stored the same way.

A task holds one block at a time. A tree with very many leaves is many blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import written

# Bits of a node's number that name it among its siblings: eight nodes have one parent.
FAN_BITS = 3
FAN = 1 << FAN_BITS
# Levels of a block above its leaves, and the leaves of a full block.
HEIGHT = 4
LEAVES = FAN**HEIGHT
_DIGEST = 32
_TOP = ""


def row_hash(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of the values in order, each as ``-`` if null and else as its UTF-8 byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def subtree_size(levels: int) -> int:
    """Nodes of a full subtree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place, in van Emde Boas order, of the nodes numbered ``index`` at ``depth`` (the root's is 0) of a subtree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower = levels - upper
    below = FAN_BITS * (depth - upper)
    return subtree_size(upper) + (index >> below) * subtree_size(lower) + address(lower, depth - upper, index & ((1 << below) - 1))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``tree``, ``rank``, ``block``, ``leaf`` (32 bytes), ``claim`` and the carried columns. ``bands``: the blocks over the leaves, over those
    blocks' roots and so on (``tree``, ``block``, ``n`` leaves of the tree in this band, ``height``, ``nodes``, ``root``); ``trees``: ``tree``,
    ``subroot`` (32 bytes) and ``rank`` of every tree; ``top``: the bands over these."""

    leaves: DataFrame
    bands: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]

    def root(self) -> str | None:
        """The root as lowercase hex; None for an empty table."""
        found = _finished(self.top).first()
        return found["subroot"].hex() if found else None


def build(docs: DataFrame, leaf: Column, tree: Column, order: Column, claim: Column | None = None, carry: tuple[str, ...] = ()) -> Manifest:
    """Trees over all rows: one for each value of ``tree`` (null first, then by the bytes of its text), leaves in the order of ``order`` (null first).

    ``leaf`` is a row's hash in lowercase hex; ``claim`` is another hash to be checked in its place (null: the leaf itself). Rows that tie
    are ordered by leaf; repeated rows are equal leaves side by side. ``carry`` names columns that the leaves keep, under their own names
    in a struct ``carried``, so that no name can clash. An empty table has no tree and no root.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    own = docs.select(
        # A prefix tells a null from a text and sorts it first.
        F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-")).alias("tree"),
        order.alias("place"),
        F.unhex(leaf).alias("leaf"),
        F.unhex(F.nullif(claim, leaf) if claim is not None else F.lit(None).cast("string")).alias("claim"),
        kept.alias("carried"),
    )
    # Written before they are dealt out: finding the ranges reads them twice.
    leaves = _ranked(written(own, "leaves"), "tree", "place", "leaf")
    leaves = written(leaves.withColumn("block", F.shiftright("rank", FAN_BITS * HEIGHT)).drop("place"), "ranked")
    bands = _bands(leaves.select("tree", "rank", "leaf", "n"))
    subroots = _finished(bands).select(F.lit(_TOP).alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("leaf"))
    trees = written(_ranked(subroots, "tree", "place", "leaf"), "trees")
    top = _bands(trees.select("tree", "rank", "leaf", "n"))
    return Manifest(leaves, bands, trees.select(F.col("place").alias("tree"), F.col("leaf").alias("subroot"), "rank"), top)


def _ranked(rows: DataFrame, tree: str, place: str, leaf: str) -> DataFrame:
    """Adds each row's ``rank`` in its tree, from 0, and the tree's number of leaves ``n``.

    Rows are sorted by ranges. Only the counts of each tree in each range meet in a window, at most one row for each range.
    """
    salted = rows.withColumn("row", F.monotonically_increasing_id())  # repeated rows can be cut into several ranges
    keys = [F.col(tree), F.col(place).asc_nulls_first(), F.col(leaf), F.col("row")]
    # The upper bits of the id are the number of the range, the lower ones count its rows in order.
    dealt = written(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("row"), "sorted")
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    starts = dealt.groupBy(tree, "range").agg(F.min("at").alias("first"), F.count("*").alias("own")).select(
        F.col(tree), "range", "first",
        F.expr(f"sum(own) OVER (PARTITION BY `{tree}` ORDER BY range) - own").alias("before"),
        F.expr(f"sum(own) OVER (PARTITION BY `{tree}`)").alias("n"),
    )
    return dealt.join(starts, [tree, "range"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def _bands(leaves: DataFrame) -> list[DataFrame]:
    """Bands of blocks, the lowest first; each is written."""
    bands = []
    while True:
        grouped = leaves.withColumn("block", F.shiftright("rank", FAN_BITS * HEIGHT)).groupBy("tree", "block")
        band = written(grouped.applyInArrow(_block, "tree string, block long, n long, height int, nodes binary, root binary"), "blocks")
        bands.append(band)
        more = band.where(F.col("n") > LEAVES)
        if more.isEmpty():
            return bands
        leaves = more.select("tree", F.col("block").alias("rank"), F.col("root").alias("leaf"), F.ceil(F.col("n") / LEAVES).cast("long").alias("n"))


def _finished(bands: list[DataFrame]) -> DataFrame:
    """Root of every tree: that of its only block in some band."""
    found = [b.where(F.col("n") <= LEAVES).select("tree", F.col("root").alias("subroot")) for b in bands]
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def _height(n: int) -> int:
    """Levels above the leaves of a block in a tree (or band) of ``n`` leaves."""
    height = 0
    while height < HEIGHT and FAN**height < n:
        height += 1
    return height


def _hash(run: bytes) -> bytes:
    return hashlib.sha256(run.hex().encode()).digest()


def _block(rows: pa.Table) -> pa.Table:
    """The nodes of a block, each put where its address says."""
    order = np.argsort(rows.column("rank").to_numpy())
    column = rows.column("leaf").to_pylist()
    level = [column[i] for i in order]
    n = rows.column("n")[0].as_py()
    height = _height(n)
    nodes = np.zeros((subtree_size(height + 1), _DIGEST), np.uint8)
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, _DIGEST)
        if depth:
            level = [_hash(b"".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]
    return pa.table({"tree": rows.column("tree")[:1], "block": rows.column("block")[:1], "n": pa.array([n], pa.int64()), "height": pa.array([height], pa.int32()), "nodes": [nodes.tobytes()], "root": [level[0]]})


def _runs(nodes: bytes, height: int, leaves: int) -> list[list[str]]:
    """For each level, the leaves' first, the runs of siblings as hex text, read back through the addresses."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, _DIGEST)
    found, n = [], leaves
    for depth in range(height, 0, -1):
        text = table[address(height + 1, depth, np.arange(n))].tobytes().hex()
        width = 2 * _DIGEST * FAN
        found.append([text[i : i + width] for i in range(0, len(text), width)])
        n = -(-n // FAN)
    return found


def _path(runs: list[list[str]], i: int) -> list[tuple[int, str]]:
    """A leaf's place in its run and the run, level by level."""
    return [((i >> FAN_BITS * k) % FAN, level[i >> FAN_BITS * (k + 1)]) for k, level in enumerate(runs)]


def _packed(path: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([own, len(run) // (2 * _DIGEST)]) + bytes.fromhex(run) for own, run in path)


def _unpacked(path: bytes) -> list[tuple[int, str]]:
    found, at = [], 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        found.append((own, path[at + 2 : at + 2 + n * _DIGEST].hex()))
        at += 2 + n * _DIGEST
    return found


def _leaves_in(n: int, block: int) -> int:
    return min(LEAVES, n - block * LEAVES)


def _children(batches):
    """For every leaf of a block its path to the root, the block's own path included."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            runs = _runs(row["nodes"], row["height"], leaves := _leaves_in(row["n"], row["block"]))
            above = row["above"] or b""
            out += [(row["tree"], row["block"] * LEAVES + i, _packed(_path(runs, i)) + above) for i in range(leaves)]
        columns = zip(*out) if out else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "rank", "path"])


def _down(bands: list[DataFrame], top: DataFrame) -> DataFrame:
    """Blocks of the lowest band with ``above``, their path to the root. ``top``: ``tree`` and ``above`` of every tree's root."""
    blocks = None
    for band in reversed(bands):
        whole = band.where(F.col("n") <= LEAVES).join(top, "tree", "left")
        if blocks is not None:
            # The next higher band's leaves are this band's blocks.
            paths = blocks.select("tree", "block", "n", "height", "nodes", "above").mapInArrow(_children, "tree string, rank long, path binary")
            paths = paths.select("tree", F.col("rank").alias("block"), F.col("path").alias("above"))
            whole = whole.unionByName(band.where(F.col("n") > LEAVES).join(paths, ["tree", "block"]))
        blocks = whole
    return blocks


def prove(manifest: Manifest) -> DataFrame:
    """Proof of every leaf, and the root that its claim leads to.

    ``carried``, ``tree``, ``rank``, ``leaf`` (hex), ``proof`` (hex digests of the siblings, level by level up to the root, from left to
    right, without a separator: ``rank`` and the counts of the trees say where each stands) and ``folded`` (hex: the claim, or else the
    leaf, hashed up with the stored siblings). One row for each row of the table; an empty one gives none.
    """
    spark = manifest.leaves.sparkSession
    none = spark.createDataFrame([(_TOP, b"")], "tree string, above binary")
    top = _down(manifest.top, none).mapInArrow(_children, "tree string, rank long, path binary")
    above = manifest.trees.join(top.select("rank", "path"), "rank").select("tree", F.col("path").alias("above"))
    blocks = written(_down(manifest.bands, above), "paths").select("tree", "block", "n", "height", "nodes", "above")
    leaves = manifest.leaves.select("tree", "block", "rank", "leaf", "claim", "carried")
    carried = leaves.schema["carried"].dataType.simpleString()
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
        _proofs, f"carried {carried}, tree string, rank long, leaf string, proof string, folded string"
    )


def _proofs(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
    block = blocks.to_pylist()[0]
    runs = _runs(block["nodes"], block["height"], _leaves_in(block["n"], block["block"]))
    above = _unpacked(block["above"] or b"")
    shared = "".join(run[: 64 * own] + run[64 * own + 64 :] for own, run in above)
    proofs, folded, texts = [], [], []
    for rank, leaf, claim in zip(*(leaves.column(c).to_pylist() for c in ("rank", "leaf", "claim"))):
        own_path = _path(runs, rank % LEAVES)
        now = (claim or leaf).hex()
        for own, run in (*own_path, *above):
            now = hashlib.sha256((run[: 64 * own] + now + run[64 * own + 64 :]).encode()).hexdigest()
        proofs.append("".join(run[: 64 * own] + run[64 * own + 64 :] for own, run in own_path) + shared)
        folded.append(now)
        texts.append(leaf.hex())
    whole = pa.table({"carried": leaves.column("carried"), "tree": leaves.column("tree"), "rank": leaves.column("rank"), "leaf": texts, "proof": proofs, "folded": folded})
    return pa.Table.from_batches(whole.to_batches(max_chunksize=512), whole.schema)
