"""Sharding by a minimax contiguous partition: the smallest capacity that fits, then cuts under it.

Equal texts stay together. Texts are ordered by a hash; a slot is a range of hashes, so it holds whole groups of equal
texts and is the atom that is never cut. There are ``SLOTS`` slots whatever the table's size, and their sizes are all that
the driver sees. The largest shard is the smallest possible for these atoms in this order.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import written

# Atoms; at least 1,000 for each shard are advisable.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
# A slot with more than this share of the rows is numbered in CELLS pieces.
HEAVY, CELLS = 1000, 256


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity under which greedy filling in order needs at most ``shards`` shards."""
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if _needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _needed(sizes: list[int], capacity: int) -> int:
    count, room = 1, capacity
    for s in sizes:
        if s > room:
            count, room = count + 1, capacity
        room -= s
    return count


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of every atom: contiguous, none above the smallest capacity, each near its share of what remains.

    Filling every shard to the capacity would leave the last ones short, so a shard ends where it comes nearest to an
    equal share of the rest, if what follows still fits the shards that are left.
    """
    capacity = smallest_capacity(sizes, shards)
    sums = [0, *accumulate(sizes)]
    # From the right: the first atom at which a shard may begin if so many shards are left.
    earliest, end = [], len(sizes)
    for _ in range(shards):
        while end > 0 and sums[earliest[-1] if earliest else len(sizes)] - sums[end - 1] <= capacity:
            end -= 1
        earliest.append(end)
    result, at = [], 0
    for shard in range(shards):
        left = shards - shard
        share, first = (sums[-1] - sums[at]) / left, at
        while at < len(sizes) and sums[at + 1] - sums[first] <= capacity:
            full = left == 1 or at < earliest[left - 2]
            if not full and sums[at + 1] - sums[first] - share > share - (sums[at] - sums[first]):
                break
            at += 1
        result += [shard] * (at - first)
    return result


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard`` (null).

    Shards have sizes as near as whole groups of equal texts allow. ``slot`` numbers the rows of a shard from 0 without a gap, by
    range of the text's hash (65,536), then a hash of the id, the text's hash and the id; the order of rows that agree in all, and of rows without an id, is free. A null text has size 8, the checksum of the
    empty text, and is equal to an empty one. Repeated rows are rows of their own. Other columns are not returned. An empty table gives no row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashed = F.xxhash64(text)
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            text_size(F.col(f"`{text_col}`")).alias("size"),
            F.crc32(text).alias("text_crc32"),
            hashed.alias("hash"),
            (F.shiftrightunsigned(hashed, 64 - SLOT_BITS)).cast("int").alias("atom"),
        ),
        "shard-rows",
    )
    spark = docs.sparkSession
    found = {r["atom"]: (r["size"], r["n"]) for r in rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toLocalIterator()}
    sizes = [found.get(a, (0, 0))[0] for a in range(SLOTS)]
    total = sum(n for _, n in found.values())
    heavy = [a for a, (_, n) in found.items() if n * HEAVY > total and n > HEAVY]  # fewer than HEAVY of them
    of_atom = cut(sizes, shards)
    # Rows of an atom are ordered by this at every size; only heavy atoms are cut up by it.
    rows = rows.withColumn("turn", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), F.lit(CELLS)).cast("int"))
    rows = rows.withColumn("cell", F.when(F.col("atom").isin(heavy), F.col("turn")).otherwise(0) if heavy else F.lit(0))
    counts = {(a, 0): n for a, (_, n) in found.items() if a not in set(heavy)}
    if heavy:
        split = rows.where(F.col("atom").isin(heavy)).groupBy("atom", "cell").count()
        counts |= {(r["atom"], r["cell"]): r["count"] for r in split.toLocalIterator()}
    offsets, last, next_slot = [], None, 0
    for key in sorted(counts):
        shard = of_atom[key[0]]
        if shard != last:
            last, next_slot = shard, 0
        offsets.append((*key, shard, next_slot))
        next_slot += counts[key]
    # At most SLOTS + HEAVY * CELLS rows, whatever the table's size.
    placed = spark.createDataFrame(offsets, "atom int, cell int, shard int, offset long")
    number = F.expr("row_number() OVER (PARTITION BY atom, cell ORDER BY turn, hash, id)")
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(placed), ["atom", "cell"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("number") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
