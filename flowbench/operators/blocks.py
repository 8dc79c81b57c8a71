"""Training rows as matrices that stay on the executors; a fitting step sums an array function over them.

For fits whose steps are matrix arithmetic on all rows (histograms, gradients). Only sums whose size follows from the model come to
the driver, added up in stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.session import checkpoint

# Tables smaller than this many rows a task are put into fewer tasks.
ROWS_A_TASK = 20_000
# Rows of a task are put together into blocks of at most so many.
ROWS_A_BLOCK = 50_000

Block = dict[str, np.ndarray]


class Blocks:
    """A table as blocks: ``x`` (rows by columns) and one array for each further column, of 64-bit floats unless ``x`` is asked for in 32.

    Built once from a checkpoint of the rows. ``updated`` gives blocks with changed arrays, written to the checkpoint folder as well, so
    that a lost executor costs the last update and not the whole history.
    """

    def __init__(self, rdd: RDD, rows: int):
        self.rdd, self.rows = rdd, rows

    @staticmethod
    def of(df: DataFrame, x: Sequence[Column] | Column, others: Mapping[str, Column], narrow: bool = False) -> "Blocks":
        """``x`` are the cells or a column with an array of them; ``narrow`` keeps them as 32-bit floats. No cell may be null."""
        names = list(others)
        kind = "<f4" if narrow else "<f8"

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = [batch.column("x").flatten(), *(batch.column(n) for n in names)]
                    blobs = [pa.array([c.to_numpy(zero_copy_only=False).astype(kind if i == 0 else "<f8").tobytes()]) for i, c in enumerate(cells)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *blobs], names=["n", "x", *names])

        cells = x if isinstance(x, Column) else F.array(*[c.cast("double") for c in x])
        rows = df.select(cells.alias("x"), *[c.cast("double").alias(n) for n, c in others.items()])
        kept = checkpoint(rows.mapInArrow(packed, ", ".join(["n long", "x binary", *[f"`{n}` binary" for n in names]])))
        total = kept.agg(F.sum("n")).first()[0] or 0
        few = max(1, -(-total // ROWS_A_TASK))
        if few < kept.rdd.getNumPartitions():
            kept = kept.coalesce(few)

        def together(rows: list) -> Block:
            block = {n: np.concatenate([np.frombuffer(r[n], "<f8") for r in rows]) for n in names}
            return {"x": np.concatenate([np.frombuffer(r["x"], kind).reshape(r["n"], -1) for r in rows]), **block}

        def matrices(rows: Iterator) -> Iterator[Block]:
            held, n = [], 0
            for row in rows:
                if held and n + row["n"] > ROWS_A_BLOCK:
                    yield together(held)
                    held, n = [], 0
                held.append(row)
                n += row["n"]
            if held:
                yield together(held)

        return Blocks(kept.rdd.mapPartitions(matrices).persist(StorageLevel.MEMORY_AND_DISK), total)

    def sums(self, fn: Callable[[Block], list[np.ndarray]], small: bool = False) -> list[np.ndarray]:
        """Sum over all blocks of the arrays that ``fn`` gives for one; every block gives arrays of the same shapes.

        ``small`` arrays, below a megabyte, are added up in one stage, unless there are very many tasks.
        """
        depth = 1 if small and self.rdd.getNumPartitions() <= 200 else 2
        return self.rdd.map(fn).treeReduce(lambda a, b: [u + v for u, v in zip(a, b)], depth)

    def updated(self, fn: Callable[[Block], Block]) -> "Blocks":
        """Blocks with the arrays that ``fn`` gives; the former ones are released."""
        changed = self.rdd.map(fn).persist(StorageLevel.MEMORY_AND_DISK)
        changed.checkpoint()
        changed.count()
        self.rdd.unpersist()
        return Blocks(changed, self.rows)

    def stepped(self, fn: Callable[[Block], Block], cut: bool) -> "Blocks":
        """As ``updated``, but computed with the next sum and only written if ``cut``; the caller releases the former blocks after that."""
        changed = self.rdd.map(fn).persist(StorageLevel.MEMORY_AND_DISK)
        if cut:
            changed.checkpoint()
        return Blocks(changed, self.rows)

    def release(self) -> None:
        self.rdd.unpersist()
