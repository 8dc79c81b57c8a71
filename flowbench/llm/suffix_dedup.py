"""Removal of byte strings that the corpus holds twice, by suffixes sorted with prefix hashes.

A byte goes if a string of ``width`` bytes covers it that starts anywhere else, too. Not every suffix has to be sorted for that:

1. Every window of ``width`` bytes is named after its smallest seed (by hash; the leftmost of equal ones). Equal windows have equal
   seeds at equal distances, so only windows of equal seeds can be equal. About one position in 85 is the seed of a window. A
   *place* is such a position with the range of distances to its windows; its *context* is all that these windows cover.
2. Seeds that occur once are dropped. Places of equal seed and context are a class: if it has several, all their windows repeat.
3. Where a seed has several classes, one context of each is fetched. The contexts' suffixes from the seed on are sorted, and so are
   their reversed prefixes before it: a mergesort in which two suffixes are compared by a binary search for their common extension over
   prefix polynomial hashes. The bytes of neighbours in the result are compared, so a collision is found and sorted again with another
   base. Runs of neighbours with long enough common extensions on both sides are the equal windows, for every distance.
4. A seed of very many classes is cut up: its windows are dealt out by a 128-bit hash of their bytes, whose equality counts as theirs.

Texts are written once to a table bucketed by block and are never shuffled; places and spans travel to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm.common import written
from flowbench.session import shared_folder

WIDTH = 200
SEED = 32
# Bytes of a block's texts, and its documents at most. A longer document is a block of its own.
BLOCK_BYTES = 8_000_000
BLOCK_DOCS = 1 << 16
# Windows that are hashed at once; fewer than two million positions, so that a position fits the low bits of a key.
PIECE = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
# Classes of a seed that are sorted in one task; with more, the seed's windows are dealt out by hash.
SORTED_CLASSES = 4096
# Contexts that are sorted together.
CHUNK = 8192
ROWS_AT_ONCE = 512

_PLACE = "array<struct<pos:int,far:short,near:short,seed:long,hi:long,lo:long>>"


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary, the bytes that stay).

    Texts are taken as UTF-8; a null text counts as empty. Strings never cross documents; overlaps of a string with itself count, and so
    do copies in the same document. Texts shorter than ``width`` keep all bytes. Repeated rows and null ids give a row each and count as
    different documents. Other columns are not returned, whatever their names. An empty table gives no row.
    """
    spark = docs.sparkSession
    if not 1 <= seed <= width <= 0x7FFF:
        raise ValueError("the seed must not be longer than the string, nor that longer than 32,767 bytes")
    texts = _block_table(spark, docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), width, seed)
    places = texts.select("block", "doc", F.inline("places"))
    # Written, so that both sides of the join are plain exchanges: a seed with very many places is split there.
    repeated = written(places.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "seeds")
    places = written(places.join(repeated, "seed", "left_semi"), "places")
    classes = places.groupBy("seed", "hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("block", "doc", "pos", "far", "near")).alias("first"))
    classes = written(classes, "classes")
    mixed = classes.groupBy("seed").agg(F.count("*").alias("classes")).where("classes > 1")
    asked = classes.join(mixed, "seed").select("seed", "classes", F.col("n").alias("times"), "first.*")
    contexts = written(_fetched(texts, asked, width), "contexts")
    spans = _whole(places, classes, width).union(_sorted(contexts, width)).union(_dealt(contexts, width))
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.select("block", "doc", "id", "text").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        _cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.withColumnRenamed("id", id_col)


def _block_table(spark: SparkSession, plain: DataFrame, width: int, seed: int) -> DataFrame:
    """``block``, ``doc`` (number in the block), ``id``, ``text`` and ``places`` of every document, bucketed by block."""
    kind = plain.schema["id"].dataType.simpleString()
    name, buckets = f"repeat_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = plain.mapInArrow(_places(width, seed), f"block long, doc int, id {kind}, text string, places {_PLACE}")
    # A task writes a file for each of its blocks.
    found.write.bucketBy(buckets, "block").option("path", shared_folder(spark, "repeat-blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class _Hash:
    """Polynomial hashes modulo 2**64 of slices of a byte array, from sums over its prefixes; bytes are random odd numbers."""

    def __init__(self, data: np.ndarray, attempt: int = 0):
        rng = np.random.default_rng(11 + attempt)
        table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 60)) * 8 + 5
        ones = lambda b: np.concatenate([[np.uint64(1)], np.full(len(data), b, np.uint64)]).cumprod(dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], (table[data] * ones(base)[:-1]).cumsum(dtype=np.uint64)])
        self.back = ones(pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _smallest_seeds(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest hash among ``span`` in a row, the leftmost of equal ones, for every start."""
    keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, span)
    # Smallest from a row's begin and to its end; a window is the end of one row and the begin of the next.
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - span + 1
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _LOW).astype(np.int64)


def _places_of(pieces: list[tuple[int, int, memoryview]], width: int, seed: int) -> dict[str, np.ndarray]:
    """Places of some stretches of documents (document, offset, bytes), each of at least ``width`` bytes."""
    from xxhash import xxh3_128_digest

    data = b"".join(p for _, _, p in pieces)
    ends = np.cumsum([len(p) for _, _, p in pieces])
    begins = ends - [len(p) for _, _, p in pieces]
    hashed = _Hash(np.frombuffer(data, np.uint8))
    h = _mixed(hashed.of(np.arange(len(data) - seed + 1), seed))
    at = _smallest_seeds(h, width - seed + 1)
    whole = np.ones(len(at), bool)
    for end in ends[:-1].tolist():
        whole[end - width + 1 : end] = False  # these windows would cross into the next stretch
    start = np.flatnonzero(whole)
    at = at[start]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last, pos = start[new], start[np.concatenate([new[1:], [len(at)]]) - 1], at[new]
    far, near = pos - first, pos - last
    view = memoryview(data)
    # The distances are part of the context's name: equal classes have equal windows.
    names = b"".join(xxh3_128_digest(view[f : e], seed=w) for f, e, w in zip(first.tolist(), (last + width).tolist(), (far * 65536 + near).tolist()))
    own = np.searchsorted(begins, pos, "right") - 1
    docs, offsets = np.array([d for d, _, _ in pieces]), np.array([o for _, o, _ in pieces])
    pair = np.frombuffer(names, "<i8").reshape(-1, 2)
    return {"doc": docs[own], "pos": pos - begins[own] + offsets[own], "far": far, "near": near, "seed": h[pos].view(np.int64), "hi": pair[:, 0], "lo": pair[:, 1]}


def _places(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            ids, column = batch.column("id"), batch.column("text")
            for i in range(batch.num_rows):
                held.append((ids[i], column[i]))
                size += column[i].as_buffer().size
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield from _block_rows((task << 20) + serial, held, width, seed)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield from _block_rows((task << 20) + serial, held, width, seed)

    return run


def _block_rows(block: int, held: list, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    found, pieces, size = [], [], 0
    for doc, (_, text) in enumerate(held):
        whole = memoryview(text.as_buffer())
        for offset in range(0, len(whole) - width + 1, PIECE):
            pieces.append((doc, offset, whole[offset : offset + PIECE + width - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE // 2:
                found.append(_places_of(pieces, width, seed))
                pieces, size = [], 0
    if pieces:
        found.append(_places_of(pieces, width, seed))
    kinds = {"pos": pa.int32(), "far": pa.int16(), "near": pa.int16(), "seed": pa.int64(), "hi": pa.int64(), "lo": pa.int64()}
    joined = {k: np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in ("doc", *kinds)}
    bounds = np.searchsorted(joined["doc"], np.arange(len(held) + 1))
    places = pa.StructArray.from_arrays([pa.array(joined[k], kind) for k, kind in kinds.items()], names=list(kinds))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places)
    id_kind, text_kind = held[0][0].type, held[0][1].type
    for i in range(0, len(held), ROWS_AT_ONCE):
        own = held[i : i + ROWS_AT_ONCE]
        n = len(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * n, pa.int64()), pa.array(range(i, i + n), pa.int32()),
                pa.array([k.as_py() for k, _ in own], id_kind), pa.array([t.as_py() for _, t in own], text_kind), lists.slice(i, n),
            ],
            names=["block", "doc", "id", "text", "places"],
        )


def _fetched(texts: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The contexts' bytes (``body``), cut from the texts where these are."""

    def cut(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows or not docs.num_rows:
            return wanted.append_column("body", pa.array([b""] * wanted.num_rows, pa.binary()))
        column = docs.column("text").combine_chunks()
        where = {d: i for i, d in enumerate(docs.column("doc").to_pylist())}
        bodies, views = [], {}
        for doc, pos, far, near in zip(*(wanted.column(c).to_pylist() for c in ("doc", "pos", "far", "near"))):
            if doc not in views:
                views[doc] = memoryview(column[where[doc]].as_buffer())
            bodies.append(bytes(views[doc][pos - far : pos - near + width]))
        return wanted.append_column("body", pa.array(bodies, pa.binary()))

    names = ("seed", "classes", "times", "block", "doc", "pos", "far", "near")
    kinds = ", ".join(f"`{n}` {asked.schema[n].dataType.simpleString()}" for n in names)
    return texts.select("block", "doc", "text").groupBy("block").cogroup(asked.select(*names).groupBy("block")).applyInArrow(cut, f"{kinds}, body binary")


def _whole(places: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Spans of the places whose whole context occurs again."""
    several = classes.where("n > 1").select("seed", "hi", "lo")
    found = places.join(several, ["seed", "hi", "lo"])
    return found.select("block", "doc", (F.col("pos") - F.col("far")).alias("begin"), (F.col("pos") - F.col("near") + width).alias("end"))


def _sorted(contexts: DataFrame, width: int) -> DataFrame:
    """Spans of windows that several classes of a seed hold, by sorting the contexts of each seed."""
    few = contexts.where(F.col("classes") <= SORTED_CLASSES).repartition("seed").sortWithinPartitions("seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= CHUNK and row["seed"] != held[-1]["seed"]:
                    yield _spans_of(held, width)
                    held = []
                held.append(row)
        if held:
            yield _spans_of(held, width)

    return few.mapInArrow(run, "block long, doc int, begin int, end int")


def _spans_of(held: list[dict], width: int) -> pa.RecordBatch:
    far, near = (np.array([r[k] for r in held]) for k in ("far", "near"))
    seeds = np.array([r["seed"] for r in held])
    group = np.concatenate([[0], np.cumsum(seeds[1:] != seeds[:-1])])
    flags = repeated_windows(group, [r["body"] for r in held], far, near, width)
    flags[np.array([r["times"] for r in held]) > 1] = False  # found as a whole already
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    pos = np.array([r["pos"] for r in held])[rows]
    take = lambda k: np.array([r[k] for r in held])[rows]
    columns = [pa.array(take("block"), pa.int64()), pa.array(take("doc"), pa.int32()), pa.array(pos - high, pa.int32()), pa.array(pos - low + width, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "doc", "begin", "end"])


def repeated_windows(group: np.ndarray, bodies: list[bytes], far: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """For each context and distance, whether another context of the group has the window that begins so far before its seed.

    ``group`` numbers the contexts' seeds in order; a context holds ``far`` bytes before its seed and ``width - near`` bytes from there on.
    """
    right = [b[f:] for b, f in zip(bodies, far.tolist())]
    left = [b[:f][::-1] for b, f in zip(bodies, far.tolist())]
    sides = [sorted_suffixes(group, side) for side in (right, left)]
    flags = np.zeros((len(bodies), int(far.max()) + 1), bool)
    for distance in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= distance) & (distance <= far))
        if len(own) < 2:
            continue
        kinds = []
        for (order, shared), least in zip(sides, (width - distance, distance)):
            # Neighbours that share enough are one kind.
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(shared < least)
            kinds.append(kind[own])
        both = kinds[0] * (len(bodies) + 1) + kinds[1]
        by = np.argsort(both, kind="stable")
        equal = both[by][1:] == both[by][:-1]
        flags[own[by[1:][equal]], distance] = True
        flags[own[by[:-1][equal]], distance] = True
    return flags


def sorted_suffixes(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within each group, and the length each shares with the one before it (-1 for the first of a group).

    Mergesort of all groups at once; ``group`` ascends. A comparison is a binary search for the longest equal prefix, by hash. What
    the hashes say of neighbours in the result is checked byte by byte; after a collision another base is taken.
    """
    data = np.frombuffer(b"".join(strings) or b"\0", np.uint8)
    length = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(length) - length
    attempt = 0
    while True:
        hashed = _Hash(data, attempt)
        order = _merged(group, data, hashed, start, length)
        shared = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        x, y = order[same - 1], order[same]
        shared[same] = _common(hashed, start, length, x, y)
        if _certain(data, start, length, x, y, shared[same]):
            return order, shared
        attempt += 1


def _common(hashed: _Hash, start: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest equal prefix of strings ``x`` and ``y``, pair by pair."""
    low, high = np.zeros(len(x), np.int64), np.minimum(length[x], length[y])
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        equal = hashed.of(start[x[open_]], middle) == hashed.of(start[y[open_]], middle)
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)
    return low


def _compared(data: np.ndarray, hashed: _Hash, start: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Below, equal to or above zero as ``x`` sorts before, with or after ``y``; a prefix sorts first."""
    shared = _common(hashed, start, length, x, y)
    ended = (shared == length[x]) | (shared == length[y])
    byte = lambda i: data[np.minimum(start[i] + shared, len(data) - 1)].astype(np.int64)
    return np.where(ended, length[x] - length[y], byte(x) - byte(y))


def _merged(group: np.ndarray, data: np.ndarray, hashed: _Hash, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    n = len(group)
    first = np.searchsorted(group, group)
    size = np.searchsorted(group, group, "right") - first
    local = np.arange(n) - first
    order, run = np.arange(n), 1
    while run < size.max(initial=0):
        number = local // run
        other = (number ^ 1) * run  # where the run to merge with begins
        here = np.flatnonzero(other < size)
        x, own_left = order[here], number[here] % 2 == 0
        begin, low, high = first[here] + other[here], np.zeros(len(here), np.int64), np.minimum(run, size[here] - other[here])
        # How many of the other run go before each: of the left run also equal ones.
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = _compared(data, hashed, start, length, x[open_], order[begin[open_] + middle])
            before = np.where(own_left[open_], sign > 0, sign >= 0)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = first[here] + np.minimum(number[here], number[here] ^ 1) * run + local[here] - number[here] * run + low
        order = order.copy()
        order[place] = x
        run *= 2
    return order


def _certain(data: np.ndarray, start: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> bool:
    """Whether neighbours share these prefixes byte by byte and go in the right order behind them."""
    for i in range(0, len(x), 4096):
        a, b, n = x[i : i + 4096], y[i : i + 4096], shared[i : i + 4096]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(start[a], n) + step], data[np.repeat(start[b], n) + step]):
            return False
        inside = (n < length[a]) & (n < length[b])
        if not (data[(start[a] + n)[inside]] < data[(start[b] + n)[inside]]).all() or not (length[a] <= length[b])[~inside].all():
            return False
    return True


def _dealt(contexts: DataFrame, width: int) -> DataFrame:
    """Spans of windows that a seed of very many classes holds twice: windows are dealt out by the hash of their bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for row in batch.to_pylist():
                body, far, near = memoryview(row["body"]), row["far"], row["near"]
                n = far - near + 1
                names = np.frombuffer(b"".join(xxh3_128_digest(body[i : i + width]) for i in range(n)), "<i8").reshape(-1, 2)
                begin = row["pos"] - far + np.arange(n)
                columns = [names[:, 0], names[:, 1], np.full(n, row["block"]), np.full(n, row["doc"], np.int32), begin.astype(np.int32), np.full(n, row["times"] > 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "block", "doc", "begin", "found"])

    many = contexts.where(F.col("classes") > SORTED_CLASSES)
    rows = written(many.mapInArrow(windows, "hi long, lo long, block long, doc int, begin int, found boolean"), "windows")
    twice = rows.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo")
    found = rows.where("NOT found").join(twice, ["hi", "lo"], "left_semi")
    return found.select("block", "doc", "begin", (F.col("begin") + width).alias("end"))


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The documents of a block without the bytes of the spans."""
    if not docs.num_rows:
        docs = docs.slice(0, 0)
    doc, begin, end = (spans.column(c).to_numpy().astype(np.int64) for c in ("doc", "begin", "end"))
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by], begin[by], end[by]
    texts = docs.column("text")
    sizes, removed, runs, kept = [], [], [], []
    for number, text in zip(docs.column("doc").to_pylist(), texts):
        whole = memoryview(text.as_buffer())
        low, high = np.searchsorted(doc, [number, number + 1])
        n, at, parts, gone = 0, 0, [], 0
        if low < high:
            b, reach = begin[low:high], np.maximum.accumulate(end[low:high])
            new = np.flatnonzero(np.concatenate([[True], b[1:] > reach[:-1]]))  # touching spans are one run
            for s, e in zip(b[new].tolist(), reach[np.concatenate([new[1:], [len(b)]]) - 1].tolist()):
                parts.append(whole[at:s])
                gone, n, at = gone + e - s, n + 1, e
        parts.append(whole[at:])
        sizes.append(len(whole))
        removed.append(gone)
        runs.append(n)
        kept.append(b"".join(parts))
    out = pa.table({"id": docs.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})
    return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS_AT_ONCE), out.schema)
