"""Byte-level BPE: every distinct word is encoded once, its ids travel back to where the word stands.

Words are the matches of a pre-tokenizing pattern. Documents are read in blocks; a block keeps, for each document,
the positions of its words as numbers into the block's own list of distinct words, the most frequent first. These numbers stay
where they are, in a table bucketed by block. The word lists are dealt out by the words' hash, each distinct word is encoded once
where it arrives, and the ids return to the blocks, which put the documents together by position. Lists travel packed, so that a
shuffled row holds many words.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.session import shared_folder

# Code points of a block's texts. A longer document is a block of its own.
BLOCK_CHARS = 8_000_000
# Documents of a block at most: empty texts have no code points.
BLOCK_DOCS = 65_536
# Words, or documents, that are packed together.
CHUNK_WORDS = 65_536
CHUNK_DOCS = 4096
# Parts into which a block's words are dealt by hash, at least: a row of the shuffle holds about a thousandth of a block's words.
WORD_PARTS = 1024
# Documents that go back to Spark at once.
ROWS_AT_ONCE = 512
# Words an encoding task remembers; beyond this it forgets all and goes on, so that a part with more words encodes some of them again.
REMEMBERED = 500_000

# Rows of the block table: documents (a chunk), the parts of a block's words in the order of their numbers, or one part's words.
_CHUNK, _ORDER = -1, -2


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, blank, id on each line); ids must run from 0 without a gap.

    The file is read where the driver runs. Its size is fixed by the vocabulary, not by the data.
    """
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` (long), ``token_ids`` (binary: 32-bit little-endian ids).

    A null text counts as empty and has no token. Repeated rows and null or repeated ids give one row each. Texts of any
    length are encoded whole. Other columns are not returned, whatever their names. An empty table gives no row.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many parts as tasks can encode.
    found = plain.mapInArrow(_blocks(pattern, max(WORD_PARTS, buckets)), f"block string, part int, ids array<{id_type}>, counts array<long>, body binary")
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    found.write.bucketBy(buckets, "block").option("path", shared_folder(spark, "bpe-blocks")).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    shared = spark.sparkContext.broadcast(tokens)  # bounded by the vocabulary
    width = 2 if len(tokens) <= 1 << 16 else 4
    parts = blocks.where(F.col("part") >= 0).select("part", "block", "body")
    answered = parts.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(_encode_parts(shared, width), "block string, part int, body binary")
    kept = blocks.where(F.col("part") < 0)  # read bucket by bucket: these rows are not shuffled
    return (
        kept.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(_reassemble(width), f"id {id_type}, n_tokens long, token_ids binary")
        .withColumnRenamed("id", id_col)
    )


def decode(encoded: DataFrame, tokens: list[bytes], ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, joined from the token table in position order.

    The token table is as large as the vocabulary and is sent to every task. Null ids give null.
    """
    names = encoded.columns
    if "decoded" in names:
        raise ValueError("the table already has a column named decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in shared.value], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.frombuffer(b"".join(shared.value), np.uint8)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                out = []
                for packed in batch.column(ids_col):
                    packed = packed.as_py()
                    if packed is None:
                        out.append(None)
                        continue
                    pieces = []
                    for i in range(0, len(packed), 4_000_000):
                        ids = np.frombuffer(packed[i : i + 4_000_000], "<u4")
                        pieces.append(_gather(pool, starts[ids], lengths[ids])[0].tobytes())
                    out.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(joined, ", ".join([*kinds, "decoded binary"]))


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``pool`` in a row, and where each begins there."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - begins, lengths)], begins


class _Codes(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _blocks(pattern: str, parts: int):
    """Per block: rows for its documents in chunks, one for the order of its words, and one for each part of its word list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        task = TaskContext.get()
        name, serial = f"{task.partitionId()}-{task.taskAttemptId()}", 0
        codes, held, size, schema = _Codes(), [], 0, None
        for batch in batches:
            schema = schema or pa.schema(
                [("block", pa.string()), ("part", pa.int32()), ("ids", pa.list_(batch.schema.field("id").type)), ("counts", pa.list_(pa.int64())), ("body", pa.binary())]
            )
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                whole = text.as_py()
                words = find(whole)
                held.append((key, np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))))
                size += len(whole)
                if size >= BLOCK_CHARS or len(held) >= BLOCK_DOCS:
                    yield from _block_rows(f"{name}-{serial}", codes, held, schema, parts)
                    codes, held, size, serial = _Codes(), [], 0, serial + 1
        if held:
            yield from _block_rows(f"{name}-{serial}", codes, held, schema, parts)

    return run


def _block_rows(block: str, codes: dict[str, int], held: list, schema: pa.Schema, n_parts: int) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    # The most frequent words get the smallest numbers, which pack best.
    counts = np.bincount(np.concatenate([own for _, own in held]), minlength=len(codes))
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(len(codes), np.uint32)
    rank[by_count] = np.arange(len(codes), dtype=np.uint32)
    chunk: list[tuple] = []
    n_words = 0
    for i, (key, own) in enumerate(held):
        chunk.append((key, rank[own]))
        n_words += len(own)
        if i + 1 == len(held) or n_words >= CHUNK_WORDS or len(chunk) >= CHUNK_DOCS:
            body = _pack(np.concatenate([c for _, c in chunk]))
            yield rows([(block, _CHUNK, [k for k, _ in chunk], [len(c) for _, c in chunk], body)])
            chunk, n_words = [], 0
    listed = [w.encode() for w in codes]
    words = [listed[i] for i in by_count]
    parts = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.uint32, len(words))
    yield rows([(block, _ORDER, None, [len(words)], _pack(parts))])
    order = np.argsort(parts, kind="stable")
    bounds = np.searchsorted(parts[order], np.arange(n_parts + 1))
    pieces = [(p, [words[i] for i in order[bounds[p] : bounds[p + 1]]]) for p in range(n_parts)]
    if lists := [(block, p, None, None, _pack_list(own)) for p, own in pieces if own]:
        yield rows(lists)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, by byte planes: the high bytes are mostly alike and compress away."""
    from zstandard import ZstdCompressor

    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    packed = [ZstdCompressor(3).compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return np.array([len(numbers), *map(len, packed)], "<u4").tobytes() + b"".join(packed)


def _unpack(body: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    n, *lengths = np.frombuffer(body[:20], "<u4").tolist()
    planes, at = np.zeros((n, 4), np.uint8), 20
    for i, length in enumerate(lengths):
        planes[:, i] = np.frombuffer(ZstdDecompressor().decompress(body[at : at + length], max_output_size=n), np.uint8)
        at += length
    return planes.view("<u4").reshape(-1)


def _pack_list(items: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in items], "<u4")
    planes = np.ascontiguousarray(lengths.view(np.uint8).reshape(-1, 4).T).tobytes()
    return zlib.compress(np.array([len(items)], "<u4").tobytes() + planes + b"".join(items), 6)


def _unpack_list(body: bytes) -> list[bytes]:
    raw = zlib.decompress(body)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    planes = np.frombuffer(raw[4 : 4 + 4 * n], np.uint8).reshape(4, n)
    lengths = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    ends = (np.cumsum(lengths.astype(np.int64)) + 4 + 4 * n).tolist()
    begins = [4 + 4 * n, *ends]
    return [raw[begins[i] : begins[i + 1]] for i in range(n)]


def _encode_parts(shared, width: int):
    """Word lists in, the ids of each word out; a word that several blocks hold is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {t: i for i, t in enumerate(shared.value)}
        # The pattern takes a whole word as one piece: words were cut before.
        coder = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        done: dict[bytes, bytes] = {}
        now, kinds = None, (pa.string(), pa.int32(), pa.binary())
        for batch in batches:
            out = []
            for part, block, body in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("body")):
                if part != now or len(done) > REMEMBERED:
                    done, now = {}, part
                words = _unpack_list(body.as_py())
                for word in words:
                    if word not in done:
                        done[word] = np.array(coder.encode_ordinary(word.decode()), f"<u{width}").tobytes()
                out.append((block, part, _pack_list([done[w] for w in words])))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "part", "body"])

    return run


def _reassemble(width: int):
    """The documents of a block from their word numbers and the ids of its words."""

    def run(kept: pa.Table, answered: pa.Table) -> pa.Table:
        id_kind = kept.schema.field("ids").type.value_type
        lists = {p: _unpack_list(b.as_py()) for p, b in zip(answered.column("part").to_pylist(), answered.column("body"))}
        ids = [w for p in sorted(lists) for w in lists[p]]
        parts = next(_unpack(b.as_py()) for p, b in zip(kept.column("part").to_pylist(), kept.column("body")) if p == _ORDER)
        place = np.empty(len(parts), np.int64)  # of each word in the joined lists
        place[np.argsort(parts, kind="stable")] = np.arange(len(parts))
        lengths = np.array([len(w) // width for w in ids], np.int64)
        starts = np.cumsum(lengths) - lengths
        starts, lengths = starts[place], lengths[place]
        pool = np.frombuffer(b"".join(ids), f"<u{width}")
        keys, counts, out = [], [], []
        for part, own, n_words, body in zip(*(kept.column(c) for c in ("part", "ids", "counts", "body"))):
            if part.as_py() != _CHUNK:
                continue
            codes, at = _unpack(body.as_py()), 0
            for key, n in zip(own.as_py(), n_words.as_py()):
                pieces = [_gather(pool, starts[c], lengths[c])[0] for c in np.split(codes[at : at + n], range(1_000_000, n, 1_000_000))]
                at += n
                keys.append(key)
                counts.append(sum(len(p) for p in pieces))
                out.append(b"".join(p.astype("<u4").tobytes() for p in pieces))
        whole = pa.table({"id": pa.array(keys, id_kind), "n_tokens": pa.array(counts, pa.int64()), "token_ids": pa.array(out, pa.binary())})
        return pa.Table.from_batches(whole.to_batches(max_chunksize=ROWS_AT_ONCE), whole.schema)

    return run
