"""SimHash near-duplicates: Golay codes give every fingerprint a few keys that all its near neighbours share.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at most two bits, one
of the segments is equal (two errors cannot hit three segments) and the next one, in turn, differs in at most two bits.
The equal segment is the first half of a key. The second half comes from the perfect (23, 12) Golay code: any 23-bit word
lies within three bits of exactly one codeword. Words that differ in two bits or fewer have a word between them that is at
most one flip from either, so the codewords of all words within one flip are keys that they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import written
from flowbench.llm.components import connected_components

MAX_BITS = 2
# Bits of the segments, from the low end, and which segment is decoded beside each exact one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b110001110101
# Keys held by more fingerprints than this are not compared pair by pair.
CROWD = 64
_SEED = 42
_CHUNK = 100_000


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (long) of every row's whole text.

    A-Z are lower-cased; words are runs without blank, tab, line feed, vertical tab, form feed or carriage return. A bit is 1
    if it is set in over half the XXH64 values (seed 42) of the word shingles, repeats included. A text of fewer words is one
    shingle; a text without words, or null, has fingerprint 0. Repeated rows and null ids give a row each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_simhash((t.as_py() or "").encode(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fingerprint"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def _simhash(text: bytes, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), _SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    grams = zip(*(islice(words, i, None) for i in range(shingle)))
    while part := [xxh64_intdigest(b" ".join(g), _SEED) for g in islice(grams, _CHUNK)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


class Golay:
    """Decodes 23-bit words to the index (12 bits) of the codeword within three bits."""

    def __init__(self):
        self.remainder = np.array([_mod(h << 11) for h in range(1 << 12)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        for flips in range(4):
            for bits in combinations(range(23), flips):
                word = sum(1 << b for b in bits)
                self.error[_mod(word)] = word

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.remainder[words >> 11] ^ (words & 0x7FF)]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Per word, the indexes for the word itself and for each flip of one of its ``width`` bits."""
        flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
        return self.index(words[:, None] ^ flips[None, :])


def _mod(word: int) -> int:
    while word.bit_length() > 11:
        word ^= GOLAY << (word.bit_length() - 12)
    return word


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (int64): every key, and the place of the fingerprint it belongs to."""
    code, keys, owners = Golay(), [], []
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for i, exact in enumerate(parts):
        j = (i + 1) % len(parts)
        near = np.sort(code.near(parts[j], SEGMENTS[j][1]), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        keys.append((i << 34) | (exact[row] << 12) | near[row, col])
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), _CHUNK):
            part = prints[at : at + _CHUNK]
            keys, owners = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], names=["key", "fingerprint"])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fingerprint``, no repeats) that join all within ``max_bits`` (1 or 2).

    Keys shared by up to ``CROWD`` fingerprints are compared and every near pair is an edge. Fingerprints under a busier key
    are linked exactly without pairs. Two of them are within two bits if and only if one flip (or none) of each gives the same
    word, and at most 65 fingerprints can meet at a word; each is linked to the smallest there. For one bit, a fingerprint
    is linked to those of its 64 flips that are in the crowd.
    """
    keys = written(prints.select("fingerprint").mapInArrow(_keyed, "key long, fingerprint long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.join(sizes, "key"), "shared-keys")
    few = shared.where(F.col("n") <= CROWD)
    left, right = few.select("key", F.col("fingerprint").alias("a")), few.select("key", F.col("fingerprint").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = left.join(right, "key").where(near).select("a", "b")
    flips = [F.lit(0)] + [F.lit(-(1 << 63) if b == 63 else 1 << b) for b in range(64)]
    crowd = shared.where(F.col("n") > CROWD).select("fingerprint").distinct()
    between = crowd.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(f.cast("long")) for f in flips])).alias("word"))
    if max_bits == 1:
        stars = between.join(crowd.select(F.col("fingerprint").alias("word")), "word").where("word < fingerprint").select(F.col("word").alias("a"), F.col("fingerprint").alias("b"))
    else:
        met = between.groupBy("word").agg(F.collect_list("fingerprint").alias("met")).where(F.size("met") > 1)
        stars = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (long), ``component_id`` (smallest id reachable over links).

    Two rows are linked if their fingerprints differ in at most ``max_bits`` (0, 1 or 2) bits; equal fingerprints are linked, those
    of empty texts, too. Null ids are larger than all others: a component of null ids alone has a null ``component_id``.
    Repeated rows give a row each, other columns are not returned, an empty table gives no row.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find links of up to {MAX_BITS} bits")
    rows = written(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    prints = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    if max_bits:
        nodes = connected_components(links(prints, max_bits), "a", "b").withColumnRenamed("node", "fingerprint")
        prints = prints.join(nodes, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
        least = prints.groupBy("component").agg(F.min("first").alias("component_id"))
        prints = prints.join(least, "component").select("fingerprint", "component_id")
    else:
        prints = prints.withColumnRenamed("first", "component_id")
    return rows.join(prints, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")

