"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by products of letter counts.

Two such words have letter counts whose squared distance is 1 (one letter more) or 2 (one letter for another), and lengths that are
equal or adjacent. The distinct words are dealt into cells by their length and by how many letters they have of each of four sets of
letters; the cells that can hold a word's neighbours are then its own, the four of the next length and the six in which one
letter moved from one set to another. Cells are cut into blocks of bounded size. For a pair of blocks, one matrix product gives
the squared distances of all pairs of words; pairs at most two apart are then compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import ascii_lower, written

# Runs of letters: the letters of Latin-1 with all code points between, as the pattern of the words says.
LETTERS = r"A-Za-zÀ-ÿ"
# Letters by how common they are in English; each set takes every fourth, so that all four sets are filled. Others count with the last set.
_BY_USE = "etaoinshrdlcumwfgypbvkjxqz"
SETS = tuple(_BY_USE[k::4] + "".join(map(chr, range(0xC0 + k, 0x100, 4))) for k in range(4))
# Words of a block, and code points of its words together (a longer word is a block of its own).
BLOCK_WORDS = 2048
BLOCK_CHARS = 200_000


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5) -> DataFrame:
    """``id`` and ``run`` for every maximal run of letters with at least ``shortest`` code points, A-Z lower-cased, of the whole text.

    Null and empty texts have none, repeated rows and null ids count like others; other columns are not returned.
    """
    found = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))


def count_words(runs: DataFrame, word: Column, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """``word`` and its number of occurrences ``n``; words with fewer code points or occurrences are left out. Counts are combined before the shuffle."""
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def variants(words: DataFrame) -> DataFrame:
    """The near words of each word and the form that it is a variant of.

    ``words`` holds distinct words and their counts ``n``. Returned for each word: ``word``, ``n``, ``n_near`` (near words, 0 if none),
    ``form`` (its near word of largest ``n``, ties to the smallest in code-point order, if that ``n`` is at least twice the word's; else null),
    ``form_n`` (the form's ``n`` or null) and ``root`` (reached by following forms to the last; the word itself if it has no form).
    Counts double along a chain of forms, so there are no circles. No words give no rows.
    """
    words = written(words.select("word", "n"), "words")
    near = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = near.select(ends.alias("e")).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
    )
    formed = written(formed.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    roots = _last_forms(formed.where("form IS NOT NULL").select("word", F.col("form").alias("at")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("at", "word").alias("root"), "n", "n_near", "form_n")


def _last_forms(steps: DataFrame) -> DataFrame:
    """Follows ``at`` from every word until it has no further step; each round doubles the steps taken."""
    while True:
        steps = written(steps, "steps")
        further = steps.select(F.col("word").alias("at"), F.col("at").alias("next"))
        more = steps.join(further, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved"))
        more = written(more, "moves")
        if more.where("moved").isEmpty():
            return steps
        steps = more.drop("moved")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words that differ by exactly one inserted, deleted or replaced code point, once: ``a``, ``a_n``, ``b``, ``b_n``."""
    blocks = written(_blocks(words), "blocks")
    pairs = _block_pairs(blocks.select("cell", "part")).join(blocks.select(F.struct("cell", "part").alias("left"), F.col("words").alias("left_words")), "left")
    pairs = pairs.join(blocks.select(F.struct("cell", "part").alias("right"), F.col("words").alias("right_words")), "right")
    same = (F.col("left") == F.col("right")).alias("same")
    close = pairs.select(same, "left_words", "right_words").mapInArrow(_products, "a string, a_n long, b string, b_n long")
    return close.where(F.levenshtein("a", "b", 1) == 1)


def _blocks(words: DataFrame) -> DataFrame:
    """``cell`` (letters of each set), ``part`` and ``words`` (the words and counts of the block)."""
    in_set = [F.length("word") - F.length(F.translate("word", s, "")) for s in SETS[:-1]]
    counted = words.withColumn("cell", F.array(*in_set))
    rest = F.length("word") - F.aggregate("cell", F.lit(0), lambda total, n: total + n)
    counted = counted.withColumn("cell", F.concat("cell", F.array(rest)))
    # A cell with very many words is cut by hash; its size is summed before the shuffle.
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_WORDS), F.ceil(F.sum(F.length("word").cast("long")) / BLOCK_CHARS))
    sizes = counted.groupBy("cell").agg(parts.cast("long").alias("parts"))
    dealt = counted.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """``left`` and ``right``: every pair of blocks whose words can be near, once."""
    kinds = range(len(SETS))
    steps = [(0,) * len(SETS)]
    steps += [tuple(int(k == i) for k in kinds) for i in kinds]
    steps += [tuple(int(k == i) - int(k == j) for k in kinds) for i in kinds for j in kinds if i < j]
    moved = F.explode(F.array(*[F.array(*[F.get("cell", k) + F.lit(s[k]) for k in kinds]) for s in steps]))
    probes = blocks.select(F.struct("cell", "part").alias("left"), moved.alias("cell"))
    pairs = probes.join(blocks, "cell").select("left", F.struct("cell", "part").alias("right"))
    # Two blocks of one cell meet once.
    return pairs.where((F.col("left.cell") != F.col("right.cell")) | (F.col("left.part") <= F.col("right.part")))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words whose letter counts are at a squared distance of one or two."""
    for batch in batches:
        for same, left, right in zip(batch.column("same").to_pylist(), batch.column("left_words"), batch.column("right_words")):
            (a, a_n), (b, b_n) = _words(left), _words(right)
            x, y = _letter_counts(a, b)
            squares = lambda m: (m * m).sum(axis=1)
            # |x|² + |y|² - 2xy as one product.
            ones = lambda m: np.ones((len(m), 1), m.dtype)
            distance = np.hstack([x, squares(x)[:, None], ones(x)]) @ np.hstack([-2 * y, ones(y), squares(y)[:, None]]).T
            i, j = np.nonzero((distance <= 2) & (distance > 0))
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield pa.RecordBatch.from_arrays([a.take(i), a_n.take(i), b.take(j), b_n.take(j)], names=["a", "a_n", "b", "b_n"])


def _words(column: pa.ListScalar) -> tuple[pa.Array, pa.Array]:
    return column.values.field("word"), column.values.field("n")


def _letter_counts(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each word, a column for each letter that occurs. Whole numbers in floating point: exact as long as squares fit the fraction."""
    words = [*a.to_pylist(), *b.to_pylist()]
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    known, column = np.unique(letters, return_inverse=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    exact = np.float32 if lengths.max() < 1000 else np.float64
    counts = np.bincount(row * len(known) + column, minlength=len(words) * len(known)).reshape(len(words), -1).astype(exact)
    return counts[: len(a)], counts[len(a) :]
