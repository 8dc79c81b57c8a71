"""Spelling variants against plain comparisons of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowbench.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(words):
    out = {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(close, default=(0, None))
        out[w] = (best[1] if close and -best[0] >= 2 * n else None, n, len(close), -best[0])
    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w
    return sorted((w, form or "", root(w), n, k, most if form else -1) for w, (form, n, k, most) in out.items())


def found(words):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in variants.variants(words).collect())


@pytest.mark.parametrize("letters,sizes", [("abé", (5, 6, 7)), ("aeiousßÿ÷À", (5, 5, 6)), ("e", range(5, 30))])
def test_variants_against_all_pairs(spark, letters, sizes):
    rng = random.Random(13)
    words = {"".join(rng.choices(letters, k=rng.choice(sizes))): rng.choice([3, 4, 6, 7, 12, 25, 50, 100]) for _ in range(700)}
    assert found(spark.createDataFrame(list(words.items()), "word string, n long")) == plain(words)


def test_cells_of_many_blocks(spark):
    """Anagrams share one cell: 5,040 words of seven letters and their variants make several blocks of one cell."""
    rng = random.Random(3)
    words = {}
    while len(words) < 5000:
        w = list("abcdefgh")
        rng.shuffle(w)
        words["".join(w)] = rng.randrange(3, 99)
    for w in rng.sample(sorted(words), 300):
        k = rng.randrange(8)
        words.setdefault(w[:k] + rng.choice(["", "é", "ab"[k % 2] + w[k]]) + w[k + 1 :], rng.randrange(3, 300))
    # By deleted letters, as 5,300 words are many for all pairs.
    shorter = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    pairs = {(a, b) for same in shorter.values() for a in same for b in same if a < b}
    pairs |= {tuple(sorted((w, d))) for (_, d), same in shorter.items() if d in words for w in same}
    assert all(near(a, b) for a, b in pairs)
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants._blocks(rows).groupBy("cell").count().agg(F.max("count")).first()[0] > 2
    ours = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_pairs(rows).collect()]
    assert len(ours) == len(set(ours)) and set(ours) == pairs


def test_counts(spark, edge_docs, no_docs):
    texts = ["Straße straße STRASSE; naïve-naïve NAÏVE naïve\nabcd abcde1abcde abcdeé", None, "", "x" * 30_000, "Ångström ÅNGSTRÖM"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    lower = lambda s: s.translate({i: i + 32 for i in range(65, 91)})
    runs = Counter(w for r in docs.collect() for w in re.findall("[A-Za-zÀ-ÿ]+", lower(r["text"] or "")) if len(w) >= 5)
    counted = variants.count_words(variants.letter_runs(docs), F.col("run"))
    assert {r["word"]: r["n"] for r in counted.collect()} == {w: n for w, n in runs.items() if n >= 3}
    assert found(counted) == plain({w: n for w, n in runs.items() if n >= 3})
    assert variants.variants(variants.count_words(variants.letter_runs(no_docs), F.col("run"))).count() == 0
    assert variants.letter_runs(edge_docs.withColumn("run", F.lit(1)).withColumn("n", F.lit(2))).columns == ["id", "run"]


def test_long_words_are_exact():
    """Squares of counts beyond the fraction of 32 bits are held in 64."""
    long = "e" * 20_001
    item = pa.array([[{"word": long, "n": 3}, {"word": "a" + long[1:], "n": 4}]], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([True]), item, item], names=["same", "left_words", "right_words"])
    (out,) = variants._products(iter([batch]))
    assert out.num_rows == 1 and out.column("a_n").to_pylist() == [3]
    assert np.asarray(out.column("b_n")).tolist() == [4]
