"""The hash-tree manifest against a plain version, and its layout."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_hash(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded and claimed of every row: trees level by level, proofs by walking up."""
    trees = {}
    for r in rows:
        claim = row_hash(*r[:4], None if r[4] is None else r[4].translate({i: i + 32 for i in range(65, 91)}))
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, row_hash(*r), claim if touched else None, r[0]))
    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
        return found
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([leaf for _, _, leaf, _, _ in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    top = levels([built[t][-1][0] for t in order]) if order else []
    out = []
    for k, t in enumerate(order):
        for i, (_, _, leaf, claim, doc_id) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            proof, now = "", claim or leaf
            for nodes, at in [(n, i >> 3 * d) for d, n in enumerate(built[t][:-1])] + [(n, k >> 3 * d) for d, n in enumerate(top[:-1])]:
                run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                proof += "".join(x for j, x in enumerate(run) if j != at % 8)
                now = sha("".join(now if j == at % 8 else x for j, x in enumerate(run)))
            out.append((doc_id, leaf, built[t][-1][0], top[-1][0], proof, now))
    return out


def found(docs):
    row = lambda text: merkle.row_hash(*[F.col(c) for c in COLUMNS[:4]], text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, row(lower))
    manifest = merkle.build(docs, row(F.col("text")), F.col("lang"), F.col("doc_id"), claim, ("doc_id",))
    rows, root = merkle.prove(manifest).join(manifest.trees, "tree"), manifest.root()
    return manifest, [(r["carried"]["doc_id"], r["leaf"], r["subroot"].hex(), root, r["proof"], r["folded"]) for r in rows.collect()]


def check(docs):
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    key = lambda r: tuple((v is not None, v or 0) if i == 0 else v for i, v in enumerate(r))
    manifest, ours = found(docs)
    assert sorted(ours, key=key) == sorted(plain(rows), key=key)
    return manifest


def test_many_blocks_and_a_hot_tree(spark):
    """Trees of several bands: 4,097 leaves need a second one, with a last block of a single leaf."""
    rng = random.Random(12)
    langs = ["en"] * 4097 + [None] * 33 + ["de"] * 9000 + ["x"] + [f"l{i}" for i in range(70)]
    rows = [(rng.randrange(8000), rng.choice(["a", None]), lang, rng.choice([None, 3]), rng.choice(["", "Ab", "\u00c4b", None])) for lang in langs]
    rng.shuffle(rows)
    manifest = check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert len(manifest.bands) == 2 and manifest.trees.count() == 74


def test_edges(spark, edge_docs, no_docs):
    check(edge_docs)
    check(edge_docs.where("doc_id = 5"))
    check(edge_docs.select(F.lit(1).cast("long").alias("doc_id"), "source", F.lit("one").alias("lang"), "n_chars", "text").limit(1).crossJoin(spark.range(20).select(F.col("id").alias("rank"))))
    manifest, rows = found(no_docs)
    assert rows == [] and manifest.root() is None


@pytest.mark.parametrize("levels", range(1, 6))
def test_layout(levels):
    """Every node has a place of its own; the upper half of the levels comes first, each subtree of the lower half is one stretch."""
    places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.subtree_size(levels)))
    if levels > 1:
        upper = levels // 2
        assert max(p.max() for p in places[:upper]) == merkle.subtree_size(upper) - 1
        size = merkle.subtree_size(levels - upper)
        for j in range(8**upper):
            own = np.concatenate([p[j * 8 ** (d - upper) : (j + 1) * 8 ** (d - upper)] for d, p in list(enumerate(places))[upper:]])
            assert own.max() - own.min() == size - 1
