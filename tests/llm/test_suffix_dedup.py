"""Removal of repeated strings against a plain search of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowbench.llm import queries, suffix_dedup  # noqa: F401
from flowbench.plans.catalog import QUERIES


def plain(texts, width):
    """Bytes, removed bytes, runs and kept bytes of every text."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - width + 1):
            if n[d[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(d, np.uint8)[~gone[1:-1]])))
    return out


def check(spark, texts, width, seed, parts=3):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    rows = suffix_dedup.remove_repeats(docs, width, seed).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, expected, text in zip(rows, plain(texts, width), texts):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == expected, text


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(n))


def copies(rng, n):
    """Texts of shared passages, near copies with a changed place, exact copies, periodic and short texts."""
    passages = [words(rng, rng.randrange(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = " ".join(rng.choice([words(rng, rng.randrange(1, 30)), rng.choice(passages)]) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.3:
            k = rng.randrange(len(text) + 1)
            text = text[:k] + "#" + text[k + rng.randrange(3) :]
        texts.append(text)
    return [*texts, *rng.sample(texts, n // 8), None, "", "ab" * 100, "é" * 90, "x" * 61, "x" * 60, words(rng, 3)]


@pytest.mark.parametrize("width,seed,start", [(20, 5, 1), (33, 8, 2), (12, 12, 3), (20, 1, 4)])
def test_against_all_windows(spark, width, seed, start):
    check(spark, copies(random.Random(start), 60), width, seed)


def test_production_width(spark):
    rng = random.Random(7)
    passages = [words(rng, 120) for _ in range(3)]
    texts = []
    for i in range(40):
        text = words(rng, rng.randrange(1, 150)) + rng.choice(passages) + words(rng, rng.randrange(1, 150))
        texts += [text, text[: rng.randrange(len(text))] + "~" + text[rng.randrange(len(text)) :]]
    check(spark, texts, suffix_dedup.WIDTH, suffix_dedup.SEED)


def test_a_seed_of_very_many_classes(spark):
    """A passage in more documents than are sorted at once, with other neighbours in each; some neighbours agree."""
    rng = random.Random(5)
    passage = "the passage that all of them share."
    texts = [words(rng, 4) + rng.choice(["", " ab "]) + passage + words(rng, 4) for _ in range(suffix_dedup.SORTED_CLASSES + 900)]
    check(spark, texts, 24, 6)


def test_documents_longer_than_a_piece(spark):
    rng = random.Random(6)
    long = words(rng, 200_000)
    tail = long[300_000:300_900]
    assert len(long.encode()) < suffix_dedup.PIECE
    check(spark, [long + tail + words(rng, 250_000), "yy" + tail, words(rng, 30)], 200, 32)


def test_edges(spark, edge_docs, no_docs):
    rows = suffix_dedup.remove_repeats(edge_docs).collect()
    own = [r["text"] for r in edge_docs.collect()]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)
    assert got == sorted(plain(own, 200))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in edge_docs.collect())
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_sorted_suffixes_and_collisions(monkeypatch):
    rng = random.Random(8)
    group = np.sort(np.array([rng.randrange(40) for _ in range(900)]))
    strings = ["".join(rng.choices("ab", k=rng.randrange(12))).encode() for _ in group]
    whole = suffix_dedup._Hash

    class Weak(whole):
        """The first base hashes everything alike."""

        def __init__(self, data, attempt=0):
            super().__init__(data, attempt)
            self.weak = attempt == 0

        def of(self, start, length):
            return super().of(start, length) * np.uint64(not self.weak)

    for kind in (whole, Weak):
        monkeypatch.setattr(suffix_dedup, "_Hash", kind)
        order, shared = suffix_dedup.sorted_suffixes(group, strings)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
        for k, (i, n) in enumerate(zip(order.tolist(), shared.tolist())):
            if n >= 0:
                a, b = strings[order[k - 1]], strings[i]
                assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
            else:
                assert k == 0 or group[order[k - 1]] != group[i]


def test_query_over_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = dict(zip(docs, plain(docs.values(), suffix_dedup.WIDTH)))
    rows = QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == {
        d: (*e[:3], hashlib.sha256(e[3]).hexdigest()) for d, e in expected.items()
    }
    assert len(rows) == len(docs) and sum(r["n_removed"] for r in rows) > 0
