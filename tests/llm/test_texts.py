"""Operators that read each text by itself: BPE, toxicity, licenses, quality rules."""

import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowbench.llm import byte_bpe, license_scan, quality_rules, toxicity
from flowbench.llm.queries import RANKS


@pytest.fixture(scope="module")
def tokens(spark):
    return byte_bpe.read_ranks(spark, RANKS)


@pytest.fixture(scope="module")
def coder(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def encoded(docs, tokens):
    return byte_bpe.decode(byte_bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens).collect()


def test_bpe_equals_the_library(spark, sf_dir, tokens, coder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = encoded(docs, tokens)
    assert len(found) == len(texts)
    for r in found:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == coder.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded"].decode() == texts[r["doc_id"]] and r["n_tokens"] * 4 == len(r["token_ids"])


def test_bpe_of_odd_texts_in_many_blocks(spark, tokens, coder, monkeypatch):
    rng = random.Random(1)
    letters = "ab 'sS\n\t\r\x0b\x1c\x85  ​09²½éß́你好ह\U0001f600<|endoftext|>" + "".join(map(chr, range(128)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in encoded(docs, tokens)}
    for i, text in enumerate(texts):
        assert np.frombuffer(found[i]["token_ids"], "<u4").tolist() == coder.encode_ordinary(text), text
        assert found[i]["decoded"] == text.encode()


def test_bpe_edges(edge_docs, no_docs, tokens, coder):
    found = encoded(edge_docs, tokens)
    want = sorted((r["text"] or "").encode() for r in edge_docs.collect())
    assert sorted(r["decoded"] for r in found) == want
    assert sum(r["n_tokens"] for r in found) == sum(len(coder.encode_ordinary(t.decode())) for t in want)
    assert encoded(no_docs, tokens) == []


def test_blocks_of_few_characters(monkeypatch):
    """A task that closes a block after nearly every document numbers its words anew each time."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 10)
    monkeypatch.setattr(byte_bpe, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})())}))
    batch = pa.record_batch({"id": [1, 2, 3, 4], "text": ["one two one", "two", "", "three three"]})
    rows = [r for b in byte_bpe._blocks(r"\S+", 16)(iter([batch])) for r in b.to_pylist()]
    assert [(r["ids"], r["counts"]) for r in rows if r["part"] == -1] == [([1], [3]), ([2, 3, 4], [1, 0, 2])]
    assert len({r["block"] for r in rows}) == 2


def test_many_short_texts(spark, tokens, coder):
    """A partition of 200,000 empty or one-word texts takes time in proportion, closes blocks by documents and gives a row for each."""
    texts = F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("w"), F.col("id") % 1000))
    docs = spark.range(200_000).coalesce(1).select(F.col("id").alias("doc.id"), texts.alias("the.text"))
    began = time.time()
    found = byte_bpe.encode(docs, tokens, public_tokenizers.PATTERN, "doc.id", "the.text")
    rows = found.agg(F.count("*"), F.countDistinct("`doc.id`"), F.sum("n_tokens")).first()
    assert time.time() - began < 60
    assert rows[0] == rows[1] == 200_000
    assert rows[2] == sum(len(coder.encode_ordinary(f"w{i % 1000}")) for i in range(2, 200_000, 3))


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["scum", "moron", "idiot", "idiots", "pathetic", "aab", "abababab"]
    automaton = toxicity.TermAutomaton(terms)
    words = ["".join(rng.choice("abmornidtspec") for _ in range(rng.randrange(9))) for _ in range(3000)] + terms
    for term in terms:
        for _ in range(300):
            i, kind = rng.randrange(len(term) + 1), rng.randrange(3)
            words.append(term[:i] + rng.choice(["", "x", "a"]) + term[i + kind % 2 :])
    for word in words:
        near = [(levenshtein(word, t), t) for t in terms]
        want = min([(d, t) for d, t in near if d == 0 or d == 1 and len(t) >= toxicity.FUZZY_LENGTH], default=None)
        assert automaton.match(word) == want, word


def test_context_tells_mention_from_abuse():
    def weight(text):
        i = text.index("idiot")
        return toxicity.context(text, i, i + 5)

    assert weight("what an idiot") == 1.0
    assert weight("you idiot") == 1.5
    assert weight('the sign "idiot" hung there') == pytest.approx(0.3)
    assert weight("the word idiot is old") == 0.5
    assert weight('"a" idiot "b"') == 1.0


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.learn(docs, labels, held_out)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(held_out).select("toxic", "score").collect()
    hit = sum(r["toxic"] == 1 and r["score"] >= 0.7 for r in scored)
    false = sum(r["toxic"] == 0 and r["score"] >= 0.7 for r in scored)
    toxic = sum(r["toxic"] for r in scored)
    assert hit >= 0.85 * toxic and false <= 0.01 * (len(scored) - toxic)


def test_toxicity_finds_misspellings_and_edges(spark, edge_docs, no_docs):
    insults = ["idiot", "moron", "worthless"]
    rng = random.Random(4)
    plain = [chr(97 + a) + chr(97 + b) + "lu" for a in range(26) for b in range(26)]
    rows, marks = [], []
    for i in range(400):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            for at in range(3):
                words.insert(rng.randrange(30), insults[(i + at) % 3])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, *marks[:5], (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(False))
    assert set(model.terms) == set(insults)
    probe = [(1, "an idiiot and a morn and a worthles thing"), (2, "abcd efgh"), (3, ""), (4, None), (None, "idiot moron idiot")]
    found = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert [h["term"] for h in found[1]["hits"]] == ["idiot", "moron", "worthless"] and all(h["errors"] == 1 for h in found[1]["hits"])
    assert found[None]["score"] >= 0.7 and found[2]["score"] == found[3]["score"] == found[4]["score"] < 0.5
    assert toxicity.score(edge_docs, model).count() == edge_docs.count() and toxicity.score(no_docs, model).count() == 0
    untaught = toxicity.learn(no_docs, labels.limit(0), F.lit(False))
    assert untaught.terms == () and toxicity.score(edge_docs, untaught).agg(F.max("score")).first()[0] < 0.5


def test_suffix_automaton_gives_matching_statistics():
    rng = random.Random(6)
    for _ in range(400):
        sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 8))] for _ in range(rng.randrange(1, 5))]
        text = [rng.randrange(5) for _ in range(14)]
        automaton = license_scan.Automaton.of(sequences)
        for i, (state, length) in enumerate(automaton.statistics(text)):
            best, inside = 0, 0
            for size in range(1, i + 2):
                part = text[i + 1 - size : i + 1]
                bits = sum(1 << b for b, s in enumerate(sequences) if any(s[k : k + size] == part for k in range(len(s))))
                best, inside = (size, bits) if bits else (best, inside)
            assert (length, automaton.ends[state] if length else 0) == (best, inside)


def test_license_phrases_equal_a_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    total = 0
    for r in license_scan.scan_licenses(docs).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert r["n_words"] == len(words) and sorted((p["word"], p["label"]) for p in r["phrases"]) == want
        assert {p["label"] for p in r["phrases"]} - {"cc-by"} <= {s["label"] for s in r["spans"]}
        total += len(want)
    assert total > 10


def test_license_spans(spark, edge_docs, no_docs):
    mit = license_scan.TEMPLATES[3][1]
    changed = mit.replace("associated documentation files", "documents").replace("free of charge", "for nothing at all")
    rows = [(1, "x y " + mit + " z"), (2, "// " + changed.upper()), (3, "the rights to use, copy and go"), (4, "MIT-License mit license"), (5, "cc by by")]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(license_scan.words_of(mit))
    assert [(s["first_word"], s["last_word"], s["label"], s["covered"]) for s in found[1]["spans"]] == [(2, n + 1, "mit", 1.0)]
    assert [s["label"] for s in found[2]["spans"]] == ["mit"] and 0.75 <= found[2]["score"] < 1
    assert found[3]["spans"] == [] and found[3]["score"] == 0
    assert [p["word"] for p in found[4]["phrases"]] == [0, 2] and found[4]["score"] == 0.5
    assert [p["word"] for p in found[5]["phrases"]] == [0]
    assert license_scan.scan_licenses(edge_docs).count() == edge_docs.count() and license_scan.scan_licenses(no_docs).count() == 0


def test_license_phrases_of_one_word(spark):
    texts = ["this is isc and mit license", "isc", "ISC isc, mit isc", "license isc license", "disc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.scan_licenses(docs, (), {"isc": "isc", "mit license": "mit"}).orderBy("doc_id").collect()
    found = [[(p["word"], p["label"]) for p in r["phrases"]] for r in rows]
    assert [sorted(f) for f in found] == [[(2, "isc"), (4, "mit")], [(0, "isc")], [(0, "isc"), (1, "isc"), (3, "isc")], [(1, "isc")], []]


def test_license_chains_advance_in_the_template(spark):
    part, whole = "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0"
    texts = [
        part + " and " + part,  # four words of seven, twice
        whole + " and " + whole,
        "BY-SA 4.0 Licensed under CC",  # both pieces, in the wrong order
        "Licensed under CC, see there, BY-SA 4.0",
        part + " " + part + " " + whole,
        (part + " ") * 3_000 + (whole + " ") * 3_000,
    ]
    found = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [(s["first_word"], s["last_word"], s["label"], s["covered"]) for s in r["spans"]] for r in found}
    assert spans[0] == spans[2] == []
    assert spans[1] == [(0, 6, "cc-by-sa", 1.0), (8, 14, "cc-by-sa", 1.0)]
    assert spans[3] == [(0, 8, "cc-by-sa", 1.0)]
    assert spans[4] == [(12, 18, "cc-by-sa", 1.0)]
    assert spans[5] == [(18_000 + 7 * i, 18_006 + 7 * i, "cc-by-sa", 1.0) for i in range(3_000)]
    assert {r["doc_id"]: r["score"] for r in found} == {0: 0.5, 1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_license_chains_equal_a_search():
    rng = random.Random(8)
    for _ in range(300):
        parts = sorted({(rng.randrange(2, 12), rng.randrange(2, 9), 0) for _ in range(rng.randrange(1, 7))})
        parts = [(last, place, rng.randrange(1, min(last, place) + 2)) for last, place, _ in parts]
        best = 0
        for size in range(1, len(parts) + 1):
            for chain in itertools.combinations(parts, size):
                covered, ok = chain[0][2], True
                for (a, x, _), (b, y, length) in zip(chain, chain[1:]):
                    new = min(length, b - a, y - x)
                    ok = ok and new > 0
                    covered += new
                best = max(best, covered if ok else 0)
        assert max(covered for _, _, covered in license_scan._best_chains(parts, 1)) == best


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), text.count("!"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, edge_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(40))) + "\n" * rng.randrange(3) + "a #\n a #" * rng.randrange(3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    found = quality_rules.ledger(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r[m] for m in quality_rules.MEASURES) == plain_measures(r["text"]), r["text"][:80]
    assert quality_rules.ledger(no_docs).count() == 0
    kept = quality_rules.ledger(edge_docs, prefix="q_")
    assert kept.columns[: len(edge_docs.columns)] == edge_docs.columns and kept.where(quality_rules.passes("v2", "q_fail_bits")).count() >= 0
    with pytest.raises(ValueError):
        quality_rules.ledger(edge_docs.withColumn("N_words", F.lit(1)))


def test_ablations_count_bits(spark, sf_dir):
    rows = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("fail_bits")
    bits = [r["fail_bits"] for r in rows.collect()]
    mask = quality_rules.POLICIES["v2"]
    for r in quality_rules.ablations(rows, "v2").collect():
        assert (r["failed"], r["only"]) == (sum(b >> r["bit"] & 1 for b in bits), sum(b & mask == 1 << r["bit"] for b in bits))


def test_quality_keeps_clean_documents(spark):
    """Beyond the base rules, nothing that a label calls good is rejected."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = quality_rules.ledger(docs).where(quality_rules.passes("base") & ~quality_rules.passes("v2"))
    found = rows.agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 0")).alias("bad")).first()
    assert found["good"] == 0 and found["bad"] > 100


def test_share_of_repeated_lines_holds_for_short_texts(spark):
    """One line of three said again is a third of the lines: the rule has no least number of lines."""
    lines = ["the first line has some words of its own here", "and another one follows it with other words"]
    docs = spark.createDataFrame([(1, "\n".join([lines[0], lines[1], lines[0]])), (2, "\n".join([*lines, lines[0].upper()]))], "doc_id long, text string")
    bits = {r["doc_id"]: r["fail_bits"] >> 3 & 1 for r in quality_rules.ledger(docs).collect()}
    assert bits == {1: 1, 2: 0}
