"""Toxicity: a learned lexicon, misspellings found by Levenshtein automata over its trie, and context windows.

The lexicon, the harmless look-alikes and the weights are learned from labelled rows, of which a bounded number is used. Every text is
scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import written

# Labelled rows to learn from, about; terms of the lexicon; words looked at more closely on the way to it.
TRAIN_ROWS = 30_000
MAX_TERMS = 400
MAX_CANDIDATES = 20_000
# A term occurs after so many different words in toxic rows, and at least this share of its rows is toxic.
CONTEXTS, PRECISION = 6, 0.9
# Shorter terms must be spelled right; longer ones may differ by one letter.
FUZZY_LENGTH = 5
# Code points on each side of a hit that decide between use and mention.
WINDOW = 60

_WORD = re.compile(r"[^\W\d_]+")
# Words of report and of address (fixed values, ours).
_REPORTS = frozenset("said says saying called quote quoted quotes wrote word words term mot mots dit sagte wort palabra dijo".split())
_DIRECT = frozenset("you your youre u ur tu toi vous du dich ihr usted eres".split())
_PAIRS = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}


class TermAutomaton:
    """All words within one edit of a lexicon term: the terms' Levenshtein automata run together along the trie of the terms.

    A state is a set of (trie node, errors so far); states are made when a word first reaches them and kept, so that known
    paths cost one lookup a letter. There are only as many as the terms allow.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][letter]
            self.term[node] = term
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        for node in [n for n, e in nodes.items() if e == 0]:  # a letter of the term is missing
            for child in self.children[node].values():
                nodes.setdefault(child, 1)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, t) for n, e in key if (t := self.term[n]) is not None and (e == 0 or len(t) >= FUZZY_LENGTH)]
            self.accepts.append(min(found, default=None))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= 1 and errors < nodes.get(node, 2):
                nodes[node] = errors

        for node, errors in self.sets[state]:
            for own, child in self.children[node].items():
                reach(child, errors + (own != letter))
            reach(node, errors + 1)  # a letter too many
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, str] | None:
        """Errors and term of the nearest term (of equally near ones the first) within reach, or None."""
        state = self.start
        for letter in word:
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self._step(state, letter)
            state = after
            if not self.sets[state]:
                return None
        return self.accepts[state]


@dataclass(frozen=True)
class ToxicityModel:
    """What was learned: terms, harmless words near them, and the weights of ``FEATURES`` with the intercept."""

    terms: tuple[str, ...]
    harmless: frozenset[str]
    weights: tuple[float, ...]
    intercept: float


FEATURES = ("any_exact", "exact", "any_near", "near", "density")


class Reader:
    """Finds a model's hits in texts and remembers the words it has looked up."""

    REMEMBERED = 1_000_000

    def __init__(self, terms: tuple[str, ...], harmless: frozenset[str]):
        self.automaton, self.harmless = TermAutomaton(list(terms)), harmless
        self.hits: dict[str, tuple[int, str]] = {}
        self.plain: set[str] = set()

    def hits_of(self, text: str) -> list[dict]:
        """Every hit with its place, term, errors and context weight."""
        low = text.lower()
        words = set(_WORD.findall(low))
        for word in words - self.plain:
            if word in self.hits:
                continue
            found = self.automaton.match(word)
            if found is None or word in self.harmless:
                if len(self.plain) >= self.REMEMBERED:
                    self.plain.clear()
                self.plain.add(word)
            else:
                self.hits[word] = found
        if words.isdisjoint(self.hits):
            return []
        out = []
        for m in _WORD.finditer(low):
            if m[0] in self.hits:
                errors, term = self.hits[m[0]]
                out.append({"begin": m.start(), "end": m.end(), "word": m[0], "term": term, "errors": errors, "weight": context(low, m.start(), m.end())})
        return out


def context(text: str, begin: int, end: int) -> float:
    """1 for plain use; less where the hit is quoted or talked about, more where it addresses someone."""
    before, after = text[max(0, begin - WINDOW) : begin], text[end : end + WINDOW]
    before, after = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    weight = 1.0
    for left, right in _PAIRS.items():
        opened = before.count(left) % 2 if left == right else before.rfind(left) > before.rfind(right)
        if opened and right in after:
            weight *= 0.3
            break
    near = set(_WORD.findall(before)[-5:]) | set(_WORD.findall(after)[:5])
    if near & _REPORTS:
        weight *= 0.5
    if near & _DIRECT:
        weight *= 1.5
    return weight


def features(hits: list[dict], n_chars: int) -> list[float]:
    exact = sum(h["weight"] for h in hits if h["errors"] == 0)
    near = sum(h["weight"] for h in hits if h["errors"])
    return [min(1.0, exact), math.log1p(exact), min(1.0, near), math.log1p(near), math.log1p(1000 * (exact + near) / (n_chars + 1000))]


def training_rows(docs: DataFrame, labels: DataFrame, held_out, bound: int = TRAIN_ROWS) -> DataFrame:
    """``id``, ``text``, ``y`` of about ``bound`` labelled rows that ``held_out`` (a condition on ``doc_id``) leaves; of equal texts one.

    Rows are chosen by a hash of the id. A document with several labels counts as toxic if one of them says so; null labels are ignored.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = written(known, "labels")
    share = min(1.0, bound / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").join(picked, "doc_id")
    digest = F.xxhash64("text")
    texts = written(texts.select(F.col("doc_id").alias("id"), "text", "y", digest.alias("same")), "toxic-sample")
    one = texts.groupBy("same").agg(F.min("id").alias("id"))
    return texts.join(one, ["same", "id"], "left_semi").select("id", "text", "y")


def learn(docs: DataFrame, labels: DataFrame, held_out, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns a model from labelled documents (``doc_id``, ``text``; ``doc_id``, ``toxic``). Without toxic rows it has no terms."""
    rows = written(training_rows(docs, labels, held_out, bound), "toxic-train")
    counts = rows.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counts.where((F.col("toxic") >= CONTEXTS) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    # At most MAX_CANDIDATES words.
    candidates = frozenset(r["word"] for r in likely.orderBy(F.desc("toxic"), "word").limit(MAX_CANDIDATES).select("word").collect())
    # Copies repeat a word with its surroundings: a term must follow many different words.
    pairs = rows.where("y = 1").mapInArrow(_contexts(candidates), "word string, before string").distinct()
    seen = pairs.groupBy("word").count().where(F.col("count") >= CONTEXTS).orderBy(F.desc("count"), "word").limit(MAX_TERMS).collect()
    terms = tuple(sorted(r["word"] for r in seen))
    # Words of clean rows within one edit of a term; there are only so many such words.
    near = rows.where("y = 0").mapInArrow(_near(terms), "word string").distinct().collect()
    harmless = frozenset(r["word"] for r in near) - frozenset(terms)
    fit = rows.mapInArrow(_featured(terms, harmless), "x array<double>, y double")
    fit = written(fit, "toxic-features").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    if fit.select("label").distinct().count() < 2:
        return ToxicityModel(terms, harmless, (0.0,) * len(FEATURES), -10.0)
    model = LogisticRegression(regParam=1e-4, standardization=False, maxIter=50).fit(fit)
    return ToxicityModel(terms, harmless, tuple(max(0.0, w) for w in model.coefficients), float(model.intercept))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            (toxic if y else clean).update(set(_WORD.findall(text.lower())))
        words = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])


def _contexts(words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                own = ["", *_WORD.findall(text.lower())]
                found.update((b, a) for a, b in zip(own, own[1:]) if b in words)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["word", "before"])

    return run


def _near(terms: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, frozenset())
        for batch in batches:
            found = {h["word"] for text in batch.column("text").to_pylist() for h in reader.hits_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return run


def _featured(terms: tuple[str, ...], harmless: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, harmless)
        for batch in batches:
            x = [features(reader.hits_of(text), len(text)) for text in batch.column("text").to_pylist()]
            y = [float(y) for y in batch.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])

    return run


HITS = "array<struct<begin:long,end:long,word:string,term:string,errors:int,weight:double>>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1) and ``hits`` (place in code points of the lower-cased text, word, term, errors, context weight).

    Null and empty texts have no hit and get the score of a text without one. Repeated rows and null ids give a row each; other columns
    are not returned; an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS and one edit around them
    hit = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("word", pa.string()), ("term", pa.string()), ("errors", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.terms, model.harmless)
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                hits = reader.hits_of(text)
                z = model.intercept + sum(w * x for w, x in zip(model.weights, features(hits, len(text))))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
                found.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(hit))], names=["id", "score", "hits"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, f"id {kind}, score double, hits {HITS}").withColumnRenamed("id", id_col)
