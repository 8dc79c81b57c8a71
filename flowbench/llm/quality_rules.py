"""Quality rules as a ledger: every rule is evaluated once and kept as a bit, policies are masks over the bits.

DataFrame functions only. The ledger is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import SPACE

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if ``fails`` (over the measurements) is true. ``bit`` never changes once published."""

    bit: int
    name: str
    fails: Column


def rules() -> tuple[Rule, ...]:
    """The rules, by bit. Bits 0 and 1 are the base rules."""
    c = F.col
    return (
        Rule(0, "few_words", c("n_words") < 10),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule(2, "symbols", 2 * c("n_symbols") > c("n_words")),
        Rule(3, "repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule(4, "word_length", (c("word_chars") > 25 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        Rule(5, "exclamations", c("n_marks") > c("n_words")),
    )


# Versioned policies: the bits a document must not have.
POLICIES = {"base": 0b000011, "v1": 0b001111, "v2": 0b111111}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The table's columns with the measurements (longs) and ``fail_bits`` (long), each name after ``prefix``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_marks`` (exclamation marks), ``n_lines`` (lines
    with a word), ``n_dup_lines`` (of those, equal to an earlier one), ``n_repeat_words`` (words in 5-word windows that the text holds
    twice or more, the first included; windows are compared by 64-bit hashes of their words). A null text counts as empty and
    fails the rule on few words. Repeated rows give a row each. A name that the table already has is an error; choose a prefix.
    """
    names = [prefix + m for m in (*MEASURES, "fail_bits")]
    if clash := sorted({c.lower() for c in docs.columns} & {n.lower() for n in names}):
        raise ValueError(f"the table already has {clash}")
    own = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    words = inner.select(
        "own",
        "t",
        F.array_remove(F.split("t", SPACE + "+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE + "+", "")) > 0).alias("lines"),
    )
    hashed = words.select(
        "own",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", "!+", ""))).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    windows = hashed.withColumn(
        "w", F.when(F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    )
    # Most texts repeat no window; only the others are sorted.
    ordered = windows.withColumn(
        "s", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.array_sort(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    )
    same = lambda k, m: F.get("s", k)["w"].eqNullSafe(F.get("s", m)["w"])
    twice = ordered.withColumn(
        "p",
        F.array_sort(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
                lambda k: F.get("s", k)["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 1),
        F.lit(0).cast("long"),
        lambda total, j: total + F.coalesce(F.least(F.lit(WINDOW), F.get("p", j + 1) - F.get("p", j)), F.lit(WINDOW)),
    )
    measured = twice.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(covered))
    bits = sum((F.when(r.fails, F.lit(1 << r.bit)).otherwise(0) for r in rules()), F.lit(0)).cast("long")
    results = F.struct(*[F.col(m).alias(prefix + m) for m in (*MEASURES, "fail_bits")])
    # A generated row: a later filter on the bits is not pushed below it, where it would measure every text again.
    return measured.withColumn("fail_bits", bits).select("own", F.inline(F.array(results))).select("own.*", *names)


def passes(policy: str, fail_bits: str = "fail_bits") -> Column:
    """Whether a ledger row meets a policy."""
    return F.col(fail_bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str, fail_bits: str = "fail_bits") -> DataFrame:
    """What each rule of a policy does: ``rule``, ``bit``, ``failed`` (rows that fail it) and ``only`` (rows that no other rule of the
    policy rejects, so that dropping the rule would keep them), from the stored bits in one aggregate. An empty ledger gives zeros."""
    mask = POLICIES[policy]
    chosen = [r for r in rules() if mask >> r.bit & 1]
    bits = F.col(fail_bits).bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count_if(bits.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}") for r in chosen]
    sums += [F.count_if(bits == (1 << r.bit)).alias(f"o{r.bit}") for r in chosen]
    lines = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("only")) for r in chosen])
    return rows.agg(*sums).select(F.inline(lines))
