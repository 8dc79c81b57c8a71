"""Detectors made of fixed or quantile-calibrated rules; each rule is one boolean column expression."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.names import require_columns
from flowbench.functions.values import number
from flowbench.operators.order import exact_quantiles

CORE = (
    "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes",
    "flow_packets_s", "flow_bytes_s", "syn_flag_count",
)

@dataclass(frozen=True)
class Test:
    """``column`` compared with ``limit``, or with ``limit`` times one more than ``per``.

    ``a+b`` is the sum of two columns. A test on a column that the table lacks gives ``absent``.
    """

    column: str
    sign: str
    limit: float
    per: str | None = None
    absent: bool = False


@dataclass(frozen=True)
class Rule:
    """Holds if every test of ``all_of`` and one of ``any_of`` (if there are any) hold, and, if ``fast``, the flow is fast.

    A rule that decides alone flags a flow; of the others two have to agree.
    """

    name: str
    alone: bool
    fast: bool = False
    all_of: tuple[Test, ...] = ()
    any_of: tuple[Test, ...] = ()


_PACKETS = "total_fwd_packets+total_bwd_packets"
# The limits of the rules, per second for rates, per flow for counts, in microseconds for times. What makes a flow
# fast, and the rules in the order in which they are reported.
FAST = (Test("flow_packets_s", ">=", 25_000), Test("flow_bytes_s", ">=", 1_000_000))
RULE_TABLE = (
    Rule("extreme_rate", True, any_of=(Test("flow_packets_s", ">=", 100_000), Test("flow_bytes_s", ">=", 10_000_000))),
    Rule("high_rate", False, fast=True),
    Rule(
        "syn_flood",
        True,
        all_of=(Test("syn_flag_count", ">=", 1), Test("total_bwd_packets", "<=", 1), Test("ack_flag_count", "==", 0, absent=True)),
        any_of=(Test("total_fwd_packets", ">=", 20), Test("flow_packets_s", ">=", 10_000)),
    ),
    Rule(
        "one_way_flood",
        False,
        all_of=(Test("total_bwd_packets", "==", 0), Test("total_fwd_packets", ">=", 20)),
        any_of=(Test("total_fwd_bytes", ">=", 10_000), Test("flow_packets_s", ">=", 5_000)),
    ),
    Rule(
        "amplification",
        True,
        all_of=(Test("total_bwd_packets", ">=", 5), Test("flow_bytes_s", ">=", 500_000), Test("total_bwd_bytes", ">=", 5, per="total_fwd_bytes")),
    ),
    Rule("interarrival_burst", False, fast=True, all_of=(Test(_PACKETS, ">=", 40), Test("flow_iat_mean", "<=", 1_000), Test("flow_iat_std", "<=", 5_000))),
    Rule(
        "regular_small_packet_burst",
        False,
        fast=True,
        all_of=(Test(_PACKETS, ">=", 40), Test("packet_length_mean", "<=", 256), Test("packet_length_std", "<=", 25)),
    ),
    Rule(
        "control_packet_flood",
        False,
        fast=True,
        all_of=(Test("total_fwd_packets", ">=", 20), Test("fwd_act_data_packets", "<=", 1), Test("fwd_header_length", ">=", 0.5, per="total_fwd_bytes")),
    ),
    Rule("reset_flood", False, fast=True, all_of=(Test("total_bwd_packets", "<=", 1), Test("rst_flag_count", ">=", 3))),
    Rule("subflow_burst", False, fast=True, all_of=(Test("subflow_fwd_packets", ">=", 40), Test("subflow_bwd_packets", "<=", 1))),
    Rule(
        "incomplete_tcp_burst",
        True,
        fast=True,
        all_of=(
            Test("syn_flag_count", ">=", 1),
            Test("total_bwd_packets", "==", 0),
            Test("ack_flag_count", "==", 0),
            Test("psh_flag_count", "==", 0),
            Test("fin_flag_count", "==", 0),
        ),
    ),
)
STRONG = tuple(r.name for r in RULE_TABLE if r.alone)
SUPPORTING = tuple(r.name for r in RULE_TABLE if not r.alone)
RULES = tuple(r.name for r in RULE_TABLE)
_SIGNS = {">=": operator.ge, "<=": operator.le, "==": operator.eq}


def _cell(name: str) -> Column:
    """A feature as a number; missing and unreadable cells count as 0."""
    value = number(name)
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def _holds(test: Test, have: set[str]) -> Column:
    names = test.column.split("+")
    if not have.issuperset(names):
        return F.lit(test.absent)
    limit = F.lit(float(test.limit)) if test.per is None else F.lit(float(test.limit)) * (_cell(test.per) + 1)
    return _SIGNS[test.sign](reduce(operator.add, map(_cell, names)), limit)


def flow_rules(columns: Sequence[str]) -> dict[str, Column]:
    """The rules of the table as boolean columns. A rule whose optional columns are absent never fires; without an
    ACK column every flow counts as having no ACK in the SYN rule."""
    have = set(columns)
    fast = reduce(operator.or_, [_holds(t, have) for t in FAST])
    found = {}
    for rule in RULE_TABLE:
        parts = [fast] * rule.fast + [_holds(t, have) for t in rule.all_of]
        if rule.any_of:
            parts.append(reduce(operator.or_, [_holds(t, have) for t in rule.any_of]))
        found[rule.name] = reduce(operator.and_, parts)
    return found


def with_rules(df: DataFrame, prefix: str = "rule_") -> DataFrame:
    """Adds every rule as a boolean column, the number of supporting votes and the 0/1 ``prediction``.

    Any strong rule flags a flow; otherwise two supporting rules have to agree. Works on streams unchanged.
    """
    require_columns(df, CORE)
    marked = df.withColumns({f"{prefix}{name}": rule for name, rule in flow_rules(df.columns).items()})
    votes = sum((F.col(f"{prefix}{name}").cast("int") for name in SUPPORTING), F.lit(0))
    strong = F.lit(False)
    for name in STRONG:
        strong = strong | F.col(f"{prefix}{name}")
    return marked.withColumn("votes", votes).withColumn("prediction", (strong | (F.col("votes") >= 2)).cast("int"))


def predict_rules(df: DataFrame) -> DataFrame:
    """The input plus ``prediction`` alone."""
    return with_rules(df).select(*df.columns, "prediction")


def rule_hits(df: DataFrame) -> DataFrame:
    """How often each rule fires and how many flows are flagged, in one pass: ``rule, hits``."""
    marked = with_rules(df)
    names = {**{n: f"rule_{n}" for n in RULES}, "final_predicted_malicious": "prediction"}
    row = marked.agg(*[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("bigint").alias(n) for n, c in names.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])
    return row.select(F.inline(cells))


# --- rules calibrated on benign traffic -----------------------------------------------------------------------


@dataclass(frozen=True)
class CalibratedRules:
    """Limits taken from benign training rows; two of four rules flag a flow."""

    packet_rate: float
    byte_rate: float
    syn: float
    replies: float
    duration: float
    packets: float

    @staticmethod
    def fit(train: DataFrame, label: str = "label", direct_limit: int | None = None) -> "CalibratedRules":
        """Rates at the 99.5th, other upper limits at the 99th and lower limits at the 10th percentile."""
        benign = train.where(F.col(label) == 0)
        wanted = {
            "flow_packets_s": [0.995],
            "flow_bytes_s": [0.995],
            "syn_flag_count": [0.99],
            "total_bwd_packets": [0.1],
            "flow_duration": [0.1],
            "total_fwd_packets": [0.99],
        }
        options = {} if direct_limit is None else {"direct_limit": direct_limit}
        q = {c: v[0] for c, v in exact_quantiles(benign, wanted, **options).items()}
        if any(v is None for v in q.values()):
            raise ValueError("the training rows hold no benign flow to calibrate on")
        return CalibratedRules(
            q["flow_packets_s"], q["flow_bytes_s"], q["syn_flag_count"],
            q["total_bwd_packets"], q["flow_duration"], q["total_fwd_packets"],
        )

    def score(self, df: DataFrame) -> DataFrame:
        rules = [
            F.col("flow_packets_s") > self.packet_rate,
            F.col("flow_bytes_s") > self.byte_rate,
            (F.col("syn_flag_count") > self.syn) & (F.col("total_bwd_packets") <= self.replies),
            (F.col("flow_duration") <= self.duration) & (F.col("total_fwd_packets") > self.packets),
        ]
        votes = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))
        return df.withColumn("votes", votes).withColumn("prediction", (F.col("votes") >= 2).cast("int"))
