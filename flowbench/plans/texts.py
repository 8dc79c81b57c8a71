"""SQL fragments for the independent checks; each query's check is one ``WITH`` chain built from them."""

from __future__ import annotations

from flowbench.plans.flows import ATTACK_RULE, FLOWS_SQL, RUNS_SQL
from flowbench.specs import COMMON_FEATURES

STRICT = "CASE WHEN lower(trim({0})) IN ('benign','normal','0') THEN 0 ELSE 1 END"
LENIENT = (
    "CASE WHEN lower(translate(trim({0}), '- ', '__')) IN ('benign','normal','0','false','legitimate','background') "
    "THEN 'benign' ELSE 'attack' END"
)
CLASS_TEXT = "coalesce(lower(translate(trim({0}), '- ', '__')), 'missing')"

FEATURE_LIST = ", ".join(COMMON_FEATURES)

# Rows whose 11 common features are all present and finite, with the strict label as y.
PREPARED = f"""
SELECT flow_id, class, label AS original_label, dataset_source, {STRICT.format('label')} AS label, {FEATURE_LIST}
FROM flows WHERE flow_bytes_s IS NOT NULL AND NOT isinf(flow_bytes_s)"""


def chain(final: str, **steps: str) -> str:
    """``WITH a AS (…), b AS (…) final``."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in steps.items()) + "\n" + final


def on_flows(final: str, **steps: str) -> str:
    return chain(final, flows=FLOWS_SQL, **steps)


def on_prepared(final: str, **steps: str) -> str:
    return chain(final, flows=FLOWS_SQL, prepared=PREPARED, **steps)


def on_runs(final: str, **steps: str) -> str:
    return chain(final, runs=RUNS_SQL, **steps)


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END"


def binary_metric_steps(counts: str) -> dict[str, str]:
    """From a step with tn, fp, fn, tp to steps ``_a`` … ``scored`` with every binary score."""
    a = (
        f"SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, "
        f"{ratio('tn', 'tn + fn')} AS p0, {ratio('tn', 'tn + fp')} AS r0, tn + fp + fn + tp AS total FROM {counts}"
    )
    b = (
        "SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1, "
        "CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2.0 * p0 * r0 / (p0 + r0) END AS f0 FROM _a"
    )
    c = (
        f"SELECT *, {ratio('tp + tn', 'total')} AS accuracy, (r0 + recall) / 2 AS balanced_accuracy, "
        "(p0 + precision) / 2 AS precision_macro, (r0 + recall) / 2 AS recall_macro, (f0 + f1) / 2 AS f1_macro, "
        "CASE WHEN total = 0 THEN 0.0 ELSE (f0 * (tn + fp) + f1 * (fn + tp)) / total END AS f1_weighted, "
        "tn + fp AS support_0, fn + tp AS support_1, tn + fn AS predicted_0, fp + tp AS predicted_1 FROM _b"
    )
    return {"_a": a, "_b": b, "scored": c}


COUNT_NAMES = ("tn", "fp", "fn", "tp", "support_0", "support_1", "predicted_0", "predicted_1")
SCORE_NAMES = (
    "accuracy", "balanced_accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro", "f1_weighted",
)


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


SCORED_COLUMNS = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in COUNT_NAMES) + ", " + rounded(SCORE_NAMES)
