"""Column-name rules and schema look-ups. They touch the schema only, never the rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that different flow exporters give to the same column.
MAIN_ALIASES = {
    "classlabel": "class",
    "labelclass": "class",
    "class_label": "class",
    "label_class": "class",
    "total_backward_packets": "total_bwd_packets",
    "fwd_packets_length_total": "total_fwd_bytes",
    "bwd_packets_length_total": "total_bwd_bytes",
    "total_length_of_fwd_packets": "total_fwd_bytes",
    "total_length_of_bwd_packets": "total_bwd_bytes",
}

# Wider aliases used only to compare the column sets of two tables.
COMPARE_ALIASES = {
    "total_backward_packets": "total_bwd_packets",
    "subflow_fwd_packets": "total_fwd_packets",
    "subflow_bwd_packets": "total_bwd_packets",
    "fwd_packets_length_total": "total_fwd_bytes",
    "bwd_packets_length_total": "total_bwd_bytes",
    "total_length_of_fwd_packets": "total_fwd_bytes",
    "total_length_of_bwd_packets": "total_bwd_bytes",
    "subflow_fwd_bytes": "total_fwd_bytes",
    "subflow_bwd_bytes": "total_bwd_bytes",
    "destination_port": "dst_port",
    "classlabel": "class_label",
}

# Label names to look for when none is asked for, in order.
LABEL_CANDIDATES = (
    "label", "Label", "class", "Class", "result", "Result", "attack_label", "Attack_label", "attack_cat", "Attack",
)


class ColumnError(ValueError):
    """A column is missing, ambiguous or of the wrong type."""


def normalise_name(name: str, mode: str = "main") -> str:
    """One column name under the ``main``, ``lab``, ``compare`` or ``dotted`` rule."""
    text = str(name).strip().lower()
    if mode == "lab":
        return re.sub(r"[ /.\-]", "_", text)
    if mode == "dotted":
        text = text.replace(".", "_")
    elif mode not in ("main", "compare"):
        raise ValueError(f"unknown column-name rule: {mode}")
    text = re.sub(r"[^a-z0-9_]", "", re.sub(r"[/ ]", "_", text))
    text = re.sub(r"_{2,}", "_", text)
    aliases = {"main": MAIN_ALIASES, "compare": COMPARE_ALIASES}.get(mode, {})
    return aliases.get(text, text)


def normalise_columns(df: DataFrame, mode: str = "main") -> DataFrame:
    """Rename every column; two columns that would get the same name are an error that names both."""
    targets = [normalise_name(c, mode) for c in df.columns]
    repeated = {name for name, n in Counter(t.lower() for t in targets).items() if n > 1}
    if repeated:
        clashes = [f"{src} -> {dst}" for src, dst in zip(df.columns, targets) if dst.lower() in repeated]
        raise ColumnError("columns collide after renaming: " + ", ".join(clashes))
    return df.toDF(*targets)


def find_label(columns: Sequence[str], requested: str | None = None) -> str:
    """The label column: the requested one or the first known candidate, exact before normalised."""
    wanted = [requested] if requested else list(LABEL_CANDIDATES)
    for name in wanted:
        if name in columns:
            return name
    by_rule = {normalise_name(c, "lab"): c for c in columns}
    for name in wanted:
        found = by_rule.get(normalise_name(name, "lab"))
        if found is not None:
            return found
    raise ColumnError(f"no label column among {list(columns)}; looked for {wanted}")


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    """Names of numeric columns in schema order; booleans count only when asked for."""
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def column_kinds(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) names in schema order."""
    left_out = set(exclude)
    numeric = set(numeric_columns(df, booleans=True))
    names = [c for c in df.columns if c not in left_out]
    return [c for c in names if c in numeric], [c for c in names if c not in numeric]


def require_columns(df: DataFrame, names: Iterable[str], numeric: bool = False) -> list[str]:
    """The names, in the given order, after checking that they exist (and are numeric)."""
    names = list(names)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ColumnError(f"missing columns: {missing}")
    if numeric:
        known = set(numeric_columns(df, booleans=True))
        bad = [c for c in names if c not in known]
        if bad:
            raise ColumnError(f"columns are not numeric: {bad}")
    return names


def in_feature_order(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns a fitted detector expects, in its order, plus ``keep``."""
    require_columns(df, features)
    return df.select(*dict.fromkeys([*features, *keep]))


def flatten(df: DataFrame, mark: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns named by their dotted path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(
        *[F.col(".".join(f"`{part}`" for part in path)).alias(mark.join(path)) for path in leaves(df.schema, ())]
    )
