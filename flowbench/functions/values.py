"""Cell-level rules: labels, missing values, times, rates and texts. All are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label texts that mean "benign" under the strict and the lenient rule.
STRICT_BENIGN = ("benign", "normal", "0")
LENIENT_BENIGN = ("benign", "normal", "0", "false", "legitimate", "background")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(value.cast("string"), F.lit(" \t\r\n\f\v"))


# --- labels ---------------------------------------------------------------------------------------------------


def strict_label(value: Column | str) -> Column:
    """0 for benign texts, 1 for any other value; a null label stops the job."""
    text = F.lower(strip(as_column(value)))
    return (
        F.when(text.isNull(), F.raise_error(F.lit("a label is missing")).cast("int"))
        .when(text.isin(*STRICT_BENIGN), F.lit(0))
        .otherwise(F.lit(1))
    )


def class_text(value: Column | str) -> Column:
    """Class name in lower case with ``-`` and blanks as ``_``; a null becomes ``missing``."""
    text = F.lower(F.translate(strip(as_column(value)), "- ", "__"))
    return F.coalesce(text, F.lit("missing"))


def lenient_label(value: Column | str) -> Column:
    """``benign`` or ``attack``; null and unknown texts are attacks."""
    return F.when(class_text(value).isin(*LENIENT_BENIGN), F.lit("benign")).otherwise(F.lit("attack"))


def same_group(value: Column | str, wanted: str) -> Column:
    """Trimmed, case-blind equality; never null, so it can be negated safely."""
    return F.coalesce(F.lower(strip(as_column(value))) == F.lit(wanted.strip().lower()), F.lit(False))


def or_token(value: Column | str, token: str = "<missing>") -> Column:
    return F.coalesce(as_column(value).cast("string"), F.lit(token))


# --- numbers --------------------------------------------------------------------------------------------------


def number(value: Column | str) -> Column:
    """Double value of a cell, null where the text is no number. Infinities and NaN are kept."""
    return as_column(value).try_cast("double")


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def finite_or_null(value: Column | str) -> Column:
    """Double value with NaN and both infinities as null. The text ``inf`` counts as infinite, too."""
    x = number(value)
    return F.when(is_finite(x), x)


def is_finite(x: Column) -> Column:
    """True for finite numbers, false for infinities and NaN (which sorts above them), null for null."""
    return F.abs(x) < F.lit(float("inf"))


def finite_or(value: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(default))


def is_missing(value: Column, kind: T.DataType) -> Column:
    """Null, or NaN in a floating column."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# --- cleaning of whole tables ---------------------------------------------------------------------------------


def complete_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows whose features and label are all present, features as doubles; other columns may be null.

    One comparison per feature decides; it is false or null for every kind of missing cell.
    """
    present = F.col(label).isNotNull()
    for c in features:
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        present = present & (F.col(c).isNotNull() if whole else is_finite(number(c)))
    return df.where(present).withColumns({c: number(c) for c in features})


def with_rates(
    df: DataFrame,
    duration: str = "flow_duration",
    packets: tuple[str, str] = ("total_fwd_packets", "total_bwd_packets"),
    octets: tuple[str, str] = ("total_fwd_bytes", "total_bwd_bytes"),
    floor: float = 1e-6,
) -> DataFrame:
    """Totals and per-second rates; durations below the floor count as the floor."""
    seconds = F.greatest(F.col(duration), F.lit(floor))
    n_packets = F.col(packets[0]) + F.col(packets[1])
    n_bytes = F.col(octets[0]) + F.col(octets[1])
    return df.withColumns(
        {
            "total_packets": n_packets,
            "total_bytes": n_bytes,
            "flow_bytes_s": n_bytes / seconds,
            "flow_packets_s": n_packets / seconds,
        }
    )


# --- time -----------------------------------------------------------------------------------------------------


def utc_micros(value: Column | str, kind: T.DataType) -> Column:
    """Microseconds since 1970 in UTC: numbers are epoch seconds, texts are timestamps, bad cells are null,
    numbers outside the range of 64 bits, too.

    The result does not depend on the session time zone.
    """
    col = as_column(value)
    if isinstance(kind, T.NumericType):
        seconds = finite_or_null(col)
        return F.round(seconds * F.lit(1e6)).try_cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col)
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(col.cast("timestamp"))
    text = strip(col)
    zoned = F.when(text.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d"), text).otherwise(
        F.concat(text, F.when(text.rlike(r"\d:\d"), F.lit("Z")).otherwise(F.lit(" 00:00:00Z")))
    )
    return F.unix_micros(zoned.try_cast("timestamp"))


def clock_text(seconds: Column | str) -> Column:
    """Seconds, rounded half to even, as ``HH:MM:SS``; hours may exceed two digits."""
    s = F.bround(as_column(seconds), 0).cast("bigint")

    def two(x: Column) -> Column:
        text = x.cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))


def short_duration(seconds: Column | str) -> Column:
    """Seconds as the two largest units, such as ``1h 2m``, ``3m 4s`` or ``5s``."""
    s = F.floor(as_column(seconds)).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )
