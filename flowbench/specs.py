"""Declarations of data sets, feature sets and splits."""

from __future__ import annotations

from dataclasses import dataclass

ALL_NUMERIC = "all_numeric_except_dropped"

# The shared 11 columns used to compare detectors across flow tables.
COMMON_FEATURES = (
    "flow_duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes",
    "fwd_packet_length_mean", "bwd_packet_length_mean", "flow_packets_s", "flow_bytes_s",
    "syn_flag_count", "urg_flag_count",
)

# The 19 numeric columns of the external table that do not leak provenance.
EXTERNAL_SAFE_FEATURES = (
    "src_port", "dst_port", "flow_duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes",
    "total_bwd_bytes", "total_packets", "total_bytes", "fwd_packet_length_mean", "bwd_packet_length_mean",
    "flow_bytes_s", "flow_packets_s", "syn_flag_count", "ack_flag_count", "rst_flag_count", "psh_flag_count",
    "fin_flag_count", "urg_flag_count",
)


@dataclass(frozen=True)
class DatasetSpec:
    """Where a flow table lies and which of its columns are label and non-features."""

    dataset_id: str
    path: str | None = None
    format: str = "parquet"
    label: str | None = "label"
    drop: tuple[str, ...] = ()
    train_path: str | None = None
    test_path: str | None = None


@dataclass(frozen=True)
class FeatureSet:
    """Ordered feature names, or every numeric column that is not dropped."""

    feature_set_id: str
    features: tuple[str, ...] | str = COMMON_FEATURES


@dataclass(frozen=True)
class SplitSpec:
    """How a table is cut into train and test rows.

    ``method`` is ``random``, ``attack_family_holdout`` or ``external_full``. ``row_key`` names columns that
    identify a row; the cut depends only on them and the seed, never on partition layout.
    """

    split_id: str
    method: str = "random"
    row_key: tuple[str, ...] = ("flow_id",)
    fraction: float = 0.2
    seed: int = 42
    stratify: bool = True
    group: str | None = None
    holdout: str | None = None
    drop: tuple[str, ...] = ()
    use_dataset_drop: bool = True


FEATURE_SETS = {
    "common": FeatureSet("common", COMMON_FEATURES),
    "all_numeric": FeatureSet("all_numeric", ALL_NUMERIC),
    "external_safe": FeatureSet("external_safe", EXTERNAL_SAFE_FEATURES),
}
