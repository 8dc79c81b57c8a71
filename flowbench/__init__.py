"""flowbench: flow analytics and detector evaluation on PySpark."""

from flowbench.session import build_session, checkpoint
from flowbench.specs import DatasetSpec, FeatureSet, SplitSpec

__all__ = ["build_session", "checkpoint", "DatasetSpec", "FeatureSet", "SplitSpec"]
