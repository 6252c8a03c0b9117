"""All registered queries."""

from tsfoundry.plans import (  # noqa: F401
    q_align, q_filters, q_metrics, q_models, q_scalars, q_sources, q_stats, q_streaming, q_windows,
)
from tsfoundry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
