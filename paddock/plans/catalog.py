"""Imports every module that registers queries."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401
    q_blends, q_domain, q_encoders, q_features, q_folds, q_metrics, q_models, q_reports, q_sources, q_timeline,
)
