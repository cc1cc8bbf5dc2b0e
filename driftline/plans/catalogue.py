"""Loads every query module."""

from driftline.plans.registry import ORACLES, QUERIES  # noqa: F401
from driftline.plans import daily, q_graph, q_joins, q_models, q_pairs, q_policy, q_reports, q_series, q_sources, q_streaming, q_windows  # noqa: F401
