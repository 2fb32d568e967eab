"""Registered queries; importing this package fills the registry."""

from lakeledger.plans import q_alerts, q_anomalies, q_eventlog, q_functions, q_graph, q_jobs, q_lists, q_quality, q_schema, q_streaming, q_tables  # noqa: F401
from lakeledger.plans.registry import ORACLES, QUERIES  # noqa: F401
