"""All registered queries."""

from . import audit_queries, sample_queries, normalize_queries, rollout_queries, metric_queries, score_queries, table_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES, SURVEY  # noqa: F401
