"""All registered queries."""

from depthlog.plans import (feature_queries, metric_queries, quality_queries, series_queries, join_queries,
                            learning_queries)  # noqa: F401
from depthlog.plans.registry import ORACLES, QUERIES  # noqa: F401
