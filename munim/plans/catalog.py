"""All registered queries; importing this module registers them."""

from munim.plans import (  # noqa: F401
    aggregate_queries,
    anomaly_queries,
    classify_queries,
    clean_queries,
    document_queries,
    forecast_queries,
    insight_queries,
)
from munim.plans.registry import ORACLES, QUERIES  # noqa: F401
