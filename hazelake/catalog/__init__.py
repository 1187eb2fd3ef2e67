"""All registered queries and their SQL counterparts."""

from hazelake.catalog import q_alerts, q_features, q_models, q_stats, q_streaming, q_tables  # noqa: F401
from hazelake.catalog.register import oracle_queries, spark_queries  # noqa: F401
