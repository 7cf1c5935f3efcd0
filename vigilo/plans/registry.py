"""All named queries and their oracle SQL, collected from the families."""

from __future__ import annotations

from vigilo.plans import (food_oracle, food_queries, io_oracle, io_queries, metric_oracle,
                          metric_queries, ml_oracle, ml_queries, scoring_oracle, scoring_queries, stream_oracle,
                          stream_queries)

QUERIES = {}
ORACLE_SQL = {}

for _queries, _oracle in [
    (scoring_queries.QUERIES, scoring_oracle.ORACLE),
    (food_queries.QUERIES, food_oracle.ORACLE),
    (metric_queries.QUERIES, metric_oracle.ORACLE),
    (io_queries.QUERIES, io_oracle.ORACLE),
    (stream_queries.QUERIES, stream_oracle.ORACLE),
    (ml_queries.QUERIES, ml_oracle.ORACLE),
]:
    QUERIES.update(_queries)
    ORACLE_SQL.update(_oracle)

assert set(ORACLE_SQL) <= set(QUERIES), set(ORACLE_SQL) - set(QUERIES)
