"""Dimension joins, planned by Spark.

No side is forced: the automatic broadcast threshold (bytes) and adaptive
execution (real shuffle sizes, skewed partitions split) choose the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    return fact.join(dim, on=on, how=how)
