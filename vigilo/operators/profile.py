"""Profiling, cleaning and admission checks for a tabular frame.

Every statistic is a single aggregation pass: Spark computes partial
aggregates per partition (map-side combine) and shuffles only those, so
the cost is one scan regardless of table size and skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long_format(row: DataFrame, cols: list[str], stats: list[str]) -> DataFrame:
    """One wide row (``<col>__<stat>``) -> one row per column."""
    entries = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols]
    return row.select(F.inline(F.array(*entries)))


def profile(df: DataFrame, cols: list[str], digits: int | None = 6) -> DataFrame:
    """count, mean, stddev (sample), min, max per column, like ``describe()``
    but typed (doubles, not text) and in long format."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        mean, std = F.avg(x), F.stddev_samp(x)
        if digits is not None:
            mean, std = F.round(mean, digits), F.round(std, digits)
        aggs += [F.count(x).alias(f"{c}__count"), mean.alias(f"{c}__mean"),
                 std.alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    return _long_format(df.agg(*aggs), cols, ["count", "mean", "stddev", "min", "max"])


def text_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, min and max of text columns, what ``describe()`` says of them."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__count"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    return _long_format(df.agg(*aggs), cols, ["count", "min", "max"])


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: the number of NULLs in each column (same column names)."""
    cols = cols or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Value counts, most frequent first (ties by value)."""
    return df.groupBy(col).count().orderBy(F.desc("count"), F.asc(col))


def distinct_count(df: DataFrame, col: str, exact: bool = True, name: str | None = None) -> DataFrame:
    agg = F.count_distinct(col) if exact else F.approx_count_distinct(col)
    return df.agg(agg.alias(name or f"{col}_nunique"))


def food_keep() -> Column:
    """Outlier and null filter for food rows (NULL numbers fail it too)."""
    return ((F.col("calories") > 0) & (F.col("calories") < 2000)
            & (F.col("weight_grams") > 5) & (F.col("weight_grams") < 2000)
            & F.col("food_item").isNotNull() & F.col("category").isNotNull())


def clean(df: DataFrame, keep: Column | None = None) -> DataFrame:
    return df.where(keep if keep is not None else food_keep())


def clean_counts(df: DataFrame, keep: Column | None = None,
                 ncols: int | None = None) -> DataFrame:
    """Rows, columns, kept and removed rows in one pass."""
    keep = keep if keep is not None else food_keep()
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.coalesce(keep, F.lit(False))).alias("kept_rows")) \
        .select("total_rows", F.lit(ncols if ncols is not None else len(df.columns))
                .alias("column_count"), "kept_rows",
                (F.col("total_rows") - F.col("kept_rows")).alias("removed_rows"))


def min_rows_gate(df: DataFrame, min_rows: int, fallback: DataFrame | None = None) -> DataFrame:
    """Admit ``df`` when it has at least ``min_rows`` rows.

    The check takes rows until there are enough, so a long input is read in
    few partitions only.  An empty input is an error; a short one is
    replaced by ``fallback`` when given, else an error.
    """
    seen = len(df.select(F.lit(1)).take(min_rows))
    if seen == 0:
        raise ValueError("empty input")
    if seen < min_rows:
        if fallback is None:
            raise ValueError(f"only {seen} rows, need {min_rows}")
        return fallback
    return df
