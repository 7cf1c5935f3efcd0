"""Food-shaped frames bound to the provided TPC-H-like tables.

``food_rows`` (one row per line item, joined to its part) stands in for
the food data set: the same ten columns the batch jobs read, plus the
line-item keys that give every row a total order.  ``catalog_rows`` is the
per-100 g nutrient catalogue (one row per part) and ``scored_rows`` adds a
deterministic stand-in prediction for the error statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.functions.joins import join_dimension
from vigilo.sources.tables import read_table

FOOD_COLUMNS = ["food_item", "category", "weight_grams", "calories", "protein_g", "carbs_g",
                "fat_g", "meal_time", "preparation_method", "timestamp"]
NUMERIC_FOOD = ["weight_grams", "calories", "protein_g", "carbs_g", "fat_g"]
CATEGORICAL_FOOD = ["food_item", "category", "meal_time", "preparation_method"]
# No single line-item column is unique; these six together order every row.
ORDER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
             "l_shipdate"]

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    "l_shipdate"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size",
                                              "p_retailprice"])


def food_rows(spark: SparkSession, sf_dir: str, keys: bool = True) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem", LINEITEM_COLUMNS)
    parts = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_type", "p_size")
    joined = join_dimension(items, parts, items["l_partkey"] == parts["p_partkey"])
    food = [
        F.col("p_name").alias("food_item"),
        F.col("p_type").alias("category"),
        (F.col("l_quantity") * 10).alias("weight_grams"),
        F.round(F.col("l_extendedprice") / 40, 1).alias("calories"),
        (F.col("l_discount") * 100).alias("protein_g"),
        (F.col("l_tax") * 100).alias("carbs_g"),
        F.col("p_size").cast("double").alias("fat_g"),
        F.col("l_returnflag").alias("meal_time"),
        F.col("l_linestatus").alias("preparation_method"),
        F.col("l_shipdate").alias("timestamp"),
    ]
    extra = [F.col(c) for c in ORDER_KEY] + [F.col("l_discount")] if keys else []
    return joined.select(*extra, *food)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Food rows with ``predicted_calories = calories * (1 - l_discount)``."""
    return food_rows(spark, sf_dir).withColumn(
        "predicted_calories", F.col("calories") * (1 - F.col("l_discount")))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nutrients per 100 g, one row per part (``part_key`` is the join key)."""
    return _parts(spark, sf_dir).select(
        F.col("p_partkey").alias("part_key"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        (F.col("p_retailprice") / 10).alias("base_cal"),
        (F.col("p_size") / 2.0).alias("protein"),
        F.col("p_size").cast("double").alias("carbs"),
        (F.col("p_size") / 5.0).alias("fat"),
    )


def portion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portions to scale: one per line item (weight in grams)."""
    return read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_quantity"]) \
        .select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_key"),
                (F.col("l_quantity") * 10).alias("raw_weight"))
