"""Named queries over the food-shaped data (profile, clean, features,
catalogue portions, encoders, splits, errors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators import encode as E
from vigilo.operators import features as FT
from vigilo.operators import profile as P
from vigilo.operators import split as SP
from vigilo.operators.encoder_stage import CodeEncoder
from vigilo.operators.metrics import epoch_micros
from vigilo.sources.food import (CATEGORICAL_FOOD, FOOD_COLUMNS, NUMERIC_FOOD, ORDER_KEY,
                                 catalog_rows, food_rows, portion_rows, scored_rows)
from vigilo.sources.tables import read_table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURE_PROFILE = ["weight_normalized", "calorie_density", "protein_ratio", "carb_ratio",
                   "fat_ratio"]
INDEXED = ["category", "meal_time", "preparation_method"]


def _food(spark, sf_dir) -> DataFrame:
    return food_rows(spark, sf_dir).drop("l_discount")


def clean_food(spark, sf_dir) -> DataFrame:
    return P.clean(_food(spark, sf_dir))


def q_food_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_food(spark, sf_dir)


def q_clean_counts(spark, sf_dir):
    return P.clean_counts(_food(spark, sf_dir), ncols=len(FOOD_COLUMNS))


def q_food_profile(spark, sf_dir):
    return P.profile(_food(spark, sf_dir), NUMERIC_FOOD)


def q_food_text_profile(spark, sf_dir):
    return P.text_profile(_food(spark, sf_dir), CATEGORICAL_FOOD)


def q_food_missing(spark, sf_dir):
    """Missing values, in a frame that has some: calories out of range and the
    preparation of returned items are unknown."""
    food = _food(spark, sf_dir).withColumns({
        "calories": F.when(F.col("calories") < 2000, F.col("calories")),
        "preparation_method": F.when(F.col("meal_time") != "R", F.col("preparation_method"))})
    return P.missing_counts(food, FOOD_COLUMNS)


def q_category_distribution(spark, sf_dir):
    return P.distribution(_food(spark, sf_dir), "category")


def q_meal_distribution(spark, sf_dir):
    return P.distribution(_food(spark, sf_dir), "meal_time")


def q_category_nunique(spark, sf_dir):
    return P.distinct_count(clean_food(spark, sf_dir), "category")


def q_category_counts(spark, sf_dir):
    return clean_food(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def q_food_features(spark, sf_dir):
    return FT.add_features(clean_food(spark, sf_dir))


def q_food_features_sql(spark, sf_dir):
    return FT.add_features_sql(clean_food(spark, sf_dir), view="vigilo_food_data")


def q_food_features_ext(spark, sf_dir):
    df = FT.add_extended_features(clean_food(spark, sf_dir))
    return df.withColumn("log_weight", F.round("log_weight", 9))


def q_feature_profile(spark, sf_dir):
    return P.profile(FT.add_features(clean_food(spark, sf_dir)), FEATURE_PROFILE)


def q_group_summary(spark, sf_dir):
    """Mean nutrients and count per group, ordered by group."""
    df = FT.add_features(clean_food(spark, sf_dir))
    return (df.groupBy("calorie_category")
            .agg(*[F.round(F.avg(c), 6).alias(a) for c, a in
                   [("calories", "avg_calories"), ("protein_g", "avg_protein"),
                    ("carbs_g", "avg_carbs"), ("fat_g", "avg_fat")]],
                 F.count(F.lit(1)).alias("count"))
            .orderBy("calorie_category"))


def q_portion_nutrients(spark, sf_dir):
    scaled = FT.scale_portions(portion_rows(spark, sf_dir), catalog_rows(spark, sf_dir))
    return FT.with_padded_id(scaled, F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", "sample_id", F.col("name").alias("food_item"), "category",
        "weight_grams", "calories", "protein_g", "carbs_g", "fat_g")


def q_food_provenance(spark, sf_dir):
    """The generated rows with their creation time (pinned) and source."""
    now = F.lit("2024-02-01 00:00:00.25").cast("timestamp_ntz")
    rows = FT.with_provenance(q_portion_nutrients(spark, sf_dir), now)
    return rows.select("l_orderkey", "l_linenumber", "sample_id", "calories", "created_at", "data_source")


def q_format_times(spark, sf_dir):
    events = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    return FT.format_times(events).drop("ts")


def _errors(spark, sf_dir):
    return FT.add_prediction_errors(scored_rows(spark, sf_dir))


def q_prediction_errors(spark, sf_dir):
    return _errors(spark, sf_dir).select(*KEYS, "calories", "predicted_calories",
                                         "prediction_error", "prediction_error_pct")


def q_prediction_stats(spark, sf_dir):
    return FT.prediction_stats(_errors(spark, sf_dir))


def q_regression_metrics(spark, sf_dir):
    return FT.regression_metrics(scored_rows(spark, sf_dir), "calories", "predicted_calories")


def q_prediction_sample(spark, sf_dir):
    """First 10 predictions in a defined (total) order."""
    return (scored_rows(spark, sf_dir).orderBy(*ORDER_KEY).limit(10)
            .select(*KEYS, "food_item", "calories",
                    F.col("predicted_calories").alias("prediction"), "category"))


def q_topk(spark, sf_dir):
    """Five densest foods (calories per gram), ties broken by the row key."""
    df = FT.add_features(clean_food(spark, sf_dir))
    return (df.orderBy(F.desc("calorie_density"), *ORDER_KEY).limit(5)
            .select(*KEYS, "food_item", "calorie_density"))


def q_min_rows_gate(spark, sf_dir):
    food = _food(spark, sf_dir)
    portions = FT.scale_portions(portion_rows(spark, sf_dir), catalog_rows(spark, sf_dir))
    return P.min_rows_gate(food, 5000, fallback=portions)


def _catalog_food(spark, sf_dir):
    return catalog_rows(spark, sf_dir).select(
        "part_key", F.col("name").alias("food_item"), F.col("base_cal").alias("calories"),
        F.col("protein").alias("protein_g"))


def q_food_summary(spark, sf_dir):
    df = _catalog_food(spark, sf_dir)
    return df.agg(F.count(F.lit(1)).alias("total_items"),
                  F.round(F.avg("calories"), 6).alias("mean_calories"),
                  F.count_if(F.col("protein_g") >= 20).alias("high_protein_count"))


def q_high_protein_foods(spark, sf_dir):
    return _catalog_food(spark, sf_dir).where(F.col("protein_g") >= 20) \
        .select("part_key", "food_item", "protein_g")


def q_low_calorie_foods(spark, sf_dir):
    return (_catalog_food(spark, sf_dir).orderBy("calories", "part_key").limit(3)
            .select("part_key", "food_item", "calories"))


def q_encode_alpha(spark, sf_dir):
    return E.code_table(clean_food(spark, sf_dir), CATEGORICAL_FOOD, "alphabetical") \
        .select("column", "label", "code")


def q_index_frequency(spark, sf_dir):
    return E.code_table(clean_food(spark, sf_dir), INDEXED, "frequency") \
        .select("column", "label", "count", "code")


LABELS = ["food_item", "category", "product"]


def known_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Clean rows with three label columns: those shipped in the first eight
    tenths of the time range, and the later ones.  ``product`` (a part of a
    supplier) has labels that only later rows carry."""
    df = clean_food(spark, sf_dir).withColumn("product", F.concat_ws(" ", "food_item", "l_suppkey", "l_partkey"))
    span = df.agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")).select(
        *[epoch_micros(F.col(c)).alias(c) for c in ("lo", "hi")]).first()
    at = epoch_micros(F.col("l_shipdate"))
    cut = None if span["lo"] is None else span["lo"] + (span["hi"] - span["lo"]) * 8 // 10
    return df.where(at < F.lit(cut)), df.where(at >= F.lit(cut))


def q_encode_new(spark, sf_dir):
    """Codes fitted on the known rows applied to the new ones; labels that
    fitting did not see get the next free code."""
    known, new = known_and_new(spark, sf_dir)
    encoder = CodeEncoder(inputCols=LABELS, outputCols=[f"{c}_encoded" for c in LABELS], handleInvalid="keep")
    return encoder.fit(known).transform(new).select(*ORDER_KEY, *LABELS, *[f"{c}_encoded" for c in LABELS])


def q_encode_unseen(spark, sf_dir):
    known, new = known_and_new(spark, sf_dir)
    return E.unseen_labels(new, E.code_table(known, LABELS), LABELS).select("column", "label")


def q_standardize(spark, sf_dir):
    cols = ["calories", "protein_g", "carbs_g", "fat_g", "weight_grams"]
    df = E.standardize(clean_food(spark, sf_dir), cols, digits=9)
    return df.select(*KEYS, *[c + "_z" for c in cols])


def q_stratified_split(spark, sf_dir):
    df = clean_food(spark, sf_dir)
    return SP.stratified_split(df, ["category"], KEYS, ORDER_KEY).select(*ORDER_KEY, "category", "split")


def q_random_split(spark, sf_dir):
    """Seeded hash split by the integer keys (stable, portable)."""
    return SP.hash_split(clean_food(spark, sf_dir), KEYS).select(*ORDER_KEY, "split")


QUERIES = {
    "food_clean": q_food_clean,
    "clean_counts": q_clean_counts,
    "food_profile": q_food_profile,
    "food_text_profile": q_food_text_profile,
    "food_missing": q_food_missing,
    "category_distribution": q_category_distribution,
    "meal_distribution": q_meal_distribution,
    "category_nunique": q_category_nunique,
    "category_counts": q_category_counts,
    "food_features": q_food_features,
    "food_features_sql": q_food_features_sql,
    "food_features_ext": q_food_features_ext,
    "feature_profile": q_feature_profile,
    "group_summary": q_group_summary,
    "portion_nutrients": q_portion_nutrients,
    "food_provenance": q_food_provenance,
    "format_times": q_format_times,
    "prediction_errors": q_prediction_errors,
    "prediction_stats": q_prediction_stats,
    "regression_metrics": q_regression_metrics,
    "prediction_sample": q_prediction_sample,
    "topk": q_topk,
    "min_rows_gate": q_min_rows_gate,
    "food_summary": q_food_summary,
    "high_protein_foods": q_high_protein_foods,
    "low_calorie_foods": q_low_calorie_foods,
    "encode_alpha": q_encode_alpha,
    "index_frequency": q_index_frequency,
    "encode_new": q_encode_new,
    "encode_unseen": q_encode_unseen,
    "standardize": q_standardize,
    "stratified_split": q_stratified_split,
    "random_split": q_random_split,
}
