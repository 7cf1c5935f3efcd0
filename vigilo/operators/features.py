"""Feature derivation, catalogue portions and prediction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.functions import features as FX
from vigilo.functions.joins import join_dimension

def add_features(df: DataFrame) -> DataFrame:
    return df.withColumns(FX.base_features())


def add_features_sql(df: DataFrame, view: str = "food_data") -> DataFrame:
    """The features as a SQL select over a temporary view, from the same
    expressions as :func:`add_features`."""
    df.createOrReplaceTempView(view)
    items = ", ".join(f"{text} AS {name}" for name, text in FX.base_feature_sql().items())
    return df.sparkSession.sql(f"SELECT *, {items} FROM {view}")


def add_extended_features(df: DataFrame) -> DataFrame:
    return df.withColumns(FX.extended_features())


def scale_portions(portions: DataFrame, catalog: DataFrame, key: str = "part_key",
                   weight: str = "raw_weight", cap: bool = True) -> DataFrame:
    """Nutrients of each portion from the per-100 g catalogue.

    Weight is floored at 10 g (and capped at 1000 g when ``cap``); the
    factor is weight / 100; calories are at least 1 and rounded to one
    decimal, macros at least 0 and rounded to two.
    """
    w = FX.clamp(F.col(weight), FX.WEIGHT_FLOOR, FX.WEIGHT_CAP if cap else None)
    factor = F.col("weight_grams") / 100
    joined = join_dimension(portions.withColumn("weight_grams", F.round(w, 1)), catalog, key)
    return joined.withColumns({
        "calories": F.round(FX.clamp(F.col("base_cal") * factor, FX.CALORIE_FLOOR), 1),
        "protein_g": F.round(FX.clamp(F.col("protein") * factor, FX.MACRO_FLOOR), 2),
        "carbs_g": F.round(FX.clamp(F.col("carbs") * factor, FX.MACRO_FLOOR), 2),
        "fat_g": F.round(FX.clamp(F.col("fat") * factor, FX.MACRO_FLOOR), 2),
    })


def add_prediction_errors(df: DataFrame, actual: str = "calories",
                          predicted: str = "predicted_calories") -> DataFrame:
    return df.withColumns(FX.prediction_error_columns(actual, predicted))


def prediction_stats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Mean error, mean percent error, share of rows within 10 % (in %)."""
    pct = F.col("prediction_error_pct")
    return df.agg(
        F.round(F.avg("prediction_error"), digits).alias("mean_error_kcal"),
        F.round(F.avg(pct), digits).alias("mean_error_percent"),
        F.round(F.avg(F.when(pct <= 10, 1.0).otherwise(0.0)) * 100, digits)
        .alias("accuracy_within_10_percent"),
    )


def regression_metrics(df: DataFrame, label: str = "calories", prediction: str = "prediction",
                       digits: int | None = 6) -> DataFrame:
    """RMSE, MAE and R² in one aggregation pass.  SS_tot comes from
    ``var_pop`` (merged with a numerically stable update) times n, so no
    second pass over the data and no cancellation in Σy² - n·ȳ²."""
    y, p = F.col(label), F.col(prediction)
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum((y - p) * (y - p)).alias("sse"),
                 F.sum(F.abs(y - p)).alias("sae"),
                 F.var_pop(y).alias("vy"))
    n = F.col("n")
    ss_tot = F.col("vy") * n
    out = {
        "rmse": F.sqrt(F.col("sse") / n),
        "mae": F.col("sae") / n,
        "r2": 1 - F.col("sse") / ss_tot,
    }
    if digits is not None:
        out = {k: F.round(v, digits) for k, v in out.items()}
    return agg.select(n.alias("n"), *[v.alias(k) for k, v in out.items()])


def iso_local(t: Column) -> Column:
    """ISO text of a timestamp, microseconds only when non-zero (like Python's
    ``isoformat``)."""
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


#: Fixed value: what the generated food rows name as their source.
DATA_SOURCE = "big_data_generator"


def with_provenance(df: DataFrame, now: Column | None = None, source: str = DATA_SOURCE) -> DataFrame:
    """``created_at`` (processing time, injectable) and ``data_source``."""
    return df.withColumns({"created_at": iso_local(now if now is not None else F.current_timestamp()), "data_source": F.lit(source)})


def format_times(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Three text forms of a timestamp: log text, ISO (microseconds only
    when non-zero, like Python's ``isoformat``) and a run id."""
    t = F.col(ts)
    iso = iso_local(t)
    return df.withColumns({
        "ts_text": F.date_format(t, "yyyy-MM-dd HH:mm:ss"),
        "ts_iso": iso,
        "run_id": F.date_format(t, "yyyyMMdd-HHmmss"),
    })


def with_padded_id(df: DataFrame, n: Column, name: str = "sample_id",
                   prefix: str = "food_") -> DataFrame:
    return df.withColumn(name, FX.padded_id(prefix, n))
