"""Scalar feature expressions for food rows (all built-in, codegen'd).

ANSI mode is on in Spark 4, where ``x / 0`` raises; densities and
percentages therefore use ``try_divide`` (NULL on a zero divisor).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feature definitions.
MACRO_EPSILON = 0.001          # added to the macro sum before dividing
CALORIE_LOW, CALORIE_MEDIUM = 100, 300
PROTEIN_HIGH, PROTEIN_MEDIUM = 20, 10
WEIGHT_FLOOR, WEIGHT_CAP = 10.0, 1000.0
CALORIE_FLOOR, MACRO_FLOOR = 1.0, 0.0


def macro_sum() -> Column:
    return F.col("protein_g") + F.col("carbs_g") + F.col("fat_g") + F.lit(MACRO_EPSILON)


def _steps(column: str, steps: list[tuple[str, str]], last: str) -> str:
    """A CASE over one column: the first (condition, text) that holds."""
    return "CASE " + " ".join(f"WHEN {column} {test} THEN '{text}'" for test, text in steps) + f" ELSE '{last}' END"


def base_feature_sql() -> dict[str, str]:
    """Features of the batch Spark job, in their order, as SQL expressions."""
    shares = {f"{name}_ratio": f"{column} / (protein_g + carbs_g + fat_g + {MACRO_EPSILON}D)"
              for name, column in (("protein", "protein_g"), ("carb", "carbs_g"), ("fat", "fat_g"))}
    return {
        "weight_normalized": "weight_grams / 100",
        "calorie_density": "try_divide(calories, weight_grams)",
        **shares,
        "calorie_category": _steps("calories", [(f"< {CALORIE_LOW}", "low_calorie"), (f"< {CALORIE_MEDIUM}", "medium_calorie")], "high_calorie"),
        "protein_category": _steps("protein_g", [(f"> {PROTEIN_HIGH}", "high_protein"), (f"> {PROTEIN_MEDIUM}", "medium_protein")], "low_protein"),
    }


def base_features() -> dict[str, Column]:
    return {name: F.expr(text) for name, text in base_feature_sql().items()}


def extended_features() -> dict[str, Column]:
    """Numeric features of the tabular job (no category buckets)."""
    total = macro_sum()
    w = F.col("weight_grams")
    return {
        "weight_normalized": w / 100,
        "weight_squared": F.pow(w, 2),
        "log_weight": F.log1p(w),
        "calorie_density": F.try_divide(F.col("calories"), w),
        "protein_ratio": F.col("protein_g") / total,
        "carb_ratio": F.col("carbs_g") / total,
        "fat_ratio": F.col("fat_g") / total,
    }


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return x


def prediction_error_columns(actual: str = "calories",
                             predicted: str = "predicted_calories") -> dict[str, Column]:
    err = F.abs(F.col(actual) - F.col(predicted))
    return {
        "prediction_error": err,
        "prediction_error_pct": F.try_divide(err, F.col(actual)) * 100,
    }


def padded_id(prefix: str, n: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)
