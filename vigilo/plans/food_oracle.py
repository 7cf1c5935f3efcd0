"""DuckDB oracle SQL for the food queries.

``sr(x, d)`` rounds like Spark: half-up on the shortest decimal text of the
double (DuckDB's own ``round`` works on the binary value and can differ
at ties such as 12.35).
"""


def sr(expr: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


V_FOOD = f"""
v_food AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
    p_name AS food_item, p_type AS category, l_quantity * 10 AS weight_grams,
    {sr('l_extendedprice / 40', 1)} AS calories,
    l_discount * 100 AS protein_g, l_tax * 100 AS carbs_g, CAST(p_size AS DOUBLE) AS fat_g,
    l_returnflag AS meal_time, l_linestatus AS preparation_method, l_shipdate AS timestamp, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey),
food AS (SELECT * EXCLUDE (l_discount) FROM v_food),
clean AS (
  SELECT * FROM food
  WHERE calories > 0 AND calories < 2000 AND weight_grams > 5 AND weight_grams < 2000
    AND food_item IS NOT NULL AND category IS NOT NULL)"""

FEATURES = """
  weight_grams / 100 AS weight_normalized,
  calories / weight_grams AS calorie_density,
  protein_g / (protein_g + carbs_g + fat_g + 0.001) AS protein_ratio,
  carbs_g / (protein_g + carbs_g + fat_g + 0.001) AS carb_ratio,
  fat_g / (protein_g + carbs_g + fat_g + 0.001) AS fat_ratio"""

V_FEATURES = V_FOOD + f""",
features AS (
  SELECT *, {FEATURES},
    CASE WHEN calories < 100 THEN 'low_calorie' WHEN calories < 300 THEN 'medium_calorie'
         ELSE 'high_calorie' END AS calorie_category,
    CASE WHEN protein_g > 20 THEN 'high_protein' WHEN protein_g > 10 THEN 'medium_protein'
         ELSE 'low_protein' END AS protein_category
  FROM clean)"""

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
# The seeded hash of the splits: 15 hex digits of an MD5 over the integer keys.
SPLIT_HASH = f"CAST('0x' || substr(md5(concat_ws('|', {KEYS}, 42)), 1, 15) AS BIGINT)"


def _profile(src: str, cols: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS "count",
      round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
      CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max" FROM {src}"""
             for c in cols]
    return "\nUNION ALL\n".join(parts)


V_CATALOG = """
catalog AS (
  SELECT p_partkey AS part_key, p_type AS category, p_name AS name,
    p_retailprice / 10 AS base_cal, CAST(p_size AS DOUBLE) / 2.0 AS protein,
    CAST(p_size AS DOUBLE) AS carbs, CAST(p_size AS DOUBLE) / 5.0 AS fat
  FROM part)"""

V_SCORED = V_FOOD + """,
scored AS (
  SELECT *, calories * (1 - l_discount) AS predicted_calories FROM v_food),
errors AS (
  SELECT *, abs(calories - predicted_calories) AS prediction_error,
    CASE WHEN calories = 0 THEN NULL
         ELSE abs(calories - predicted_calories) / calories * 100 END AS prediction_error_pct
  FROM scored)"""


def _labels(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS label, count(*) AS "count"
            FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in cols)


LABELS = ["food_item", "category", "product"]
KNOWN = f"""
labelled AS (SELECT *, food_item || ' ' || l_suppkey || ' ' || l_partkey AS product, epoch_us(l_shipdate) AS t_us FROM clean),
span AS (SELECT min(t_us) + (max(t_us) - min(t_us)) * 8 // 10 AS cut FROM labelled),
known AS (SELECT * FROM labelled, span WHERE t_us < cut),
fresh AS (SELECT * FROM labelled, span WHERE t_us >= cut),
codes AS (
  SELECT "column", label, "count",
    CAST(row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INTEGER) AS code
  FROM ({_labels('known', LABELS)}))"""

ORACLE = {
    "food_clean": f"WITH {V_FOOD} SELECT * FROM clean",
    "clean_counts": f"""WITH {V_FOOD}
      SELECT count(*) AS total_rows, CAST(10 AS INTEGER) AS column_count,
        count(*) FILTER (WHERE calories > 0 AND calories < 2000 AND weight_grams > 5
          AND weight_grams < 2000 AND food_item IS NOT NULL AND category IS NOT NULL) AS kept_rows,
        count(*) - count(*) FILTER (WHERE calories > 0 AND calories < 2000 AND weight_grams > 5
          AND weight_grams < 2000 AND food_item IS NOT NULL AND category IS NOT NULL) AS removed_rows
      FROM food""",
    "food_profile": f"WITH {V_FOOD} "
                    + _profile("food", ["weight_grams", "calories", "protein_g", "carbs_g", "fat_g"]),
    "food_text_profile": f"WITH {V_FOOD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", min({c}) AS min, max({c}) AS max FROM food"
        for c in ["food_item", "category", "meal_time", "preparation_method"]),
    "food_missing": f"""WITH {V_FOOD}, holed AS (SELECT * REPLACE (
        CASE WHEN calories < 2000 THEN calories END AS calories,
        CASE WHEN meal_time <> 'R' THEN preparation_method END AS preparation_method) FROM food) SELECT """
                    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in
                                ["food_item", "category", "weight_grams", "calories", "protein_g", "carbs_g",
                                 "fat_g", "meal_time", "preparation_method", "timestamp"])
                    + " FROM holed",
    "category_distribution": f"""WITH {V_FOOD}
      SELECT category, count(*) AS "count" FROM food GROUP BY category""",
    "meal_distribution": f"""WITH {V_FOOD}
      SELECT meal_time, count(*) AS "count" FROM food GROUP BY meal_time""",
    "category_nunique": f"""WITH {V_FOOD}
      SELECT count(DISTINCT category) AS category_nunique FROM clean""",
    "category_counts": f"""WITH {V_FOOD}
      SELECT category, count(*) AS "count" FROM clean GROUP BY category""",
    "food_features": f"WITH {V_FEATURES} SELECT * FROM features",
    "food_features_sql": f"WITH {V_FEATURES} SELECT * FROM features",
    "food_features_ext": f"""WITH {V_FOOD}
      SELECT *, weight_grams / 100 AS weight_normalized, pow(weight_grams, 2) AS weight_squared,
        round(ln(1 + weight_grams), 9) AS log_weight,
        calories / weight_grams AS calorie_density,
        protein_g / (protein_g + carbs_g + fat_g + 0.001) AS protein_ratio,
        carbs_g / (protein_g + carbs_g + fat_g + 0.001) AS carb_ratio,
        fat_g / (protein_g + carbs_g + fat_g + 0.001) AS fat_ratio
      FROM clean""",
    "feature_profile": f"WITH {V_FEATURES} " + _profile(
        "features", ["weight_normalized", "calorie_density", "protein_ratio", "carb_ratio",
                     "fat_ratio"]),
    "group_summary": f"""WITH {V_FEATURES}
      SELECT calorie_category, round(avg(calories), 6) AS avg_calories,
        round(avg(protein_g), 6) AS avg_protein, round(avg(carbs_g), 6) AS avg_carbs,
        round(avg(fat_g), 6) AS avg_fat, count(*) AS "count"
      FROM features GROUP BY calorie_category""",
    "portion_nutrients": f"""WITH {V_CATALOG},
      portions AS (
        SELECT l_orderkey, l_linenumber, l_partkey AS part_key,
          {sr('least(greatest(l_quantity * 10, 10.0), 1000.0)', 1)} AS weight_grams
        FROM lineitem)
      SELECT l_orderkey, l_linenumber, printf('food_%06d', l_orderkey) AS sample_id,
        name AS food_item, category, weight_grams,
        {sr('greatest(base_cal * (weight_grams / 100), 1.0)', 1)} AS calories,
        {sr('greatest(protein * (weight_grams / 100), 0.0)', 2)} AS protein_g,
        {sr('greatest(carbs * (weight_grams / 100), 0.0)', 2)} AS carbs_g,
        {sr('greatest(fat * (weight_grams / 100), 0.0)', 2)} AS fat_g
      FROM portions JOIN catalog USING (part_key)""",
    "food_provenance": f"""WITH {V_CATALOG},
      portions AS (SELECT l_orderkey, l_linenumber, l_partkey AS part_key,
        {sr('least(greatest(l_quantity * 10, 10.0), 1000.0)', 1)} AS weight_grams FROM lineitem)
      SELECT l_orderkey, l_linenumber, printf('food_%06d', l_orderkey) AS sample_id,
        {sr('greatest(base_cal * (weight_grams / 100), 1.0)', 1)} AS calories,
        '2024-02-01T00:00:00.250000' AS created_at, 'big_data_generator' AS data_source
      FROM portions JOIN catalog USING (part_key)""",
    "format_times": """
      SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
        CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
             ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_iso,
        strftime(ts, '%Y%m%d-%H%M%S') AS run_id
      FROM events""",
    "prediction_errors": f"""WITH {V_SCORED}
      SELECT {KEYS}, calories, predicted_calories, prediction_error, prediction_error_pct
      FROM errors""",
    "prediction_stats": f"""WITH {V_SCORED}
      SELECT round(avg(prediction_error), 6) AS mean_error_kcal,
        round(avg(prediction_error_pct), 6) AS mean_error_percent,
        round(avg(CASE WHEN prediction_error_pct <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6)
          AS accuracy_within_10_percent
      FROM errors""",
    "regression_metrics": f"""WITH {V_SCORED}
      SELECT count(*) AS n,
        round(sqrt(sum((calories - predicted_calories) * (calories - predicted_calories)) / count(*)), 6) AS rmse,
        round(sum(abs(calories - predicted_calories)) / count(*), 6) AS mae,
        round(1 - sum((calories - predicted_calories) * (calories - predicted_calories))
                  / (var_pop(calories) * count(*)), 6) AS r2
      FROM scored""",
    "prediction_sample": f"""WITH {V_SCORED}
      SELECT {KEYS}, food_item, calories, predicted_calories AS prediction, category
      FROM scored ORDER BY {ORDER_KEY} LIMIT 10""",
    "topk": f"""WITH {V_FEATURES}
      SELECT {KEYS}, food_item, calorie_density FROM features
      ORDER BY calorie_density DESC, {ORDER_KEY} LIMIT 5""",
    "min_rows_gate": f"WITH {V_FOOD} SELECT * FROM food",
    "food_summary": f"""WITH {V_CATALOG}
      SELECT count(*) AS total_items, round(avg(base_cal), 6) AS mean_calories,
        count(*) FILTER (WHERE protein >= 20) AS high_protein_count FROM catalog""",
    "high_protein_foods": f"""WITH {V_CATALOG}
      SELECT part_key, name AS food_item, protein AS protein_g FROM catalog WHERE protein >= 20""",
    "low_calorie_foods": f"""WITH {V_CATALOG}
      SELECT part_key, name AS food_item, base_cal AS calories FROM catalog
      ORDER BY base_cal, part_key LIMIT 3""",
    "encode_alpha": f"""WITH {V_FOOD}
      SELECT "column", label,
        CAST(row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INTEGER) AS code
      FROM ({_labels('clean', ['food_item', 'category', 'meal_time', 'preparation_method'])})""",
    "index_frequency": f"""WITH {V_FOOD}
      SELECT "column", label, "count",
        CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, label) - 1 AS INTEGER) AS code
      FROM ({_labels('clean', ['category', 'meal_time', 'preparation_method'])})""",
    "encode_new": f"""WITH {V_FOOD}, {KNOWN}
      SELECT {ORDER_KEY}, food_item, category, product, {", ".join(
        f'coalesce({c}_codes.code, CAST((SELECT count(*) FROM codes WHERE "column" = {c!r}) AS INTEGER)) AS {c}_encoded' for c in LABELS)}
      FROM fresh {" ".join(f'LEFT JOIN (SELECT label, code FROM codes WHERE "column" = {c!r}) {c}_codes ON {c}_codes.label = {c}' for c in LABELS)}""",
    "encode_unseen": f"""WITH {V_FOOD}, {KNOWN}
      SELECT DISTINCT "column", label FROM ({" UNION ALL ".join(f"SELECT {c!r} AS \"column\", {c} AS label FROM fresh" for c in LABELS)}) x
      WHERE NOT EXISTS (SELECT 1 FROM codes c WHERE c."column" = x."column" AND c.label = x.label)""",
    "standardize": f"""WITH {V_FOOD}
      SELECT {KEYS}, """ + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 9) AS {c}_z"
        for c in ["calories", "protein_g", "carbs_g", "fat_g", "weight_grams"]) + " FROM clean",
    "stratified_split": f"""WITH {V_FOOD}, hashed AS (SELECT *, {SPLIT_HASH} AS h FROM clean)
      SELECT {ORDER_KEY}, category,
        CASE WHEN row_number() OVER (PARTITION BY category ORDER BY h, {ORDER_KEY})
                  <= (count(*) OVER (PARTITION BY category) * 80 + 99) // 100
             THEN 'train' ELSE 'test' END AS split
      FROM hashed""",
    "random_split": f"""WITH {V_FOOD}
      SELECT {ORDER_KEY}, CASE WHEN {SPLIT_HASH} % 10000 < 8000 THEN 'train' ELSE 'test' END AS split
      FROM clean""",
}
