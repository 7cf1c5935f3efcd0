"""DuckDB oracle SQL for what is determined about the model queries: the rows,
their labels and codes, and that every computed check holds."""

from vigilo.plans.food_oracle import KEYS, ORDER_KEY, SPLIT_HASH, V_CATALOG, V_FOOD, sr

FEATURES = ["food_encoded", "category_encoded", "meal_encoded", "prep_encoded", "weight_grams", "weight_normalized",
            "weight_squared", "log_weight", "protein_g", "carbs_g", "fat_g", "nutrition_cluster"]
ENCODED = {"food_item": "food_encoded", "category": "category_encoded", "meal_time": "meal_encoded",
           "preparation_method": "prep_encoded"}

HELD_OUT = f"""WITH {V_FOOD}, held AS (SELECT * FROM clean WHERE {SPLIT_HASH} % 10000 >= 8000)"""

STRATIFIED = f"""{V_FOOD}, coded AS (
  SELECT *, {", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {o}" for c, o in ENCODED.items())},
    {SPLIT_HASH} AS h FROM clean),
split AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, {ORDER_KEY})
              <= (count(*) OVER (PARTITION BY category) * 80 + 99) // 100 AS train FROM coded)"""

PORTIONS = f"""{V_CATALOG}, portions AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part_key,
    {sr('least(greatest(l_quantity * 10, 10.0), 1000.0)', 1)} AS weight_grams FROM lineitem),
fresh AS (
  SELECT l_orderkey, l_linenumber, part_key, name AS food_item,
    {sr('greatest(base_cal * (weight_grams / 100), 1.0)', 1)} AS calories
  FROM portions JOIN catalog USING (part_key))"""

ORACLE = {
    "rf_prediction_check": f"{HELD_OUT} SELECT {KEYS}, calories, TRUE AS in_range FROM held",
    "model_same": f"{HELD_OUT} SELECT {KEYS}, calories, TRUE AS same FROM held",
    "rf_ext_check": f"""WITH {STRATIFIED}
      SELECT {KEYS}, calories, {", ".join(ENCODED.values())}, TRUE AS in_range FROM split WHERE NOT train""",
    "cluster_check": f"WITH {V_FOOD} SELECT {KEYS}, calories, TRUE AS nearest FROM clean",
    "cluster_counts_check": f"WITH {V_FOOD} SELECT CAST(5 AS BIGINT) AS clusters, count(*) AS rows FROM clean",
    "batch_scoring_check": f"""WITH {PORTIONS}
      SELECT l_orderkey, l_linenumber, part_key, food_item, calories, TRUE AS has_cluster, TRUE AS error_right FROM fresh""",
    "training_report_check": """SELECT 'RandomForestRegressor' AS model_type,
        '{"numTrees":50,"maxDepth":10,"seed":42}' AS model_parameters, CAST(5 AS INTEGER) AS k,
        TRUE AS forest_loads, TRUE AS clusters_load, TRUE AS has_metrics""",
    "kmeans_profile_check": f"WITH {V_FOOD} SELECT {KEYS}, calories, TRUE AS nearest FROM clean",
    "scorer_reloaded": f"""WITH {V_FOOD}, {V_CATALOG}, {", ".join(
        f"{o} AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS label FROM clean))"
        for c, o in ENCODED.items())},
      fresh AS (SELECT l_orderkey, l_linenumber, l_partkey AS part_key, name AS food_item, category, 'snack' AS meal_time, 'raw' AS preparation_method
        FROM lineitem JOIN catalog ON l_partkey = part_key)
      SELECT l_orderkey, l_linenumber, part_key, food_item, category, meal_time, TRUE AS same, {", ".join(
        f"coalesce({o}.code, CAST((SELECT count(*) FROM {o}) AS INTEGER)) AS {o}" for o in ENCODED.values())}
      FROM fresh {" ".join(f"LEFT JOIN {o} ON {o}.label = fresh.{c}" for c, o in ENCODED.items())}""",
    "scoring_report_check": f"""WITH {STRATIFIED}
      SELECT (SELECT count(*) FROM split WHERE train) AS training_samples, count(*) AS prediction_samples,
        CAST({len(FEATURES)} AS INTEGER) AS features FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "importance_check": "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, TRUE AS in_unit",
}
