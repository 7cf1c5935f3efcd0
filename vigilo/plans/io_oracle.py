"""DuckDB oracle SQL for the lake and topic queries."""

from vigilo.plans.food_oracle import KEYS, V_CATALOG, V_FEATURES, V_FOOD, V_SCORED, sr

V_TOPIC = """
v_topic AS (
  SELECT event_type AS topic, CAST(user_id % 9 AS INTEGER) AS "partition",
    row_number() OVER (PARTITION BY event_type, user_id % 9 ORDER BY event_id) - 1 AS "offset",
    ts AS "timestamp", CAST(user_id AS VARCHAR) AS "key",
    json_object('event_id', event_id, 'user_id', user_id, 'value', value)::VARCHAR AS value,
    event_id
  FROM events)"""

FOOD_SCHEMA_JSON = ('{"food_item":"string","category":"string","weight_grams":"double",'
                    '"calories":"double","protein_g":"double","carbs_g":"double",'
                    '"fat_g":"double","meal_time":"string","preparation_method":"string",'
                    '"timestamp":"timestamp_ntz"}')

ORACLE = {
    "ingest_once": f"WITH {V_FOOD} SELECT * FROM clean",
    "manifest_check": f"WITH {V_FOOD} SELECT count(*) AS rows, TRUE AS whole, TRUE AS change_found, TRUE AS loss_found FROM clean",
    "version_log": f"""WITH {V_FOOD}
      SELECT CAST(1 AS INTEGER) AS version, {KEYS}, calories, TRUE AS late_refused FROM food
      UNION ALL SELECT 2, {KEYS}, calories, TRUE FROM clean""",
    "distinct_by_range": " UNION ALL ".join(f"""SELECT '{u}' AS unit, CAST(CAST(date_trunc('{u}', l_shipdate) AS DATE) AS VARCHAR) AS start,
        count(DISTINCT l_partkey) AS exact, TRUE AS within FROM lineitem GROUP BY ALL""" for u in ("month", "year")),
    "csv_scan": f"WITH {V_FOOD} SELECT * FROM food",
    "csv_roundtrip": f"""WITH {V_SCORED}
      SELECT {KEYS}, calories, predicted_calories, prediction_error, prediction_error_pct
      FROM errors""",
    "parquet_roundtrip": f"WITH {V_FEATURES} SELECT * FROM features",
    "latest_file_rows": f"WITH {V_FOOD} SELECT * FROM clean",
    "ingest_if_absent": f"WITH {V_FOOD} SELECT * FROM clean",
    "versioned_write": f"WITH {V_FOOD} SELECT * FROM clean",
    "write_verify": f"""WITH {V_FOOD}
      SELECT count(*) AS rows_written, count(*) AS rows_read, TRUE AS verified FROM food""",
    "ingest_metadata": f"""WITH {V_FOOD}
      SELECT count(*) AS total_records, 'csv' AS data_format, 'lineitem_part' AS source,
        '{FOOD_SCHEMA_JSON}' AS schema FROM food""",
    "fallback_dataset": f"""WITH {V_CATALOG},
      portions AS (
        SELECT l_orderkey, l_linenumber, l_partkey AS part_key,
          {sr('least(greatest(l_quantity * 10, 10.0), 1000.0)', 1)} AS weight_grams
        FROM lineitem)
      SELECT l_orderkey, l_linenumber, name AS food_item, category, weight_grams,
        {sr('greatest(base_cal * (weight_grams / 100), 1.0)', 1)} AS calories
      FROM portions JOIN catalog USING (part_key)""",
    "topic_records": f"WITH {V_TOPIC} SELECT * FROM v_topic",
    "topic_peek": f"""WITH {V_TOPIC}
      SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "partition", "offset") AS rn
        FROM v_topic) WHERE rn <= 5""",
    "topic_totals": f"""WITH {V_TOPIC},
      ends AS (SELECT topic, "partition", max("offset") + 1 AS end_offset
               FROM v_topic GROUP BY topic, "partition")
      SELECT topic, CAST(sum(end_offset) AS BIGINT) AS messages FROM ends GROUP BY topic""",
}
