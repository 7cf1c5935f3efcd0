"""Named queries for lake reads/writes and topic records.

Each writes data that Spark derives from the provided tables into a fresh
folder under the shared checkpoint folder, then reads it back, so the
result can be compared with SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators import features as FT
from vigilo.operators import profile as P
from vigilo.operators import sketches as SK
from vigilo.plans.food_queries import KEYS, _food, clean_food
from vigilo.session import scratch_path
from vigilo.sources import lake as L
from vigilo.sources import topics as T
from vigilo.sources import versions as VL
from vigilo.sources.food import FOOD_COLUMNS, ORDER_KEY, catalog_rows, portion_rows, scored_rows
from vigilo.sources.tables import read_table


def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    food = _food(spark, sf_dir)
    path = scratch_path(spark, "csv-scan") + "/large_food_dataset_latest.csv"
    L.write_csv(food, path)
    return L.read_csv(spark, path, schema=food.schema)


def q_csv_roundtrip(spark, sf_dir):
    errors = FT.add_prediction_errors(scored_rows(spark, sf_dir)).select(
        *KEYS, "calories", "predicted_calories", "prediction_error", "prediction_error_pct")
    path = scratch_path(spark, "csv-roundtrip") + "/batch_predictions.csv"
    L.write_csv(errors, path)
    return L.read_csv(spark, path, schema=errors.schema)


def q_parquet_roundtrip(spark, sf_dir):
    features = FT.add_features(clean_food(spark, sf_dir))
    path = scratch_path(spark, "parquet-roundtrip") + "/processed_training_data.parquet"
    L.write_parquet(features, path)
    return spark.read.parquet(path)


def q_latest_file_rows(spark, sf_dir):
    """Three data sets in one folder; the lexicographically last matching
    name (``..._latest.csv`` beats time-stamped names) is read."""
    root = scratch_path(spark, "lake") + "/" + L.RAW
    food = _food(spark, sf_dir)
    L.write_csv(food, f"{root}/large_food_dataset_20240101-000000.csv")
    L.write_csv(clean_food(spark, sf_dir), f"{root}/large_food_dataset_latest.csv")
    L.write_csv(P.distribution(food, "category"), f"{root}/category_counts.csv")
    return L.latest_dataset(spark, root, food.schema, "large_food_dataset")


def q_ingest_if_absent(spark, sf_dir):
    """Second ingest into an existing target is skipped."""
    path = scratch_path(spark, "ingest") + "/large_food_dataset_latest.csv"
    clean = clean_food(spark, sf_dir)
    L.write_if_absent(clean, path)
    L.write_if_absent(_food(spark, sf_dir), path)
    return L.read_csv(spark, path, schema=clean.schema)


def q_versioned_write(spark, sf_dir):
    root = scratch_path(spark, "versioned") + "/" + L.PROCESSED + "/food"
    clean = clean_food(spark, sf_dir)
    L.versioned_write(spark, _food(spark, sf_dir).select(clean.columns), root, "20240101-000000")
    L.versioned_write(spark, clean, root, L.run_id())
    return L.read_latest(spark, root, clean.schema)


def q_write_verify(spark, sf_dir):
    return L.verify_write(spark, _food(spark, sf_dir), scratch_path(spark, "verify"))


def q_ingest_metadata(spark, sf_dir):
    """The metadata record, written to the lake and read back from there."""
    food = _food(spark, sf_dir).select(*FOOD_COLUMNS)
    record = L.ingest_metadata(food, "csv", "lineitem_part")
    path = scratch_path(spark, "metadata") + "/ingestion_metadata.json"
    L.write_json_record(record, path)
    return spark.read.schema(record.schema).json(path).drop("ingestion_timestamp")


def q_fallback_dataset(spark, sf_dir):
    """A data set that is missing, then one that is too short: both times the
    generated portions take its place in the lake, the third read finds them."""
    path = scratch_path(spark, "fallback") + "/large_food_dataset_latest.csv"
    portions = FT.scale_portions(portion_rows(spark, sf_dir), catalog_rows(spark, sf_dir)) \
        .select("l_orderkey", "l_linenumber", F.col("name").alias("food_item"), "category", "weight_grams", "calories")
    schema, least = portions.schema, 5000
    few = portions.where("l_orderkey < 0")
    L.read_or_fallback(spark, path, schema, least, few)
    L.read_or_fallback(spark, path, schema, least, portions)
    return L.read_or_fallback(spark, path, schema, least, few)


def q_topic_records(spark, sf_dir):
    return T.topic_records(spark, sf_dir)


def q_topic_peek(spark, sf_dir):
    return T.peek(T.topic_records(spark, sf_dir), 5)


def q_topic_totals(spark, sf_dir):
    return T.totals(T.topic_records(spark, sf_dir))


def q_ingest_once(spark, sf_dir):
    """A stopped ingest left half a data set: the next one replaces it, the one
    after that (with other rows) finds it whole and leaves it."""
    path = scratch_path(spark, "ingest") + "/food.csv"
    clean = clean_food(spark, sf_dir)
    L.write_csv(clean.where("l_linenumber < 3"), path)
    L.ingest_once(clean, path, "csv")
    L.ingest_once(clean.where("l_linenumber > 3"), path, "csv")
    return L.read_dataset(spark, path, clean.schema, "csv")


def q_manifest_check(spark, sf_dir):
    """Rows by the manifest, and whether the data set is found whole as written,
    changed after one value changed, and not whole after a row went."""
    root, clean = scratch_path(spark, "manifest"), clean_food(spark, sf_dir)
    rows = L.write_complete(clean, f"{root}/food")["rows"]
    text = L.get_text(spark, f"{root}/food/{L.MANIFEST}")
    one = clean.agg(F.min(F.struct(*ORDER_KEY)).alias("k")).select("k.*").first()
    here = F.lit(True)
    for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"):
        here = here & (F.col(c) == F.lit(one[c]))
    found = {}
    for name, other in (("changed", clean.withColumn("fat_g", F.when(here, F.col("fat_g") + 1).otherwise(F.col("fat_g")))),
                        ("shorter", clean.where(~here))):
        L.write_parquet(other, f"{root}/{name}")
        L.put_text(spark, f"{root}/{name}/{L.MANIFEST}", text)
        found[name] = not L.is_complete(spark, f"{root}/{name}", clean.schema)
    return spark.createDataFrame([(rows, L.is_complete(spark, f"{root}/food", clean.schema), found["changed"], found["shorter"])],
                                 "rows long, whole boolean, change_found boolean, loss_found boolean")


def q_version_log(spark, sf_dir):
    """Two versions of the food table and a writer that came too late: the rows
    of both versions as read back by number, and whether the late one was refused."""
    root = scratch_path(spark, "version-log") + "/food"
    food, clean = _food(spark, sf_dir), clean_food(spark, sf_dir)
    first = VL.commit(food, root, parent=0)
    VL.commit(clean, root, parent=first)
    try:
        VL.commit(food, root, parent=first)
        refused = False
    except VL.VersionConflict:
        refused = True
    versions = [VL.read(spark, root, v).select(F.lit(v).alias("version"), *KEYS, "calories", F.lit(refused).alias("late_refused")) for v in (1, 2)]
    return versions[0].unionByName(versions[1])


def q_distinct_by_range(spark, sf_dir):
    """Distinct parts shipped, by day as stored sketches, merged to months and
    years: the exact number, and whether the estimate lies within its bound."""
    items = read_table(spark, sf_dir, "lineitem", ["l_shipdate", "l_partkey"]).withColumn("day", F.to_date("l_shipdate"))
    path = scratch_path(spark, "sketches")
    SK.sketches(items, ["day"], "l_partkey").write.parquet(path)
    stored = spark.read.parquet(path)
    out = None
    for unit in ("month", "year"):
        start = F.to_date(F.date_trunc(unit, "day"))
        merged = SK.merged(stored.withColumn("start", start), ["start"])
        exact = items.groupBy(start.alias("start")).agg(F.count_distinct("l_partkey").alias("exact"))
        one = merged.join(exact, "start").select(F.lit(unit).alias("unit"), F.col("start").cast("string").alias("start"), "exact",
                                                 SK.within(F.col("estimate"), F.col("exact")).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "ingest_once": q_ingest_once,
    "manifest_check": q_manifest_check,
    "version_log": q_version_log,
    "distinct_by_range": q_distinct_by_range,
    "csv_scan": q_csv_scan,
    "csv_roundtrip": q_csv_roundtrip,
    "parquet_roundtrip": q_parquet_roundtrip,
    "latest_file_rows": q_latest_file_rows,
    "ingest_if_absent": q_ingest_if_absent,
    "versioned_write": q_versioned_write,
    "write_verify": q_write_verify,
    "ingest_metadata": q_ingest_metadata,
    "fallback_dataset": q_fallback_dataset,
    "topic_records": q_topic_records,
    "topic_peek": q_topic_peek,
    "topic_totals": q_topic_totals,
}
