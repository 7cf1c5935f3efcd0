"""Named queries for the MLlib pipelines and their reports.

Model outputs depend on MLlib internals, so these get rows-only checks;
``tests/test_ml.py`` checks bounds, determinism and that the metrics
recomputed by the aggregate form equal ``RegressionEvaluator``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators import features as FT
from vigilo.operators import split as SP
from vigilo.operators.encoder_stage import CodeEncoderModel
from vigilo.plans import ml
from vigilo.plans.food_queries import KEYS, clean_food
from vigilo.session import scratch_path
from vigilo.sources import lake as L
from vigilo.sources.food import ORDER_KEY, catalog_rows, portion_rows
from vigilo.sources.tables import table_state


def features_base(spark, sf_dir) -> DataFrame:
    return FT.add_features(clean_food(spark, sf_dir))


def features_ext(spark, sf_dir) -> DataFrame:
    return FT.add_extended_features(clean_food(spark, sf_dir))


def calorie_split(spark, sf_dir):
    df = SP.hash_split(features_base(spark, sf_dir), KEYS, 0.8, seed=ml.SEED)
    return df.where("split = 'train'"), df.where("split = 'test'")


_FITTED: dict[tuple, object] = {}


def _fitted(spark, sf_dir: str, name: str, fit):
    """Fit once per (application, state of the input, model) and reuse: several
    queries report on the same fitted pipeline.  A table that was written
    again has another time or size and is fitted anew."""
    key = (spark.sparkContext.applicationId, table_state(spark, sf_dir, ["lineitem", "part"]), name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def fit_calorie_forest(spark, sf_dir):
    train, test = calorie_split(spark, sf_dir)
    pipeline = ml.calorie_forest(pass_memory_mb=ml.tree_pass_memory(spark))
    inputs = [*ml.CALORIE_NUMERIC, *ml.CALORIE_CATEGORICAL, "calories"]
    model = _fitted(spark, sf_dir, "calorie_forest", lambda: ml.fit(pipeline, train, inputs))
    return model, model.transform(test)


def nutrition_clusters(spark, sf_dir) -> PipelineModel:
    """The clusterer, fitted on all clean rows."""
    return _fitted(spark, sf_dir, "nutrition_clusters", lambda: ml.fit(
        ml.nutrition_clusters(), features_ext(spark, sf_dir), ml.NUTRITION_PROFILE))


def nutrition_encoder(spark, sf_dir) -> CodeEncoderModel:
    """The code tables of the four label columns, fitted on all clean rows."""
    return _fitted(spark, sf_dir, "nutrition_encoder", lambda: ml.nutrition_encoder().fit(features_ext(spark, sf_dir)))


def nutrition_frame(spark, sf_dir) -> DataFrame:
    """All clean rows with their nutrition cluster."""
    return nutrition_clusters(spark, sf_dir).transform(features_ext(spark, sf_dir)).drop("nutrition_features")


def nutrition_split(spark, sf_dir):
    """The encoded, clustered rows, split by category; written once, since
    training, evaluation and reports all read them."""
    def rows() -> DataFrame:
        # Split first: finding the bounds reads the rows twice, without the codes.
        df = SP.stratified_split(nutrition_frame(spark, sf_dir), ["category"], KEYS, ORDER_KEY)
        df = nutrition_encoder(spark, sf_dir).transform(df)
        df = df.select(*[c for c in df.columns if c != "split"], "split")
        path = scratch_path(spark, "nutrition-rows")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    df = _fitted(spark, sf_dir, "nutrition_rows", rows)
    return df.where("split = 'train'"), df.where("split = 'test'")


def fit_nutrition_forest(spark, sf_dir):
    train, test = nutrition_split(spark, sf_dir)
    model = _fitted(spark, sf_dir, "nutrition_forest", lambda: ml.fit(
        ml.nutrition_forest(pass_memory_mb=ml.tree_pass_memory(spark)), train, [*ml.NUTRITION_FEATURES, "calories"]))
    return model, train, test


def nutrition_scorer(spark, sf_dir) -> PipelineModel:
    """Encoder, clusterer and forest as one model that scores rows as they come
    (with their numeric features); unseen labels get the next free code."""
    forest, _, _ = fit_nutrition_forest(spark, sf_dir)
    encoder = nutrition_encoder(spark, sf_dir).copy().setHandleInvalid("keep")
    return PipelineModel([encoder, *nutrition_clusters(spark, sf_dir).stages, *forest.stages])


def q_rf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, predictions = fit_calorie_forest(spark, sf_dir)
    return predictions.select(*KEYS, "food_item", "category", "calories", "prediction")


def _clustered(spark, sf_dir):
    df = clean_food(spark, sf_dir)
    model = _fitted(spark, sf_dir, "scaled_kmeans", lambda: ml.fit(ml.scaled_kmeans(), df, ml.CLUSTER_COLUMNS))
    return model.transform(df)


def q_kmeans_scaled(spark, sf_dir):
    return _clustered(spark, sf_dir).select(*KEYS, *ml.CLUSTER_COLUMNS, "cluster")


def q_cluster_summary(spark, sf_dir):
    clustered = _clustered(spark, sf_dir)
    return (clustered.groupBy("cluster")
            .agg(F.avg("calories").alias("avg_calories"), F.avg("protein_g").alias("avg_protein"),
                 F.avg("carbs_g").alias("avg_carbs"), F.avg("fat_g").alias("avg_fat"),
                 F.count(F.lit(1)).alias("count"))
            .orderBy("cluster"))


def q_kmeans_profile(spark, sf_dir):
    """Every clean row with its cluster."""
    return nutrition_frame(spark, sf_dir).select(*KEYS, *ml.NUTRITION_PROFILE, "nutrition_cluster")


def q_rf_predictions_ext(spark, sf_dir):
    model, _, test = fit_nutrition_forest(spark, sf_dir)
    return model.transform(test).select(*KEYS, "food_item", "calories", "prediction")


def q_topk_importance(spark, sf_dir):
    model, _, _ = fit_nutrition_forest(spark, sf_dir)
    rows = ml.importances(model, ml.NUTRITION_FEATURES)
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(5))


def new_rows(spark, sf_dir) -> DataFrame:
    """Rows no model has seen: catalogue portions, some with labels that the
    training rows lack (they carry no meal or preparation of their own)."""
    portions = FT.scale_portions(portion_rows(spark, sf_dir), catalog_rows(spark, sf_dir))
    rows = portions.select("l_orderkey", "l_linenumber", "part_key", F.col("name").alias("food_item"), "category",
                           F.lit("snack").alias("meal_time"), F.lit("raw").alias("preparation_method"),
                           "weight_grams", "calories", "protein_g", "carbs_g", "fat_g")
    return FT.add_extended_features(rows)


def _scored_new_rows(spark, sf_dir):
    """Batch scoring: the one fitted model applied to new rows."""
    model = nutrition_scorer(spark, sf_dir)
    scored = model.transform(new_rows(spark, sf_dir)).withColumnRenamed("prediction", "predicted_calories")
    return model, FT.add_prediction_errors(scored)


NEW_KEYS = ["l_orderkey", "l_linenumber", "part_key"]


def q_batch_scoring(spark, sf_dir):
    _, scored = _scored_new_rows(spark, sf_dir)
    return scored.select(*NEW_KEYS, "food_item", "category", "nutrition_cluster", "calories",
                         "predicted_calories", "prediction_error", "prediction_error_pct")


def q_training_report(spark, sf_dir):
    """The training result record (metrics, parameters, features, clustering),
    written as ``spark_ml_results_<run>.json`` and as the ``_latest`` copy,
    and returned as read back from the latest copy."""
    return _training_report(spark, sf_dir)[0]


def _training_report(spark, sf_dir) -> tuple[DataFrame, str]:
    """The record as read back, and the lake it lies in."""
    model, predictions = fit_calorie_forest(spark, sf_dir)
    clusterer = _fitted(spark, sf_dir, "scaled_kmeans", lambda: ml.fit(ml.scaled_kmeans(), clean_food(spark, sf_dir), ml.CLUSTER_COLUMNS))
    run = L.run_id()
    lake = scratch_path(spark, "lake")
    model_file, cluster_file = f"{L.MODELS}/calorie_forest_{run}", f"{L.MODELS}/food_clusters_{run}"
    ml.save(model, f"{lake}/{model_file}")
    ml.save(clusterer, f"{lake}/{cluster_file}")
    forest, kmeans = model.stages[-1], clusterer.stages[-1]
    metrics = FT.regression_metrics(predictions, "calories", "prediction", digits=None)
    record = metrics.select(F.to_json(F.struct(
        F.lit("RandomForestRegressor").alias("model_type"),
        F.lit(spark.version).alias("spark_version"),
        F.lit(run).alias("training_timestamp"),
        F.struct("rmse", "mae", "r2").alias("metrics"),
        F.array(*[F.lit(c) for c in ["weight_grams", "protein_g", "carbs_g", "fat_g", "category",
                                     "meal_time", "preparation_method"]]).alias("features_used"),
        F.struct(F.lit(forest.getNumTrees).alias("numTrees"), F.lit(forest.getMaxDepth()).alias("maxDepth"),
                 F.lit(forest.getSeed()).alias("seed")).alias("model_parameters"),
        F.lit(model_file).alias("model_file"), F.lit(cluster_file).alias("cluster_file"),
        F.struct(F.lit("KMeans").alias("algorithm"), F.lit(kmeans.getK()).alias("k"),
                 F.array(*[F.lit(c) for c in ml.CLUSTER_COLUMNS]).alias("features"))
        .alias("clustering"),
    )).alias("report"))
    root = f"{lake}/{L.PROCESSED}"
    record.coalesce(1).write.mode("errorifexists").text(f"{root}/spark_ml_results_{run}.json")
    spark.read.text(f"{root}/spark_ml_results_{run}.json") \
        .write.mode("overwrite").text(f"{root}/spark_ml_results_latest.json")
    return spark.read.text(f"{root}/spark_ml_results_latest.json").withColumnRenamed("value", "report"), lake


def q_scoring_report(spark, sf_dir):
    """Pipeline metadata: performance, importances as records, error
    statistics and the map of files written (training data, predictions,
    model), saved as ``ml_pipeline_metadata_<run>.json`` and read back.

    Each part is a one-row aggregate (or the model's 12 importances); the
    record is assembled from those scalars, no data rows are joined."""
    model, scored = _scored_new_rows(spark, sf_dir)
    train, _ = nutrition_split(spark, sf_dir)
    run = L.run_id()
    lake = scratch_path(spark, "lake")
    files = {
        "processed_training_data": f"processed_training_data_{run}.csv",
        "batch_predictions": f"batch_predictions_{run}.csv",
        "model": f"random_forest_model_{run}",
    }
    L.write_csv(train.drop("split"), f"{lake}/{L.PROCESSED}/{files['processed_training_data']}")
    L.write_csv(scored.select(*NEW_KEYS, "food_item", "category", "nutrition_cluster", "calories",
                              "predicted_calories", "prediction_error", "prediction_error_pct"),
                f"{lake}/{L.PROCESSED}/{files['batch_predictions']}")
    ml.save(model, f"{lake}/{L.MODELS}/{files['model']}")
    perf = FT.regression_metrics(scored, "calories", "predicted_calories").first()
    stats = FT.prediction_stats(scored).first()
    n_train = train.count()
    imp = sorted(ml.importances(model, ml.NUTRITION_FEATURES), key=lambda r: -r[1])
    record = F.struct(
        F.lit(run).alias("pipeline_timestamp"),
        F.lit(n_train).cast("long").alias("training_samples"),
        F.lit(perf["n"]).cast("long").alias("prediction_samples"),
        F.struct(*[F.lit(perf[k]).cast("double").alias(k) for k in ("rmse", "mae", "r2")])
        .alias("model_performance"),
        F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance"))
                  for f, v in imp]).alias("feature_importance"),
        F.struct(*[F.lit(stats[k]).cast("double").alias(k) for k in
                   ("mean_error_kcal", "mean_error_percent", "accuracy_within_10_percent")])
        .alias("prediction_statistics"),
        F.struct(*[F.lit(v).alias(k) for k, v in files.items()]).alias("data_lake_files"),
    )
    path = f"{lake}/{L.PROCESSED}/ml_pipeline_metadata_{run}.json"
    spark.range(1).select(F.to_json(record).alias("report")).coalesce(1) \
        .write.mode("errorifexists").text(path)
    return spark.read.text(path).withColumnRenamed("value", "report")


def q_model_roundtrip(spark, sf_dir):
    """Save the fitted pipeline, load it back, score the held-out rows."""
    model, predictions = fit_calorie_forest(spark, sf_dir)
    path = scratch_path(spark, "ml-models") + "/calorie_forest"
    ml.save(model, path)
    _, test = calorie_split(spark, sf_dir)
    again = ml.load(path).transform(test)
    return again.select(*KEYS, "calories", "prediction")


def q_rf_prediction_check(spark, sf_dir):
    """Rows and labels of the held-out split, and whether each prediction lies
    between the smallest and largest training label (a forest averages them)."""
    train, _ = calorie_split(spark, sf_dir)
    span = train.agg(F.min("calories").alias("lo"), F.max("calories").alias("hi")).first()
    return q_rf_predictions(spark, sf_dir).select(
        *KEYS, "calories", F.col("prediction").between(span["lo"] - 1e-6, span["hi"] + 1e-6).alias("in_range"))


def q_rf_ext_check(spark, sf_dir):
    model, train, test = fit_nutrition_forest(spark, sf_dir)
    span = train.agg(F.min("calories").alias("lo"), F.max("calories").alias("hi")).first()
    return model.transform(test).select(
        *KEYS, "calories", *ml.ENCODED.values(), F.col("prediction").between(span["lo"] - 1e-6, span["hi"] + 1e-6).alias("in_range"))


def q_cluster_check(spark, sf_dir):
    """Every clean row, and whether no other centre is nearer than its own."""
    model = _fitted(spark, sf_dir, "scaled_kmeans", lambda: ml.fit(ml.scaled_kmeans(), clean_food(spark, sf_dir), ml.CLUSTER_COLUMNS))
    rows = model.transform(clean_food(spark, sf_dir)).withColumn("x", vector_to_array("scaled_features"))
    far = [sum((F.get("x", F.lit(i)) - float(v)) ** 2 for i, v in enumerate(c)) for c in model.stages[-1].clusterCenters()]
    own = F.coalesce(*[F.when(F.col("cluster") == k, d) for k, d in enumerate(far)])
    return rows.select(*KEYS, "calories", (own <= F.least(*far) + 1e-9).alias("nearest"))


def q_cluster_counts_check(spark, sf_dir):
    return q_cluster_summary(spark, sf_dir).agg(F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("rows"))


def q_model_same(spark, sf_dir):
    """Whether the saved and reloaded model predicts the same, per held-out row."""
    model, predictions = fit_calorie_forest(spark, sf_dir)
    path = scratch_path(spark, "ml-models") + "/calorie_forest"
    ml.save(model, path)
    return ml.load(path).transform(predictions.withColumnRenamed("prediction", "first").drop(
        "features", "features_raw", *[f"{c}_indexed" for c in ml.CALORIE_CATEGORICAL])) \
        .select(*KEYS, "calories", (F.col("prediction") == F.col("first")).alias("same"))


def q_batch_scoring_check(spark, sf_dir):
    """Rows of the batch scoring with their nutrients, and whether the error
    columns follow from the prediction."""
    _, scored = _scored_new_rows(spark, sf_dir)
    err = F.abs(F.col("calories") - F.col("predicted_calories"))
    return scored.select(*NEW_KEYS, "food_item", "calories", F.col("nutrition_cluster").between(0, 4).alias("has_cluster"),
                         (F.abs(F.col("prediction_error") - err) < 1e-9).alias("error_right"))


def q_training_report_check(spark, sf_dir):
    """The determined fields of the training record, and whether the two models
    it names load from the lake with the parameters it states."""
    report, lake = _training_report(spark, sf_dir)
    row = report.select(*[F.get_json_object("report", f"$.{p}").alias(n) for n, p in (
        ("forest", "model_file"), ("clusters", "cluster_file"), ("trees", "model_parameters.numTrees"), ("k", "clustering.k"))]).first()
    forest, clusters = ml.load(f"{lake}/{row['forest']}").stages[-1], ml.load(f"{lake}/{row['clusters']}").stages[-1]
    stated = f'{{"numTrees":{forest.getNumTrees},"maxDepth":{forest.getMaxDepth()},"seed":{forest.getSeed()}}}'
    return report.select(
        F.get_json_object("report", "$.model_type").alias("model_type"),
        F.get_json_object("report", "$.model_parameters").alias("model_parameters"),
        F.get_json_object("report", "$.clustering.k").cast("int").alias("k"),
        ((F.get_json_object("report", "$.model_parameters") == stated) & F.lit(len(forest.trees) == int(row["trees"]))).alias("forest_loads"),
        F.lit(len(clusters.clusterCenters()) == int(row["k"])).alias("clusters_load"),
        (F.get_json_object("report", "$.metrics.rmse").cast("double") > 0).alias("has_metrics"))


def q_kmeans_profile_check(spark, sf_dir):
    """Every clean row, and whether no other centre is nearer than its own."""
    model = nutrition_clusters(spark, sf_dir)
    rows = model.transform(features_ext(spark, sf_dir)).withColumn("x", vector_to_array("nutrition_features"))
    far = [sum((F.get("x", F.lit(i)) - float(v)) ** 2 for i, v in enumerate(c)) for c in model.stages[-1].clusterCenters()]
    own = F.coalesce(*[F.when(F.col("nutrition_cluster") == k, d) for k, d in enumerate(far)])
    return rows.select(*KEYS, "calories", (own <= F.least(*far) + 1e-9).alias("nearest"))


def q_scorer_reloaded(spark, sf_dir):
    """The whole scorer saved and loaded: the codes that the loaded one gives new
    rows (an unseen label has the next free one), and whether both predict the
    same."""
    model = nutrition_scorer(spark, sf_dir)
    path = scratch_path(spark, "ml-models") + "/nutrition_scorer"
    ml.save(model, path)
    added = ["nutrition_features", "features", "nutrition_cluster", *ml.ENCODED.values()]
    first = model.transform(new_rows(spark, sf_dir)).withColumnRenamed("prediction", "first").drop(*added)
    return ml.load(path).transform(first).select(
        *NEW_KEYS, "food_item", "category", "meal_time", *ml.ENCODED.values(), (F.col("prediction") == F.col("first")).alias("same"))


def q_scoring_report_check(spark, sf_dir):
    report = q_scoring_report(spark, sf_dir)
    return report.select(
        F.get_json_object("report", "$.training_samples").cast("long").alias("training_samples"),
        F.get_json_object("report", "$.prediction_samples").cast("long").alias("prediction_samples"),
        F.size(F.from_json(F.get_json_object("report", "$.feature_importance"), "array<struct<feature:string>>")).alias("features"))


def q_importance_check(spark, sf_dir):
    model, _, _ = fit_nutrition_forest(spark, sf_dir)
    rows = ml.importances(model, ml.NUTRITION_FEATURES)
    total = sum(v for _, v in rows)
    return spark.createDataFrame([(f, 0 <= v <= 1 and abs(total - 1) < 1e-6) for f, v in rows], "feature string, in_unit boolean")


QUERIES = {
    "kmeans_profile_check": q_kmeans_profile_check,
    "scorer_reloaded": q_scorer_reloaded,
    "rf_prediction_check": q_rf_prediction_check,
    "rf_ext_check": q_rf_ext_check,
    "cluster_check": q_cluster_check,
    "cluster_counts_check": q_cluster_counts_check,
    "model_same": q_model_same,
    "batch_scoring_check": q_batch_scoring_check,
    "training_report_check": q_training_report_check,
    "scoring_report_check": q_scoring_report_check,
    "importance_check": q_importance_check,
    "rf_predictions": q_rf_predictions,
    "kmeans_scaled": q_kmeans_scaled,
    "cluster_summary": q_cluster_summary,
    "kmeans_profile": q_kmeans_profile,
    "rf_predictions_ext": q_rf_predictions_ext,
    "topk_importance": q_topk_importance,
    "batch_scoring": q_batch_scoring,
    "training_report": q_training_report,
    "scoring_report": q_scoring_report,
    "model_roundtrip": q_model_roundtrip,
}
