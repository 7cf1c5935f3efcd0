"""MLlib pipelines for calorie regression and nutrient clustering.

All fitting is distributed: MLlib's training (tree statistics and k-means
centre updates are aggregated across partitions) and, for forests of many
rows, ``operators/forest.py``, which makes the same kind of model; scoring is
a narrow ``transform``.  Only fitted parameters (centres, trees, label lists,
scaler moments) and one-row summaries reach the driver.

Two parameter sets mirror the two batch jobs:

* ``calorie_forest``: frequency-indexed categories + 9 numeric features,
  standardised, forest of 50 trees of depth 10, seed 42;
* ``nutrition_forest``: alphabetical label codes of 4 categories (as
  numbers, from a code table, so a vocabulary of any size needs no bins of
  its own), 7 numeric features and a k-means (k=5) nutrition cluster as a
  feature, forest of 100 trees of depth 15, every feature considered at
  each split.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.operators import forest as FO
from vigilo.operators.encoder_stage import CodeEncoder

# Fixed model settings.
SEED = 42
CALORIE_CATEGORICAL = ["category", "meal_time", "preparation_method"]
CALORIE_NUMERIC = ["weight_grams", "protein_g", "carbs_g", "fat_g", "weight_normalized",
                   "calorie_density", "protein_ratio", "carb_ratio", "fat_ratio"]
CLUSTER_COLUMNS = ["calories", "protein_g", "carbs_g", "fat_g", "weight_grams"]
NUTRITION_PROFILE = ["protein_ratio", "carb_ratio", "fat_ratio", "calorie_density"]
ENCODED = {"food_item": "food_encoded", "category": "category_encoded",
           "meal_time": "meal_encoded", "preparation_method": "prep_encoded"}
NUTRITION_FEATURES = ["food_encoded", "category_encoded", "meal_encoded", "prep_encoded",
                      "weight_grams", "weight_normalized", "weight_squared", "log_weight",
                      "protein_g", "carbs_g", "fat_g", "nutrition_cluster"]
LEAKY = "calorie_density"  # contains the label (calories / weight)
# Tuning only (results do not depend on it): memory for one pass of tree
# statistics; more memory = more nodes split per pass over the data.
TREE_PASS_MEMORY_MB = 1024
# Training rows that one task holds through the passes of a fit.
FIT_ROWS = 250_000
# A forest of more rows is grown from histograms (operators/forest.py), one of
# fewer rows, or with settings that are not known there, by MLlib.  A loaded
# forest of more nodes predicts in the way of a grown one.
GROWN_ROWS, MANY_NODES = 250_000, 50_000
# Rows that one task holds through the passes over some trees of a forest, and
# the most trees grown in one go: a cached row has twelve bytes for each of them.
TREE_ROWS, TREES_AT_ONCE = 3_000_000, 25
# What a fit costs, as measured: seconds a row to bin and sample it and to go by
# it in one pass, whatever the trees; bytes of a node's statistics; seconds to
# send and merge a byte, or to read again one that the cache could not hold; bytes
# of a cached row beside its trees.
ROW_SECONDS, PASS_SECONDS, NODE_BYTES, BYTE_SECONDS, ROW_BYTES = 9e-6, 1e-6, 6_000, 1e-8, 180
# Forests at least this deep get their rows in the order of one tree's leaves,
# which has this depth.
ORDERED_DEPTH, ORDER_DEPTH = 12, 10


def _memory_mb(text: str) -> int:
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    text = text.strip().lower().rstrip("b")
    if text and text[-1] in units:
        return int(float(text[:-1]) * units[text[-1]])
    return int(text)   # a bare number means MiB for Spark memory settings


def tree_pass_memory(spark) -> int:
    """Per-task memory for one pass of tree statistics.

    Every task that runs concurrently in a JVM builds its own statistics
    array of this size, so the heap (executor memory, or the driver's in
    local mode) is divided by the task slots of that JVM and kept at a
    quarter of the heap overall; between 32 MB and 1 GB.
    """
    sc = spark.sparkContext
    conf = sc.getConf()
    if sc.master.startswith("local"):
        heap = _memory_mb(conf.get("spark.driver.memory", "1g"))
        slots = sc.defaultParallelism
    else:
        heap = _memory_mb(conf.get("spark.executor.memory", "1g"))
        slots = int(conf.get("spark.executor.cores", "1"))
    return max(32, min(TREE_PASS_MEMORY_MB, heap // (4 * max(1, slots))))


def calorie_forest(label: str = "calories", num_trees: int = 50, max_depth: int = 10,
                   exclude_leaky: bool = False, handle_invalid: str = "error",
                   pass_memory_mb: int = TREE_PASS_MEMORY_MB) -> Pipeline:
    numeric = [c for c in CALORIE_NUMERIC if not (exclude_leaky and c == LEAKY)]
    # One indexer over all three columns: one pass over the data to fit.
    indexers = [StringIndexer(inputCols=CALORIE_CATEGORICAL,
                              outputCols=[f"{c}_indexed" for c in CALORIE_CATEGORICAL],
                              handleInvalid=handle_invalid)]
    assembler = VectorAssembler(inputCols=numeric + [f"{c}_indexed" for c in CALORIE_CATEGORICAL],
                                outputCol="features_raw")
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True,
                            withStd=True)
    forest = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                                   maxDepth=max_depth, seed=SEED,
                                   maxMemoryInMB=pass_memory_mb, cacheNodeIds=True,
                                   checkpointInterval=10)
    return Pipeline(stages=[*indexers, assembler, scaler, forest])


def scaled_kmeans(k: int = 5, cols: list[str] = CLUSTER_COLUMNS) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="cluster_features"),
        StandardScaler(inputCol="cluster_features", outputCol="scaled_features", withMean=True,
                       withStd=True),
        KMeans(featuresCol="scaled_features", predictionCol="cluster", k=k, seed=SEED),
    ])


def nutrition_encoder(handle_invalid: str = "error") -> CodeEncoder:
    """Alphabetical codes of the four label columns."""
    return CodeEncoder(inputCols=list(ENCODED), outputCols=list(ENCODED.values()), handleInvalid=handle_invalid)


def nutrition_clusters(k: int = 5) -> Pipeline:
    """The nutrition cluster of a row, fitted on the whole frame."""
    return Pipeline(stages=[VectorAssembler(inputCols=NUTRITION_PROFILE, outputCol="nutrition_features"),
                            KMeans(featuresCol="nutrition_features", predictionCol="nutrition_cluster", k=k, seed=SEED)])


def nutrition_forest(num_trees: int = 100, max_depth: int = 15, min_instances: int = 5, label: str = "calories",
                     pass_memory_mb: int = TREE_PASS_MEMORY_MB) -> Pipeline:
    """The forest over encoded columns and the cluster, both plain numbers."""
    assembler = VectorAssembler(inputCols=NUTRITION_FEATURES, outputCol="features")
    forest = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                                   maxDepth=max_depth, minInstancesPerNode=min_instances,
                                   featureSubsetStrategy="all", seed=SEED,
                                   maxMemoryInMB=pass_memory_mb, cacheNodeIds=True,
                                   checkpointInterval=10)
    return Pipeline(stages=[assembler, forest])


def evaluate(predictions: DataFrame, label: str = "calories",
             prediction: str = "prediction") -> dict[str, float]:
    ev = RegressionEvaluator(labelCol=label, predictionCol=prediction)
    return {m: ev.evaluate(predictions, {ev.metricName: m}) for m in ("rmse", "mae", "r2")}


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    forest = model.stages[-1]
    return [(n, float(v)) for n, v in zip(names, forest.featureImportances.toArray())]


def fit_partitions(spark, rows: int) -> int:
    """One task for each of the cluster's slots, or whole waves of tasks of at
    most ``FIT_ROWS`` rows.  In every pass over a forest each task makes, sends
    and merges the statistics of all open nodes, so a pass costs nodes times
    tasks: more tasks than the rows need are paid for at every node."""
    slots = max(1, spark.sparkContext.defaultParallelism)
    return slots * max(1, -(-rows // (slots * FIT_ROWS)))


def pass_partitions(spark, rows: int) -> int:
    """Two tasks for each slot, or more of at most ``FIT_ROWS`` rows: k-means
    makes some thirty passes over its rows, and a pass over few rows costs the
    start of its tasks."""
    return max(2 * max(1, spark.sparkContext.defaultParallelism), -(-rows // FIT_ROWS))


def cache_room(spark) -> float:
    """Bytes that the cluster's heaps can hold of rows through the passes of a
    fit, beside the statistics."""
    sc = spark.sparkContext
    conf = sc.getConf()
    if sc.master.startswith("local"):
        heap = _memory_mb(conf.get("spark.driver.memory", "1g"))
    else:
        executors = max(1, sc.defaultParallelism // max(1, int(conf.get("spark.executor.cores", "1"))))
        heap = executors * _memory_mb(conf.get("spark.executor.memory", "1g"))
    return 0.4 * heap * 1024 * 1024


def tree_groups(trees: int, rows: int, slots: int, depth: int = 15, min_instances: int = 5,
                room: float = math.inf) -> tuple[int, int, list[int]]:
    """Tasks of one fit, fits side by side, and the trees of each fit.

    Every fit bins, samples and caches all rows and goes by each of them in every
    pass, so fits are dear where rows are many; every task of a fit makes and
    sends the statistics of all its open nodes, so tasks are dear where trees
    are deep.  Of the ways to fill the slots the one that costs least is taken,
    with what the cache can not hold read again in each pass.  No fit has one
    tree alone: MLlib shows such a tree all features."""
    least = -(-rows // TREE_ROWS)
    nodes = min(1 << (depth + 1), 2 * rows // max(1, min_instances) + 1)
    slots = max(1, slots)

    def way(beside: int) -> tuple[float, int, int, list[int]]:
        tasks = max(1, slots // beside, least)
        tasks = -(-tasks // slots) * slots if tasks > slots else tasks   # whole waves
        fits = beside * -(-max(1, -(-trees // TREES_AT_ONCE)) // beside)
        fits = max(1, min(fits, trees // 2))
        groups = [trees // fits + (i < trees % fits) for i in range(fits)]
        held = min(beside, fits) * rows * (ROW_BYTES + 12 * groups[0])
        cost = (fits * rows * (ROW_SECONDS + depth * PASS_SECONDS) + trees * nodes * NODE_BYTES * tasks * BYTE_SECONDS
                + -(-fits // beside) * depth * max(0.0, held - room) * BYTE_SECONDS)
        waves = -(-tasks * beside // slots) * slots / (tasks * beside)   # slots that stand idle in the last one
        return cost * waves, tasks, beside, groups

    return min(way(b) for b in range(1, slots + 1) if slots % b == 0)[1:]


def leaf_order(forest: RandomForestRegressor, frame: DataFrame, parts: int) -> DataFrame:
    """``frame`` with its rows in the order of the leaves of one tree, then of
    all plain columns, range-partitioned.  The trees of a forest are alike, so
    rows that lie together share nodes in all of them and a pass stays with few
    statistics at a time, where rows in any order reach all over the nodes'
    array.  No row is added or left out, and equal input gives equal order."""
    tree = DecisionTreeRegressor(featuresCol=forest.getFeaturesCol(), labelCol=forest.getLabelCol(), leafCol="__leaf",
                                 predictionCol="__prediction", maxDepth=min(ORDER_DEPTH, forest.getMaxDepth()),
                                 seed=forest.getSeed(), maxMemoryInMB=forest.getMaxMemoryInMB())
    model = tree.fit(frame.select(forest.getFeaturesCol(), forest.getLabelCol()).coalesce(parts))
    order = ["__leaf", *[c for c, kind in frame.dtypes if kind in ("string", "double", "float", "int", "bigint")]]
    # The last column only parts rows that are equal in all others, so that many
    # copies of a row do not make one partition.
    laid = model.transform(frame).withColumn("__part", F.rand(forest.getSeed()))
    return laid.repartitionByRange(parts, *order, "__part").sortWithinPartitions(*order)


def fit_forest(forest: RandomForestRegressor, rows: DataFrame, n_rows: int) -> RandomForestRegressionModel:
    """One forest of independent trees, fitted by MLlib in groups side by side
    (:func:`tree_groups`), each group with bootstrap samples of its own seed.
    The trees are put together as the model that one fit would give."""
    sc = rows.sparkSession.sparkContext
    tasks, beside, groups = tree_groups(forest.getNumTrees(), n_rows, sc.defaultParallelism, forest.getMaxDepth(),
                                        forest.getMinInstancesPerNode(), cache_room(rows.sparkSession))
    seeds = [forest.getSeed() + 1_000_003 * i for i in range(len(groups))]
    shared = rows.coalesce(tasks)

    def grow(part: tuple[int, int]) -> RandomForestRegressionModel:
        return forest.copy({forest.numTrees: part[0], forest.seed: part[1]}).fit(shared)

    with ThreadPool(beside) as pool:
        grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), list(zip(groups, seeds)), chunksize=1)
    if len(grown) == 1:
        return grown[0]
    trees = [tree for model in grown for tree in model._java_obj.trees()]
    package = sc._jvm.org.apache.spark.ml.regression
    array = sc._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    model = forest._copyValues(RandomForestRegressionModel(
        package.RandomForestRegressionModel(grown[0].uid, array, grown[0].numFeatures)))
    model._transfer_params_to_java()
    return model


def fit(pipeline: Pipeline, train: DataFrame, inputs: list[str], partitions: int | None = None) -> PipelineModel:
    """Fit on the named columns of the training rows, spread over
    ``partitions`` tasks (default: :func:`fit_partitions` for a forest, else
    :func:`pass_partitions`).

    The named columns are persisted once if they are read again (by a feature
    stage that has to be fitted, or after the count that k-means is dealt by),
    and then what the last stage reads (feature vector and label) for its many
    passes, so that the plan behind the rows is run once.  MEMORY_AND_DISK: a
    lost executor's blocks are recomputed from the plan, nothing is lost."""
    spark = train.sparkSession
    *features, last = pipeline.getStages()
    forest, again = last.hasParam("numTrees"), any(isinstance(stage, Estimator) for stage in features)
    frame = train.select(*inputs)
    held = [frame := frame.persist(StorageLevel.MEMORY_AND_DISK)] if again or not forest else []
    try:
        n_rows = frame.count()
        if not forest:
            frame = frame.repartition(partitions or pass_partitions(spark, n_rows))
            if again:
                held.append(frame := frame.persist(StorageLevel.MEMORY_AND_DISK))
                frame.count()
                held.pop(0).unpersist()
        fitted = []
        for stage in features:
            fitted.append(stage.fit(frame) if isinstance(stage, Estimator) else stage)
            frame = fitted[-1].transform(frame)
        read = [last.getFeaturesCol(), *([last.getLabelCol()] if last.hasParam("labelCol") else [])]
        rows = frame.select(*read)
        if isinstance(last, RandomForestRegressor) and n_rows > GROWN_ROWS and FO.grows(last):
            return PipelineModel([*fitted, FO.grow(last, rows, n_rows)])
        if not forest:
            # k-means keeps the vectors of rows that are not persisted as objects,
            # so that its passes do not read them out of a table again.
            return PipelineModel([*fitted, last.fit(rows)])
        parts = partitions or fit_partitions(spark, n_rows)
        deep = isinstance(last, RandomForestRegressor) and last.getMaxDepth() >= ORDERED_DEPTH and n_rows > FIT_ROWS
        rows = leaf_order(last, frame, parts).select(*read) if deep else rows.repartition(parts)
        held.append(rows := rows.persist(StorageLevel.MEMORY_AND_DISK))
        if len(held) > 1:
            rows.count()
            held.pop(0).unpersist()
        model = fit_forest(last, rows, n_rows) if isinstance(last, RandomForestRegressor) else last.fit(rows)
        return PipelineModel([*fitted, model])
    finally:
        for copy in held:
            copy.unpersist()


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """The saved model; a forest of many nodes predicts from its saved nodes."""
    stages = list(PipelineModel.load(path).stages)
    for i, stage in enumerate(stages):
        if isinstance(stage, RandomForestRegressionModel) and stage.totalNumNodes > MANY_NODES:
            at = PipelineSharedReadWrite.getStagePath(stage.uid, i, len(stages), f"{path}/stages")
            stages[i] = FO.ForestModel(stage, at)
    return PipelineModel(stages)
