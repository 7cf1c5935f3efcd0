"""The forest grown from histograms against MLlib's trees and MLlib's own scoring."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from vigilo.operators import forest as FO
from vigilo.plans import ml, ml_queries
from vigilo.session import scratch_path

NAMES = ["a", "b", "c", "d", "k"]


def _rows(spark, n=4000, label="a * 3 + (c % 5) * 20 + b * (a % 7) + k * k * 9"):
    kind = {"ml_attr": {"type": "nominal", "num_vals": 5}}
    df = spark.range(n).selectExpr("id * 37 % 101 * 1.0 as a", "id * 17 % 23 * 0.5 as b", "id * 31 % 211 * 1.0 as c",
                                   "(id * 37 % 101) * 2.0 + 1 as d", "cast(id * 7 % 5 as double) as k")
    df = df.withColumn("y", F.expr(label)).withColumn("k", F.col("k").alias("k", metadata=kind))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def _forest(**params):
    return RandomForestRegressor(featuresCol="features", labelCol="y", **{
        "numTrees": 4, "maxDepth": 6, "seed": 42, "featureSubsetStrategy": "all", "minInstancesPerNode": 5, **params})


def _shape(tree):
    return tree.toDebugString.split("\n", 1)[1]


def test_with_every_row_once_the_tree_is_mllibs(spark):
    """Numbers, a column that bins all rows like another, and categories."""
    rows = _rows(spark).coalesce(1)
    for depth in (3, 6, 9):
        plain = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=depth, minInstancesPerNode=5).fit(rows)
        nodes, predictions = _local_trees(rows, depth)
        assert nodes == plain.numNodes
        assert np.allclose(predictions, [r["prediction"] for r in plain.transform(rows).select("prediction").collect()])


def _local_trees(rows, depth):
    """One tree over all rows with weight one, by the functions that the tasks run."""
    forest = _forest(maxDepth=depth)
    x = np.array([r["features"].toArray() for r in rows.select("features").collect()])
    y = np.array([r["y"] for r in rows.select("y").collect()])
    kinds = [0, 0, 0, 0, 5]
    edges = [np.zeros(0) if k else FO.thresholds(x[:, f], 32) for f, k in enumerate(kinds)]
    bins = np.stack([x[:, f].astype(np.uint8) if k else np.searchsorted(edges[f], x[:, f], "left").astype(np.uint8) for f, k in enumerate(kinds)])
    spec = FO.Spec(forest, [0, 1, 2, 0, 4], [k or len(e) + 1 for k, e in zip(kinds, edges)], kinds)
    tree = FO.grow_subtrees(spec, bins[spec.columns], np.ones(len(y), np.uint8), y, np.zeros(len(y), np.int64), np.zeros(1, np.int64), [1])
    tree = FO.pruned(tree)
    node = FO.place(tree, bins[spec.columns], depth)
    return len(tree), (tree["s"] / tree["n"])[node]


def test_all_ways_to_grow_make_the_same_forest(spark, monkeypatch):
    rows = _rows(spark).repartition(3).persist()
    shapes = []
    for settings in ({}, {"PASS_DEPTH": 0, "LOCAL_ROWS": 400}, {"PASS_DEPTH": 0}, {"HISTOGRAM_BYTES": 1}, {"PASS_DEPTH": 0, "DEAL_BYTES": 1}):
        with monkeypatch.context() as held:
            for name, value in settings.items():
                held.setattr(FO, name, value)
            model = FO.grow(_forest(), rows, 4000)
        shapes.append([_shape(t) for t in model.trees])
        assert model.getNumTrees == len(model.trees) == 4 and model.numFeatures == 5
        assert (model.getMaxDepth(), model.getSeed(), model.getMinInstancesPerNode()) == (6, 42, 5)
    assert all(s == shapes[0] for s in shapes)
    assert len(set(shapes[0])) == 4   # each tree has its own sample
    rows.unpersist()


def test_grown_forest_is_as_good_as_mllibs_and_respects_its_limits(spark):
    rows = _rows(spark)
    for strategy in ("all", "onethird"):
        forest = _forest(numTrees=12, maxDepth=8, featureSubsetStrategy=strategy)
        grown, plain = FO.grow(forest, rows, 4000), forest.fit(rows)
        error = [m.transform(rows).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0] for m in (grown, plain)]
        assert error[0] < 1.25 * error[1]
        assert abs(grown.totalNumNodes - plain.totalNumNodes) < 0.2 * plain.totalNumNodes
        assert abs(sum(grown.featureImportances.toArray()) - 1) < 1e-9
        assert np.abs(grown.featureImportances.toArray() - plain.featureImportances.toArray())[[1, 2, 4]].max() < 0.1
        nodes = spark.read.parquet(f"{grown.path}/data").select("nodeData.*")
        assert nodes.where("rawCount < 5").isEmpty() and all(t.depth <= 8 for t in grown.trees)


def test_bootstrap_weights_are_poisson_and_repeat():
    w = FO.weights(42, 3, 7, 400_000)
    assert (w == FO.weights(42, 3, 7, 400_000)).all() and (w != FO.weights(42, 4, 7, 400_000)).any()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_predictions_are_exactly_those_of_mllibs_model_saved_and_loaded(spark, monkeypatch):
    monkeypatch.setattr(ml, "GROWN_ROWS", 100)
    monkeypatch.setattr(ml, "MANY_NODES", 0)
    rows = _rows(spark, 1500).withColumnRenamed("y", "calories")
    rows = rows.select("calories", *[F.col(NAMES[i % 5]).alias(c) for i, c in enumerate(ml.NUTRITION_FEATURES)])
    model = ml.fit(ml.nutrition_forest(num_trees=5, max_depth=7), rows, [*ml.NUTRITION_FEATURES, "calories"])
    forest = model.stages[-1]
    assert isinstance(forest, FO.ForestModel) and isinstance(forest, RandomForestRegressionModel)
    out = model.transform(rows).withColumnRenamed("prediction", "first")
    assert forest.plain.transform(out).where("prediction <> first or prediction is null").isEmpty() and out.count() == 1500
    path = scratch_path(spark, "grown")
    forest.write().overwrite().save(f"{path}/alone")
    again = RandomForestRegressionModel.load(f"{path}/alone")   # MLlib reads what is written here
    assert again.totalNumNodes == forest.totalNumNodes and again.getMinInstancesPerNode() == 5
    assert again.transform(out).where("prediction <> first").isEmpty()
    ml.save(model, f"{path}/whole")
    loaded = ml.load(f"{path}/whole")
    assert isinstance(loaded.stages[-1], FO.ForestModel)
    assert loaded.transform(out.drop("features")).where("prediction <> first").isEmpty()


def test_many_rows_are_grown_and_few_or_unknown_settings_are_mllibs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "GROWN_ROWS", 300)
    monkeypatch.setattr(FO, "grow", lambda forest, rows, n: seen.append(n) or forest.fit(rows))
    for n in (300, 301):
        rows = _rows(spark, n).withColumnRenamed("y", "calories").select("calories", *[
            F.col(NAMES[i % 5]).alias(c) for i, c in enumerate(ml.NUTRITION_FEATURES)])
        ml.fit(ml.nutrition_forest(num_trees=2, max_depth=2), rows, [*ml.NUTRITION_FEATURES, "calories"])
    assert seen == [301]
    assert not any(FO.grows(_forest(**p)) for p in ({"numTrees": 1}, {"subsamplingRate": 0.5}, {"maxBins": 100}, {"maxDepth": 20}))


def test_rows_that_mllib_refuses_are_refused(spark):
    for bad in ("case when id = 7 then null else 1.0D end", "case when id = 7 then double('nan') else 1.0D end"):
        rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(
            spark.range(400).selectExpr("id * 1.0D as x", f"{bad} as y"))
        with pytest.raises(Exception, match="labels"):
            FO.grow(_forest(), rows, 400)


def test_split_rows_have_their_codes_and_clusters_in_the_same_columns(spark):
    from paths import SF_SMALL
    train, test = ml_queries.nutrition_split(spark, SF_SMALL)
    assert train.columns[-1] == "split" and train.columns[-5:-1] == list(ml.ENCODED.values())
    assert train.count() + test.count() == ml_queries.clean_food(spark, SF_SMALL).count()
