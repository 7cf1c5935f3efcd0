"""ML checks: determinism, bounds, metric agreement, model round trip."""

from pyspark.sql import functions as F

from vigilo.operators import features as FT
from vigilo.plans import ml, ml_queries
from vigilo.session import scratch_path
from vigilo.sources.food import ORDER_KEY

from paths import SF_SMALL


def test_calorie_forest_metrics_and_roundtrip(spark):
    model, predictions = ml_queries.fit_calorie_forest(spark, SF_SMALL)
    m = ml.evaluate(predictions)
    agg = FT.regression_metrics(predictions, "calories", "prediction", digits=None).first()
    assert abs(agg["rmse"] - m["rmse"]) < 1e-6 * max(1, m["rmse"])
    assert abs(agg["mae"] - m["mae"]) < 1e-6 * max(1, m["mae"])
    assert abs(agg["r2"] - m["r2"]) < 1e-6
    assert m["r2"] > 0.5
    path = scratch_path(spark, "model-test")
    ml.save(model, path)
    _, test = ml_queries.calorie_split(spark, SF_SMALL)
    again = ml.load(path).transform(test).select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_suppkey", F.col("prediction").alias("p2"))
    joined = predictions.join(again, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    assert joined.where(F.abs(F.col("prediction") - F.col("p2")) > 1e-9).count() == 0


def test_kmeans_clusters_in_range(spark):
    out = ml_queries.q_kmeans_scaled(spark, SF_SMALL)
    clusters = {r["cluster"] for r in out.select("cluster").distinct().collect()}
    assert clusters <= set(range(5)) and len(clusters) > 1


def test_string_indexer_matches_frequency_codes(spark):
    from pyspark.ml.feature import StringIndexer
    from vigilo.plans.food_queries import clean_food, q_index_frequency
    df = clean_food(spark, SF_SMALL)
    model = StringIndexer(inputCol="meal_time", outputCol="i").fit(df)
    codes = {r["label"]: r["code"] for r in
             q_index_frequency(spark, SF_SMALL).where("column = 'meal_time'").collect()}
    assert {lab: i for i, lab in enumerate(model.labels)} == codes


def test_fits_are_deterministic(spark):
    train, test = ml_queries.calorie_split(spark, SF_SMALL)
    keys = ORDER_KEY   # the four line-item keys alone repeat once at sf0.001
    runs = []
    for _ in range(2):
        model = ml.fit(ml.calorie_forest(), train, [*ml.CALORIE_NUMERIC, *ml.CALORIE_CATEGORICAL, "calories"])
        runs.append(model.transform(test).select(*keys, "prediction"))
    a, b = runs[0].withColumnRenamed("prediction", "a"), runs[1].withColumnRenamed("prediction", "b")
    joined = a.join(b, keys)
    assert joined.count() == test.count()
    assert joined.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    clean = ml_queries.clean_food(spark, SF_SMALL)
    c1 = ml.fit(ml.scaled_kmeans(), clean, ml.CLUSTER_COLUMNS).stages[-1].clusterCenters()
    c2 = ml.fit(ml.scaled_kmeans(), clean, ml.CLUSTER_COLUMNS).stages[-1].clusterCenters()
    assert all((x == y).all() for x, y in zip(c1, c2))


def test_forest_fit_makes_no_more_tasks_than_slots_and_rows_need(spark):
    class Last:
        getFeaturesCol, hasParam = staticmethod(lambda: "id"), staticmethod(lambda name: name == "numTrees")

        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())

    class Stages:
        getStages = staticmethod(lambda: [Last()])

    seen, slots = [], spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        ml.fit(Stages(), spark.range(1000), ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [slots]
    assert ml.fit_partitions(spark, 0) == slots and ml.fit_partitions(spark, slots * ml.FIT_ROWS + 1) == 2 * slots


def test_trees_grow_in_groups_of_few_tasks_and_make_one_forest(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
    seen, plain = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows: (
        seen.append((rows.rdd.getNumPartitions(), self.getNumTrees(), self.getSeed())), plain(self, rows))[1])
    rows = spark.range(400).selectExpr(*[f"id % {7 + i} * 1.0 as {c}" for i, c in enumerate(ml.NUTRITION_FEATURES)],
                                       "id % 7 * 10.0 + id % 8 as calories")
    model = ml.fit(ml.nutrition_forest(num_trees=10, max_depth=4), rows, [*ml.NUTRITION_FEATURES, "calories"])
    assert {tasks for tasks, _, _ in seen} == {1} and len({seed for _, _, seed in seen}) == len(seen) > 1
    forest = model.stages[-1]
    assert isinstance(forest, RandomForestRegressionModel)
    assert sum(trees for _, trees, _ in seen) == forest.getNumTrees == len(forest.trees) == 10
    assert (forest.getSeed(), forest.getMaxDepth(), forest.numFeatures) == (ml.SEED, 4, 12)
    assert abs(sum(v for _, v in ml.importances(model, ml.NUTRITION_FEATURES)) - 1) < 1e-9
    assert len({tree.toDebugString.split("\n", 1)[1] for tree in forest.trees}) > 1
    path = scratch_path(spark, "grouped-forest")
    ml.save(model, path)
    out = ml.load(path).transform(model.transform(rows).withColumnRenamed("prediction", "first").drop("features"))
    assert out.where("abs(prediction - first) > 1e-9 or abs(prediction - calories) > 40").count() == 0


def test_tree_groups_keep_all_trees_and_none_alone():
    for trees in (1, 2, 3, 50, 100):
        for rows in (0, 10, ml.TREE_ROWS + 1, 200 * ml.TREE_ROWS):
            for slots in (1, 3, 12):
                tasks, beside, groups = ml.tree_groups(trees, rows, slots)
                assert sum(groups) == trees and min(groups) >= min(2, trees) and max(groups) <= ml.TREES_AT_ONCE
                assert tasks * ml.TREE_ROWS >= rows and tasks * beside >= slots


def test_a_forest_of_many_rows_is_grown_in_few_fits():
    # As many fits as TREES_AT_ONCE asks for, one at a time, once rows fill the slots.
    for rows in (8 * ml.TREE_ROWS, 44 * ml.TREE_ROWS):
        tasks, beside, groups = ml.tree_groups(50, rows, 12, depth=10, min_instances=1)
        assert (beside, groups) == (1, [25, 25]) and tasks % 12 == 0
    assert ml.tree_groups(50, 2_000_000, 12, depth=10, min_instances=1)[2] == [25, 25]
    # Deep trees over few rows: one task a fit, and no slot is given a second fit.
    assert ml.tree_groups(100, 2_000_000, 12)[:2] == (1, 12) and len(ml.tree_groups(100, 2_000_000, 12)[2]) == 12
    # Fewer trees at once where the cache would not hold the rows of all fits.
    assert ml.tree_groups(100, 2_000_000, 12, room=1e9)[1] < 12


def test_a_fit_runs_the_plan_behind_its_rows_once(spark):
    for pipeline, inputs in ((ml.scaled_kmeans(k=2), ml.CLUSTER_COLUMNS),
                             (ml.calorie_forest(num_trees=4, max_depth=2),
                              [*ml.CALORIE_NUMERIC, *ml.CALORIE_CATEGORICAL, "calories"])):
        met = spark.sparkContext.accumulator(0)
        row = F.udf(lambda i: met.add(1) or float(i % 9), "double")("id")
        rows = spark.range(300).select(*[(row if c == inputs[0] else F.col("id") % 5).cast(
            "string" if c in ml.CALORIE_CATEGORICAL else "double").alias(c) for c in inputs])
        ml.fit(pipeline, rows, inputs)
        assert met.value == 300


def test_kmeans_passes_make_two_tasks_a_slot_or_as_many_as_the_rows_need(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    seen, plain = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), plain(self, rows))[1])
    slots, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        for pipeline, inputs in ((ml.scaled_kmeans(k=2), ml.CLUSTER_COLUMNS), (ml.nutrition_clusters(k=2), ml.NUTRITION_PROFILE)):
            rows = spark.range(300).select(*[(F.col("id") % (3 + i)).cast("double").alias(c) for i, c in enumerate(inputs)])
            ml.fit(pipeline, rows, inputs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [(2 * slots, 300)] * 2
    assert ml.pass_partitions(spark, 10 * slots * ml.FIT_ROWS) == 10 * slots


def test_rows_of_a_deep_forest_lie_in_the_order_of_one_trees_leaves(spark, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
    monkeypatch.setattr(ml, "FIT_ROWS", 100)
    seen, plain, guides, guide = [], RandomForestRegressor.fit, [], DecisionTreeRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows: (
        seen.append([(tuple(r["features"]), r["calories"]) for r in rows.collect()]), plain(self, rows))[1])
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda self, rows: guides.append(guide(self, rows)) or guides[-1])
    rows = spark.range(400).selectExpr(*[f"id * 37 % {7 + i} * 1.0 as {c}" for i, c in enumerate(ml.NUTRITION_FEATURES)],
                                       "id % 7 * 10.0 + id % 8 as calories")
    model = ml.fit(ml.nutrition_forest(num_trees=4, max_depth=ml.ORDERED_DEPTH), rows, [*ml.NUTRITION_FEATURES, "calories"])
    held = sorted((tuple(r[:-1]), r[-1]) for r in rows.collect())
    assert all(sorted(each) == held and each == seen[0] for each in seen)   # every row, in one order
    from pyspark.ml.linalg import Vectors
    leaves = [guides[0].predictLeaf(Vectors.dense(x)) for x, _ in seen[0]]
    assert leaves == sorted(leaves) and len(set(leaves)) > 2
    assert model.stages[-1].getNumTrees == 4
