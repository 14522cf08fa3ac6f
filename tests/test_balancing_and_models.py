import pytest
from pyspark.sql import functions as F

from driftflow.operators import balancing, evaluation, models, scaling, timeline, training
from driftflow.plans import adaptive_experiment, static_drift, static_experiment


@pytest.fixture(scope="module")
def flows(spark):
    """Ten days, 60 rows each; the attack is shifted; class sizes 40, 18 and 2."""
    rows = []
    for day in range(1, 11):
        for i in range(60):
            label = "Benign" if i < 40 else "Bot" if i < 58 else "Rare"
            x = (i * 37 % 100) / 100 + (0.0 if label == "Benign" else 3.0)
            rows.append((day, label, day * 100 + i, x, x * x + day * 0.01, 7.0))
    return spark.createDataFrame(rows, "day int, label string, id int, x double, y double, flat double").cache()


@pytest.fixture(scope="module")
def days(spark):
    return timeline.timeline(spark, list(range(1, 11)))


@pytest.fixture(scope="module")
def scaler(flows, days):
    return scaling.MinMax.of(static_drift.baseline_scaler(flows, days, ["x", "y", "flat"]))


@pytest.fixture(scope="module")
def balanced(flows, scaler):
    return balancing.balance_days(flows, scaler, 18, F.col("id")).cache()


def test_constant_and_absent_features_go(spark, scaler):
    assert scaler.features == ["x", "y"]
    one = spark.createDataFrame([(3.0, None)], "a double, b double")
    assert scaling.MinMax.of(scaling.fit_scaler(one, ["a", "b"])).bounds == (("a", 3.0, 3.0),)


def test_scaling_goes_out_of_range_and_back(spark):
    scaler = scaling.MinMax((("x", 2.0, 4.0), ("c", 5.0, 5.0)))
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 6.0), (5.0, 7.0)], "x double, c double")
    assert [tuple(r) for r in scaler.scale(df).collect()] == [(-0.5, 0.0), (0.5, 1.0), (1.5, 2.0)]
    assert scaler.unscale(scaler.scale(df)).collect() == df.collect()


def test_every_class_reaches_the_target(balanced):
    counts = balancing.class_counts(balanced).collect()
    assert len(counts) == 30 and {r["n"] for r in counts} == {18}
    kinds = balanced.groupBy("label", F.substring_index("row_key", ":", 1).alias("kind")).count().collect()
    assert {(r["label"], r["kind"]): r["count"] for r in kinds} == {
        ("Benign", "real"): 180, ("Bot", "real"): 180, ("Rare", "real"): 20, ("Rare", "new"): 160}
    assert balanced.select("day", "label", "row_key").distinct().count() == balanced.count()


def test_synthetic_rows_lie_between_rows_of_their_class(flows, scaler):
    scaled = scaler.scale(flows)
    made = balancing.synthesize_minority(scaled, scaler.features, 18, F.col("id"))
    span = scaled.groupBy("day", "label").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    inside = F.col("x").between(F.greatest(F.lit(0.0), "low") - 1e-12, F.least(F.lit(1.0), "high") + 1e-12)
    assert made.join(span, ["day", "label"]).where(~inside).count() == 0
    assert made.where("x < 0 or x > 1 or y < 0 or y > 1").count() == 0


def test_a_class_of_one_row_gives_copies(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.3)], "day int, label string, id int, x double")
    rows = balancing.synthesize_minority(df, ["x"], 5, F.col("id")).collect()
    assert sorted(r["draw"] for r in rows) == [1, 2, 3, 4] and all(r["x"] == pytest.approx(0.3) for r in rows)


def test_class_at_the_target_is_kept_whole(flows):
    kept = balancing.downsample_classes(flows, 18, F.col("id")).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {"Benign": 180, "Bot": 180, "Rare": 20}


def test_anchor_and_pools(balanced, days, flows):
    anchor = training.history_anchor(balanced, F.col("row_key"), fraction=0.25).cache()
    assert anchor.count() == 10 * 3 * 4  # 0.25 * 18 = 4.5, half to even
    counts = {r["test_ord"]: r for r in training.pool_counts(balanced, anchor, days, flows).collect()}
    for t in range(4, 11):
        row = counts[t]
        assert (row["window_rows"], row["anchor_rows"], row["test_rows"]) == (3 * 54, 12 * max(0, t - 4), 60)
        assert row["total_rows"] == row["window_rows"] + row["anchor_rows"]
    pool = training.training_pool(balanced, anchor, days, 6).groupBy("src", "day").count().collect()
    assert {(r["src"], r["day"]): r["count"] for r in pool} == {
        ("window", 3): 54, ("window", 4): 54, ("window", 5): 54, ("anchor", 1): 12, ("anchor", 2): 12}


def test_measures_with_one_class(spark):
    rows = [("m", 1, 0, 0), ("m", 1, 0, 0), ("m", 2, 1, 1), ("m", 2, 1, 0), ("m", 2, 0, 1), ("m", 2, 0, 0)]
    df = spark.createDataFrame(rows, "model string, day int, target int, predicted int")
    got = {r["day"]: r for r in evaluation.performance(df).collect()}
    assert [got[1][m] for m in evaluation.MEASURES] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [got[2][m] for m in evaluation.MEASURES] == [0.5, 0.5, 0.5, 0.5, 0.5]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "p double")
    assert [r[0] for r in df.select(models.over_threshold(F.col("p"))).collect()] == [1, 0]


def test_static_run(flows, balanced, days, scaler):
    stages = {"f": (models.forest(scaler.features, trees=3, depth=3), None)}
    scored = static_experiment.static_scores(flows, balanced, days, scaler, stages)
    sizes = evaluation.confusion(scored).selectExpr("day", "tn + fp + fn + tp AS n").collect()
    assert {r["day"]: r["n"] for r in sizes} == {d: 60 for d in range(4, 11)}
    results = evaluation.performance(scored).collect()
    assert all(r["accuracy"] == 1.0 for r in results)  # the classes do not overlap


def test_adaptive_run(spark, flows, balanced, scaler):
    few = timeline.timeline(spark, list(range(1, 6)))
    stages = {"f": (models.forest(scaler.features, trees=2, depth=2), None),
              "p": (models.perceptron(scaler.features, hidden=(3, 2), iterations=3), models.THRESHOLD)}
    table = flows.where("day <= 5")
    found = adaptive_experiment.adaptive_experiment(table, balanced.where("day <= 5"), few, scaler,
                                                    F.col("row_key"), stages)
    rows = found.collect()
    assert sorted((r["model"], r["day"]) for r in rows) == [("f", 4), ("f", 5), ("p", 4), ("p", 5)]
    assert all(0 <= r[m] <= 1 for r in rows for m in evaluation.MEASURES)
    assert all(r["active_window_psi"] >= 0 and r["active_window_wd"] > 0 for r in rows)


def test_default_models_have_the_full_size(scaler):
    stages = static_experiment.default_models(scaler.features, "Static")
    forest = stages["RandomForest_Static"][0].getStages()[1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (100, 25, 42)
    assert stages["MLP_Static"][0].getStages()[1].getLayers() == [2, 128, 64, 2]


def test_days_are_fitted_at_the_same_time(spark):
    """Jobs of several days run in pools of their own, and give what one day after the other gives."""
    rows = spark.range(600).select(
        (F.col("id") % 6).cast("int").alias("day"), F.when(F.col("id") % 7 < 3, "Bot").otherwise("Benign").alias("label"),
        (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("string").alias("row_key"))
    days = timeline.timeline(spark, range(6))
    scaler = scaling.MinMax((("a", 0.0, 6.0),))
    stages = {"tree": (models.forest(["a"], trees=3, depth=4), None)}

    def scored(at_once):
        out = adaptive_experiment.adaptive_scores(rows, rows, days, scaler, F.col("row_key"), stages, at_once=at_once)
        return sorted(map(tuple, out.groupBy("model", "day", "target", "predicted").count().collect()))

    together = scored(3)
    assert together == scored(1) and {r[1] for r in together} == {3, 4, 5}
    assert all(r[2] == r[3] for r in together)


def test_a_day_trains_on_all_cores(spark, monkeypatch):
    """Its rows are dealt out, though they are written to a few small files."""
    rows = spark.range(600).coalesce(1).select(
        (F.col("id") % 4).cast("int").alias("day"), F.when(F.col("id") % 7 < 3, "Bot").otherwise("Benign").alias("label"),
        (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("string").alias("row_key"))
    seen, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda stages, train: seen.append((train.rdd.getNumPartitions(), train.count())) or fit(stages, train))
    adaptive_experiment.adaptive_scores(
        rows, rows, timeline.timeline(spark, range(4)), scaling.MinMax((("a", 0.0, 6.0),)), F.col("row_key"),
        {"tree": (models.forest(["a"], trees=3, depth=4), None)})
    assert seen == [(spark.sparkContext.defaultParallelism, 450)]


def test_a_forest_grown_in_steps_goes_on_where_it_was(spark, tmp_path):
    rows = [(1, float(i % 10), float(i % 7), int(i % 10 >= 5)) for i in range(200)]
    train = spark.createDataFrame(rows, "day int, a double, b double, target int")
    kept = str(tmp_path / "forest")
    half = models.fit(models.GrownForest(("a", "b"), trees=5, step=3, depth=4, path=kept), train)
    assert (half.trees, [p.getNumTrees for p in half.parts]) == (5, [3, 2])
    (tmp_path / "forest" / "step=1" / "data" / "_SUCCESS").unlink()  # a run that died while it wrote its second step
    full = models.fit(models.GrownForest(("a", "b"), trees=9, step=3, depth=4, path=kept), train)
    assert [p.getNumTrees for p in full.parts] == [3, 3, 3]
    assert full.parts[0].toDebugString.split("\n")[1:] == half.parts[0].toDebugString.split("\n")[1:]
    out = models.score(full, train, "grown").collect()
    assert len(out) == 200 and all(r.target == r.predicted for r in out)
    # Votes are the sums of the steps' votes, as one forest of all trees would have them.
    got = full.transform(train).select("a", "b", "probability").distinct().collect()
    vector = models._vector(("a", "b")).transform(train.select("a", "b").distinct())
    want = {}
    for part in full.parts:
        for r in part.transform(vector).collect():
            want[r.a, r.b] = want.get((r.a, r.b), 0) + r.rawPrediction[1] / full.trees
    assert {(r.a, r.b): round(r.probability[1], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    more = half.grow(models.GrownForest(("a", "b"), trees=5), train)
    assert more.trees == 5
