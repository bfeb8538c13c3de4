import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonetape.operators import forest, thresholds


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    cells = []
    for i in range(400):
        x, noise = rng.random(), rng.random()
        cells.append((i, x, noise, 0.0, float(x + 0.1 * rng.random() > 0.55)))
    return spark.createDataFrame(cells, "id int, x double, noise double, flat double, Label double").cache()


@pytest.fixture(scope="module")
def model(rows):
    return forest.fit_forest(rows, ["x", "noise", "flat"], numTrees=10, seed=1)


def test_predictions_and_report(rows, model):
    scored = forest.predict(model, rows)
    assert scored.columns == ["id", "x", "noise", "flat", "label", "p0", "p1", "predicted"]
    assert scored.filter("abs(p0 + p1 - 1) > 1e-9 or predicted != cast(p1 > p0 as double)").count() == 0
    report = forest.model_report(model, rows)
    assert report["accuracy"] > 0.9 and report["auc"] > 0.95
    closed = thresholds.confident_auc(scored).first().auc
    assert forest.hard_auc(scored) == pytest.approx(closed)


def test_importances(spark, model):
    used = forest.importances(model, spark).collect()
    assert [r.feature for r in used] == ["x", "noise"]
    assert [r.feature for r in forest.importances(model, spark, top=1).collect()] == ["x"]


def test_cross_validation(rows):
    row = forest.cross_validated_auc(rows, ["x", "noise"], ["id"], folds=3, numTrees=5, seed=1).first()
    assert 0.9 < row.cv_min <= row.cv_mean <= row.cv_max <= 1.0 and row.cv_std >= 0


def test_grid_search(rows):
    table, best = forest.grid_search(rows, ["x", "noise", "flat"], ["id"], features_per_split=(1, 3), trees=5, depth=4)
    found = table.collect()
    assert [r.max_features for r in found] == [1, 3] and sum(r.is_best for r in found) == 1
    chosen = next(r for r in found if r.is_best)
    assert best.stages[-1].getOrDefault("featureSubsetStrategy") == str(chosen.max_features)
    assert chosen.mean_accuracy == max(r.mean_accuracy for r in found)


@pytest.mark.parametrize("learner", sorted(forest.LEARNERS))
def test_training_on_one_class(frame, learner):
    """A class that training never saw has probability 0, and nothing raises."""
    rows = frame([(i, float(i % 7), 0.0) for i in range(40)], "id int, x double, Label double")
    model = forest.fit(rows, ["x"], learner=forest.LEARNERS[learner])
    scored = forest.predict(model, rows)
    assert scored.filter("abs(p0 + p1 - 1) > 1e-9 OR predicted <> 0 OR p1 > 0.5").count() == 0


def test_two_positives_in_sixty_rows(frame):
    rows = frame([(i, float(i), float(i in (20, 40))) for i in range(60)], "id int, x double, Label double")
    found = forest.cross_predictions(rows, ["x"], ["id"], folds=3, settings=[{"numTrees": 3, "seed": 1}])
    assert sorted(r.id for r in found.collect()) == list(range(60))
    row = forest.cross_validated_auc(rows, ["x"], ["id"], folds=3, numTrees=3, seed=1).first()
    assert 0 <= row.cv_min <= row.cv_max <= 1


def test_search_over_any_learner(rows):
    choices = {"maxDepth": [1, 2], "maxIter": [1, 3]}
    table, best = forest.search(rows, ["x", "noise"], ["id"], choices, learner=forest.boosted_trees, folds=2, seed=1)
    found = table.collect()
    assert [(r.maxDepth, r.maxIter) for r in found] == [(1, 1), (1, 3), (2, 1), (2, 3)]
    chosen = next(r for r in found if r.is_best)
    assert chosen.mean_accuracy == max(r.mean_accuracy for r in found) > 0.8
    assert best.stages[-1].getOrDefault("maxIter") == chosen.maxIter


def test_fits_read_stored_folds_dealt_out_to_the_cores(rows, monkeypatch):
    """A fit of few bytes but many rows has more than one task, and does not number the folds again."""
    seen, keep = [], forest.fit

    def fit(train, *rest, **settings):
        seen.append((train.rdd.getNumPartitions(), train._jdf.queryExecution().executedPlan().toString()))
        return keep(train, *rest, **settings)

    monkeypatch.setattr(forest, "fit", fit)
    monkeypatch.setattr(forest, "ROWS_A_TASK", 100, raising=False)
    one = rows.coalesce(1)
    forest.search(one, ["x", "noise"], ["id"], {"numTrees": [2, 3]}, folds=2, seed=1)
    assert len(seen) == 5 and all(n >= 4 for n, _ in seen)
    assert not any("Window" in plan or "Exchange" in plan for _, plan in seen)


def test_grid_search_walks_no_tree_again(rows, monkeypatch):
    """Rows keep their nodes between levels, and the trees are those of a walk from the roots."""
    settings, keep = [], forest.search

    def search(*rest, **given):
        settings.append({k: given[k] for k in ("numTrees", "maxDepth", "impurity", "minInstancesPerNode", "seed", "cacheNodeIds")})
        return keep(*rest, **given)

    monkeypatch.setattr(forest, "search", search)
    forest.grid_search(rows, ["x", "noise"], ["id"], features_per_split=(1,), folds=2, trees=3, depth=4)
    assert settings[0]["cacheNodeIds"]
    one = rows.coalesce(1)
    walked = forest.fit_forest(one, ["x", "noise"], **{**settings[0], "cacheNodeIds": False})
    kept = forest.fit_forest(one, ["x", "noise"], **settings[0])
    assert kept.stages[-1].toDebugString.split("\n")[1:] == walked.stages[-1].toDebugString.split("\n")[1:]


def test_models_predict_in_a_session_that_observed(spark):
    seen = Observation()
    rows = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, Label double")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 40
    for learner in forest.LEARNERS.values():
        assert forest.predict(forest.fit(rows, ["x"], learner=learner, seed=1), rows).select("p1").distinct().count() > 0
