"""Random forests and boosted trees on Spark ML: fit, predict, report, cross-validate, search, explain.

A learner is a function from the label's name and its own settings to a Spark ML classifier. Everything
else takes any learner: probabilities of a class that training never saw are 0, folds are spread evenly
over the classes, and the scores of all folds and settings are computed in one aggregation, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetape.operators import splits, thresholds
from tonetape.session import shared_folder
from tonetape.sources import tables

FEATURES, PREDICTED = "Features", "Predicted_Label"
Learner = Callable[..., Estimator]
#: Fits that run side by side.
SIDE_BY_SIDE = 5
#: Training rows for which a task of its own pays: rows are small, the work on them is not.
ROWS_A_TASK = 8192


def assembler(features: Iterable[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error")


def forest(label: str = "Label", **settings) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=FEATURES, predictionCol=PREDICTED, **settings)


def boosted_trees(label: str = "Label", **settings) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol=FEATURES, predictionCol=PREDICTED, **settings)


#: The learners by name, for tables of several.
LEARNERS: dict[str, Learner] = {"forest": forest, "boosted_trees": boosted_trees}


def fit(train: DataFrame, features: Iterable[str], label: str = "Label", learner: Learner = forest, **settings) -> PipelineModel:
    """The learner fitted to 0/1 labels, of which the rows may show one only."""
    two = {"ml_attr": {"type": "nominal", "name": label, "vals": ["0", "1"]}}
    rows = train.withColumn(label, F.col(label).cast("double").alias(label, metadata=two))
    # A copy has no training summary: that holds the session, which can't go to tasks once it has observed a frame.
    return Pipeline(stages=[assembler(features), learner(label, **settings)]).fit(rows).copy()


def fit_forest(train: DataFrame, features: Iterable[str], label: str = "Label", **settings) -> PipelineModel:
    return fit(train, features, label, forest, **settings)


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows dealt out to all cores, where their few bytes would make a task or two; few rows stay as they are."""
    wanted = min(-(-rows.count() // ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() >= wanted:
        return rows
    dealt = rows.repartition(wanted).sortWithinPartitions(*keys)  # forests draw by place
    return tables.write_table(dealt, shared_folder(rows.sparkSession))


def predict(model: PipelineModel, rows: DataFrame, label: str = "Label") -> DataFrame:
    """The rows with ``label``, the class probabilities ``p0`` and ``p1`` and the predicted class."""
    probability = vector_to_array("probability")
    scored = model.transform(rows)
    others = [c for c in rows.columns if c not in (label, "label", "p0", "p1")]
    return scored.select(
        *others,
        F.col(label).cast("double").alias("label"),
        F.coalesce(F.get(probability, F.lit(0)), F.lit(0.0)).alias("p0"),
        F.coalesce(F.get(probability, F.lit(1)), F.lit(0.0)).alias("p1"),
        F.col(PREDICTED).alias("predicted"),
    )


def hard_auc(predictions: DataFrame) -> float:
    """Area under the curve of the predicted class itself."""
    hard = predictions.withColumns({"p1": F.col("predicted"), "p0": 1 - F.col("predicted")})
    return thresholds.probability_auc(hard).first()["auc"]


def probability_auc(predictions: DataFrame) -> float:
    return thresholds.probability_auc(predictions).first()["auc"]


def _accuracy() -> Column:
    return F.avg((F.col("predicted") == F.col("label")).cast("double"))


def accuracy(predictions: DataFrame) -> float:
    return predictions.agg(_accuracy().alias("accuracy")).first()["accuracy"]


def cross_predictions(
    rows: DataFrame,
    features: list[str],
    keys: list[str],
    label: str = "Label",
    *,
    learner: Learner = forest,
    folds: int = 5,
    settings: Iterable[Mapping] = ({},),
    fold_seed: int = 1,
) -> DataFrame:
    """Every row's prediction by the model that was fitted without its fold, once per setting.

    Columns ``setting`` (its place in the list) and ``fold`` tell them apart. One distributed fit per fold and
    setting, some side by side; the models stay, their scores are computed where the result is used.
    Folds come from ``splits.stratified_folds`` and are stored once, as every fit and prediction reads them.
    """
    numbered = splits.stratified_folds(rows, keys, label, folds, seed=fold_seed)
    folded = _spread(tables.write_table(numbered, shared_folder(rows.sparkSession)), keys)
    jobs = list(product(enumerate(settings), range(folds)))

    def scored(job) -> DataFrame:
        (place, chosen), fold = job
        model = fit(folded.filter(F.col("fold") != fold), features, label, learner, **chosen)
        return predict(model, folded.filter(F.col("fold") == fold), label).withColumn("setting", F.lit(place))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(scored), jobs))
    return reduce(DataFrame.unionByName, parts)


def cross_validated_auc(
    rows: DataFrame,
    features: list[str],
    keys: list[str],
    label: str = "Label",
    *,
    learner: Learner = forest,
    folds: int = 5,
    **settings,
) -> DataFrame:
    """One row: mean, population deviation, least and largest AUC over the folds that hold both classes."""
    predictions = cross_predictions(rows, features, keys, label, learner=learner, folds=folds, settings=[settings])
    return thresholds.probability_auc(predictions, ["fold"]).agg(
        F.mean("auc").alias("cv_mean"),
        F.stddev_pop("auc").alias("cv_std"),
        F.min("auc").alias("cv_min"),
        F.max("auc").alias("cv_max"),
    )


def model_report(model: PipelineModel, train: DataFrame, label: str = "Label") -> dict[str, float]:
    """Accuracy and AUC on the training rows."""
    scored = predict(model, train, label)
    return {"accuracy": accuracy(scored), "auc": probability_auc(scored)}


def search(
    rows: DataFrame,
    features: list[str],
    keys: list[str],
    choices: Mapping[str, Iterable],
    label: str = "Label",
    *,
    learner: Learner = forest,
    folds: int = 3,
    **settings,
) -> tuple[DataFrame, PipelineModel]:
    """Mean and sample deviation of the folds' accuracy per combination of ``choices``, and the best one refitted.

    Columns carry the choices' names; the first of equally good combinations is best. The table has one row
    per combination, and the only thing collected is the place of the best.
    """
    names = list(choices)
    every = [dict(zip(names, values)) for values in product(*(list(choices[n]) for n in names))]
    predictions = cross_predictions(
        rows, features, keys, label, learner=learner, folds=folds, settings=[{**settings, **chosen} for chosen in every]
    )
    of_fold = predictions.groupBy("setting", "fold").agg(_accuracy().alias("accuracy"))
    told = of_fold.groupBy("setting").agg(F.mean("accuracy").alias("mean_accuracy"), F.stddev("accuracy").alias("std_accuracy"))
    found = told.collect()  # one row per combination
    best = max(found, key=lambda r: (r["mean_accuracy"], -r["setting"]))["setting"]
    table = rows.sparkSession.createDataFrame(
        [(*every[r["setting"]].values(), r["mean_accuracy"], r["std_accuracy"], r["setting"] == best) for r in sorted(found)],
        [*names, "mean_accuracy", "std_accuracy", "is_best"],
    )
    return table, fit(_spread(rows, keys), features, label, learner, **{**settings, **every[best]})


def grid_search(
    rows: DataFrame,
    features: list[str],
    keys: list[str],
    label: str = "Label",
    *,
    features_per_split: Iterable[int] = (1, 3, 5),
    folds: int = 3,
    trees: int = 100,
    depth: int = 20,
    seed: int = 10,
) -> tuple[DataFrame, PipelineModel]:
    """Accuracy per number of features tried at a split, and the model refitted with the best.

    Spark has no least node size for a split; the rule "a node of 0.1% of the rows may split" is
    replaced by its nearest kin, at least half that many rows in each child. Each row keeps its node of every
    tree from level to level: the trees are the same, and no level walks all trees from their roots again.
    """
    least = max(1, int(rows.count() * 0.001 / 2))
    choices = {"featureSubsetStrategy": [str(n) for n in features_per_split]}
    fixed = {"numTrees": trees, "maxDepth": depth, "impurity": "entropy", "minInstancesPerNode": least, "seed": seed}
    fixed |= {"cacheNodeIds": True, "checkpointInterval": -1}
    table, best = search(rows, features, keys, choices, label, folds=folds, **fixed)
    number = F.col("featureSubsetStrategy").cast("int").alias("max_features")
    return table.select(number, "mean_accuracy", "std_accuracy", "is_best"), best


def importances(model: PipelineModel, spark: SparkSession, *, top: int | None = None) -> DataFrame:
    """Features of non-zero importance in their own order, or the ``top`` largest, largest first."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame(
        [(i, name, float(v)) for i, (name, v) in enumerate(zip(names, values))],
        "position int, feature string, importance double",
    )
    if top is None:
        return table.filter("importance > 0").orderBy("position")
    return table.orderBy(F.desc("importance"), "position").limit(top)
