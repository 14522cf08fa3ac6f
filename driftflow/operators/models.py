"""Classifiers and scoring, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.operators.network import Network, NetworkModel

THRESHOLD = 0.5


def _vector(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _staged(features: Sequence[str], classifier) -> Pipeline:
    return Pipeline(stages=[_vector(features), classifier])


def forest(features: Sequence[str], trees: int = 100, depth: int = 25, seed: int = 42) -> Pipeline:
    """Random forest that looks at the square root of the features per split."""
    return _staged(features, RandomForestClassifier(
        featuresCol="features", labelCol="target", numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy="sqrt"))


@dataclass(frozen=True)
class GrownForest:
    """A random forest that grows by ``step`` trees at a time, in a pipeline's place.

    Every step is a forest with a seed of its own; all trees vote alike. With a ``path`` a step is
    written there once it is fitted, and one that is there is read in place of being fitted, so a run
    that dies goes on where it was, and a larger ``trees`` adds to what was grown. A path belongs to
    one set of training rows and settings."""

    features: tuple[str, ...]
    trees: int = 100
    step: int = 25
    depth: int = 25
    seed: int = 42
    path: str | None = None

    def fit(self, train: DataFrame) -> GrownForestModel:
        return GrownForestModel(self.features, ()).grow(self, train)


class GrownForestModel:
    """The steps grown so far. Their votes are summed in one pass over the rows."""

    def __init__(self, features: Sequence[str], parts: Sequence[RandomForestClassificationModel]):
        self.features, self.parts = tuple(features), tuple(parts)

    @property
    def trees(self) -> int:
        return sum(part.getNumTrees for part in self.parts)

    def grow(self, forest: GrownForest, train: DataFrame) -> GrownForestModel:
        """This forest with as many further trees as ``forest`` wants; enough trees already are left as they are."""
        rows = None
        parts = list(self.parts)
        while (have := sum(part.getNumTrees for part in parts)) < forest.trees:
            number = len(parts)
            part = None if forest.path is None else _saved(f"{forest.path}/step={number}")
            if part is None:
                rows = _vector(self.features).transform(train) if rows is None else rows
                part = RandomForestClassifier(
                    featuresCol="features", labelCol="target", numTrees=min(forest.step, forest.trees - have),
                    maxDepth=forest.depth, seed=forest.seed + number, featureSubsetStrategy="sqrt").fit(rows)
                if forest.path is not None:
                    part.write().overwrite().save(f"{forest.path}/step={number}")
            parts.append(part)
        return GrownForestModel(self.features, parts)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``probability`` (an array) and ``prediction``; a tie goes to class 0."""
        voted = _vector(self.features).transform(rows)
        names = [f"_votes{i}" for i in range(len(self.parts))]
        for name, part in zip(names, self.parts):
            part = part.copy().setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("")
            voted = part.transform(voted)
        sums = [reduce(Column.__add__, [vector_to_array(name)[c] for name in names]) for c in (0, 1)]
        voted = voted.withColumn("_votes", F.array(*sums)).drop(*names)
        both = F.col("_votes")[0] + F.col("_votes")[1]
        return voted.withColumns({
            "probability": F.transform("_votes", lambda x: x / both),
            "prediction": (F.col("_votes")[1] > F.col("_votes")[0]).cast("double")}).drop("_votes")


def _saved(path: str) -> RandomForestClassificationModel | None:
    """The model written at ``path``; none where there is nothing, or a step that was not written to its end."""
    context = SparkSession.active().sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(context._jsc.hadoopConfiguration())
    if not all(files.exists(path_of(f"{path}/{part}/_SUCCESS")) for part in ("metadata", "treesMetadata", "data")):
        return None
    return RandomForestClassificationModel.load(path)


def perceptron(features: Sequence[str], hidden: Sequence[int] = (128, 64), iterations: int = 100,
               seed: int = 42) -> Pipeline:
    """Multilayer perceptron with two hidden layers (sigmoid units, softmax output)."""
    return _staged(features, MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="target", layers=[len(features), *hidden, 2],
        maxIter=iterations, seed=seed))


def fit(stages: Pipeline | Network | GrownForest, train: DataFrame) -> PipelineModel | NetworkModel | GrownForestModel:
    """Fit on rows with a ``target`` of 0 or 1. Stating the two classes spares the job
    that looks for them and keeps a one-class training set valid."""
    two_classes = {"ml_attr": {"type": "nominal", "name": "target", "vals": ["0", "1"]}}
    target = F.col("target").cast("double").alias("target", metadata=two_classes)
    return stages.fit(train.withColumn("target", target))


def over_threshold(probability: Column, threshold: float = THRESHOLD) -> Column:
    return (probability >= threshold).cast("int")


def score(model: PipelineModel | NetworkModel | GrownForestModel, rows: DataFrame, name: str, keep: Sequence[str] = ("day",),
          threshold: float | None = None) -> DataFrame:
    """``(model, keep..., target, predicted)``. Without a threshold the model's own vote
    counts, in which a tie goes to class 0."""
    scored = model.transform(rows)
    if threshold is None:
        predicted = F.col("prediction").cast("int")
    else:
        parts = F.col("probability")
        if scored.schema["probability"].dataType.typeName() != "array":
            parts = vector_to_array(parts)
        predicted = over_threshold(parts[1], threshold)
    return scored.select(F.lit(name).alias("model"), *keep, "target", predicted.alias("predicted"))
