"""Static run: fit once on the balanced baseline, score every future day."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame

from driftflow.operators import evaluation, models
from driftflow.operators.scaling import MinMax
from driftflow.operators.training import BENIGN, static_sets


def default_models(features: list[str], suffix: str) -> dict[str, tuple[Pipeline, float | None]]:
    """Model name -> (stages, probability threshold or None for the model's own vote)."""
    return {
        f"RandomForest_{suffix}": (models.forest(features), None),
        f"MLP_{suffix}": (models.perceptron(features), models.THRESHOLD),
    }


def static_scores(clean: DataFrame, balanced: DataFrame, days: DataFrame, scaler: MinMax,
                  stages: Mapping[str, tuple[Pipeline, float | None]] | None = None,
                  benign: str = BENIGN) -> DataFrame:
    """``(model, day, target, predicted)``: one pass over all future days per model."""
    stages = stages or default_models(scaler.features, "Static")
    train, test = static_sets(clean, balanced, days, scaler, benign)
    parts = [models.score(models.fit(s, train), test, name, threshold=t) for name, (s, t) in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def static_experiment(clean: DataFrame, balanced: DataFrame, days: DataFrame, scaler: MinMax,
                      stages: Mapping[str, tuple[Pipeline, float | None]] | None = None,
                      benign: str = BENIGN) -> DataFrame:
    """``(model, day, accuracy, precision, recall, F1, false-positive rate)``."""
    return evaluation.performance(static_scores(clean, balanced, days, scaler, stages, benign))
