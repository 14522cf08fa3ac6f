"""Confusion counts and the measures derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.functions.scalars import share

MEASURES = ["accuracy", "precision", "recall_detection_rate", "f1_score", "false_positive_rate"]


def confusion(scored: DataFrame, by: Sequence[str] = ("model", "day")) -> DataFrame:
    """``(by, tn, fp, fn, tp)``; a class that does not occur counts 0."""

    def cell(truth: int, said: int) -> Column:
        return F.count_if((F.col("target") == truth) & (F.col("predicted") == said))

    return scored.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                   cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def measures(confused: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, F1 and false-positive rate; x / 0 is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confused.withColumns({
        "accuracy": share(tp + tn, tn + fp + fn + tp),
        "precision": share(tp, tp + fp),
        "recall_detection_rate": share(tp, tp + fn),
        "f1_score": share(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": share(fp, fp + tn),
    })


def performance(scored: DataFrame, by: Sequence[str] = ("model", "day")) -> DataFrame:
    """One row per model and day with the five measures."""
    return measures(confusion(scored, by)).select(*by, *MEASURES)


def report(results: DataFrame, models: Sequence[str], measure: str = "f1_score") -> DataFrame:
    """One row per day, one column per model."""
    return results.groupBy("day").pivot("model", list(models)).agg(F.first(measure)).orderBy("day")
