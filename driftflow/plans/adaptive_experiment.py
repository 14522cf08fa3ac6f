"""Adaptive run: a model per future day, trained on the days before it and the anchor."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.operators import drift, evaluation, models
from driftflow.operators.scaling import MinMax, project
from driftflow.operators.timeline import WINDOW, window_pairs
from driftflow.operators.training import ANCHOR_FRACTION, BENIGN, history_anchor, model_rows, training_pool
from driftflow.plans.static_experiment import default_models
from driftflow.session import settle, spread

# Days whose models are fitted at the same time.
AT_ONCE = 3


def active_window_feature_drift(clean: DataFrame, days: DataFrame, scaler: MinMax, k: int = WINDOW,
                                bins: int = drift.BINS) -> DataFrame:
    """``(cmp, feature, psi, wasserstein)`` of each future day against its window, no cap."""
    scaled = project(scaler.scale(clean), scaler.features, ["day"])
    return drift.feature_drift(scaled, scaler.features, window_pairs(days, k), closed=True, bins=bins)


def active_window_drift(clean: DataFrame, days: DataFrame, scaler: MinMax, k: int = WINDOW,
                        bins: int = drift.BINS) -> DataFrame:
    """``(day, mean_psi, mean_wd)`` of each future day against its window."""
    return drift.mean_drift(active_window_feature_drift(clean, days, scaler, k, bins))


def adaptive_scores(clean: DataFrame, balanced: DataFrame, days: DataFrame, scaler: MinMax, key: Column,
                    stages: Mapping[str, tuple[Pipeline, float | None]] | None = None,
                    benign: str = BENIGN, k: int = WINDOW, fraction: float = ANCHOR_FRACTION,
                    anchor: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``(model, day, target, predicted)``.

    The days (a few) do not wait for each other, since the anchor of a day is a filter over one sample. Up to
    ``at_once`` of them are fitted at the same time, each from a thread and a scheduler pool of its own (fair
    shares where the session has ``spark.scheduler.mode=FAIR``); every fit is a distributed job. The rows a day
    trains on are written once and read by all its models, on all cores however few files they are in.
    """
    stages = stages or default_models(scaler.features, "Adaptive")
    anchor = history_anchor(balanced, key, fraction) if anchor is None else anchor
    tests = sorted((r["ord"], r["day"]) for r in days.where("role = 'future'").collect())
    spark = clean.sparkSession

    def one_day(test_ord: int, test_day) -> list[DataFrame]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"day-{test_ord}")
        train = spread(settle(model_rows(training_pool(balanced, anchor, days, test_ord, k), scaler, benign, keep=()), "training-pool"))
        test = model_rows(clean.where(F.col("day") == F.lit(test_day)), scaler, benign)
        return [models.score(models.fit(s, train), test, name, threshold=t) for name, (s, t) in stages.items()]

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as threads:
        # A target of its own for each day: each takes a copy of the properties that are set here.
        running = [threads.submit(inheritable_thread_target(spark)(one_day), *test) for test in tests]
        parts = [part for found in running for part in found.result()]
    return reduce(DataFrame.unionByName, parts)


def adaptive_experiment(clean: DataFrame, balanced: DataFrame, days: DataFrame, scaler: MinMax, key: Column,
                        stages: Mapping[str, tuple[Pipeline, float | None]] | None = None,
                        benign: str = BENIGN, k: int = WINDOW, anchor: DataFrame | None = None) -> DataFrame:
    """Performance per model and day with the drift of the day's window attached."""
    scored = adaptive_scores(clean, balanced, days, scaler, key, stages, benign, k, anchor=anchor)
    window = active_window_drift(clean, days, scaler, k).select(
        "day", F.col("mean_psi").alias("active_window_psi"), F.col("mean_wd").alias("active_window_wd"))
    return evaluation.performance(scored).join(window, "day", "left").select(
        "model", "day", *evaluation.MEASURES, "active_window_psi", "active_window_wd")
