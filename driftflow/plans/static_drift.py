"""Drift of every future day against the baseline days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.operators import distribution as D
from driftflow.operators import drift
from driftflow.operators.sampling import SEED, cap_rows
from driftflow.operators.scaling import MinMax, fit_scaler, project
from driftflow.operators.timeline import baseline_pairs
from driftflow.session import settle


def baseline_rows(df: DataFrame, days: DataFrame) -> DataFrame:
    return df.join(F.broadcast(days.where("role = 'baseline'").select("day")), "day", "left_semi")


def baseline_scaler(clean: DataFrame, days: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaler table from the baseline days: features that vary, with their bounds."""
    return fit_scaler(baseline_rows(clean, days), features)


def static_feature_drift(clean: DataFrame, days: DataFrame, scaler: MinMax, max_samples: int | None = None,
                         key: Column | None = None, seed: int = SEED, bins: int = drift.BINS) -> DataFrame:
    """``(cmp, feature, psi, wasserstein)`` for every future day that has rows.

    All rows count. ``max_samples`` caps the baseline and each day to that many values
    per feature, drawn by ``key``.
    """
    if max_samples is None:
        scaled = project(scaler.scale(clean), scaler.features, ["day"])
        return drift.feature_drift(scaled, scaler.features, baseline_pairs(days), bins=bins)
    table = scaler.scale(clean.withColumn("row_key", key.cast("string")))
    long = D.melt(table, scaler.features, ["day", "row_key"])
    capped = settle(D.value_counts(capped_values(long, days, max_samples, seed)), "value-counts")
    return drift.drift_of_counts(capped, baseline_pairs(days), bins=bins)


def capped_values(long: DataFrame, days: DataFrame, max_samples: int, seed: int = SEED) -> DataFrame:
    """At most ``max_samples`` values per feature of the joint baseline and of each future day."""
    roles = F.broadcast(days.select("day", "role"))
    side = F.when(F.col("role") == "baseline", F.lit("baseline")).otherwise(F.col("day").cast("string"))
    rows = long.join(roles, "day").withColumn("_side", side)
    key = F.concat_ws("|", "feature", "row_key")
    return cap_rows(rows, max_samples, ["_side", "feature"], key, seed).drop("_side", "role")


def static_drift(clean: DataFrame, days: DataFrame, scaler: MinMax, max_samples: int | None = None,
                 key: Column | None = None, bins: int = drift.BINS) -> DataFrame:
    """``(day, mean_psi, mean_wd)`` in the order of the days."""
    means = drift.mean_drift(static_feature_drift(clean, days, scaler, max_samples, key, bins=bins))
    order = F.broadcast(days.select("day", "ord"))
    return means.join(order, "day").orderBy("ord").drop("ord")
