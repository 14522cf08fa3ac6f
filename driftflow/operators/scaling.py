"""Feature selection and min-max scaling with bounds frozen on the baseline."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns of one aggregate; more make the generated code too long to be compiled.
SLICE = 100


def fit_scaler(baseline: DataFrame, features: Iterable[str]) -> DataFrame:
    """Scaler table ``(ord, feature, min, max)`` with one row per feature that varies.

    A feature of two values or more does not vary exactly if its least value is its
    greatest; a computed variance would depend on how the rows are split. A feature
    without a value goes, one with a single value stays.
    """
    fits = feature_fits(baseline, features)
    return fits.where("n = 1 OR (n > 1 AND min != max)").select("ord", "feature", "min", "max")


def feature_fits(table: DataFrame, features: Iterable[str]) -> DataFrame:
    """``(ord, feature, n, min, max)`` of every feature, null values left out.

    Aggregated as columns: every task sends one row for ``SLICE`` features.
    """
    features = list(features)
    parts = []
    for start in range(0, len(features), SLICE):
        names = list(enumerate(features[start:start + SLICE], start))
        values = {i: F.col(f"`{f}`").cast("double") for i, f in names}
        fits = [x for i, v in values.items() for x in (
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"))]
        rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"),
                         F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")) for i, f in names]
        parts.append(table.agg(*fits).select(F.inline(F.array(*rows))))
    if not parts:
        return table.sparkSession.createDataFrame([], "ord int, feature string, n bigint, min double, max double")
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class MinMax:
    """Bounds of the retained features, in order. As many entries as the table has features."""

    bounds: tuple[tuple[str, float, float], ...]

    @classmethod
    def of(cls, scaler: DataFrame) -> MinMax:
        rows = scaler.select("ord", "feature", "min", "max").collect()
        return cls(tuple((r["feature"], r["min"], r["max"]) for r in sorted(rows, key=lambda r: r["ord"])))

    @property
    def features(self) -> list[str]:
        return [f for f, _, _ in self.bounds]

    def _apply(self, df: DataFrame, change: str) -> DataFrame:
        return df.withColumns({
            f: F.expr(change.format(x=f"CAST(`{f}` AS DOUBLE)", low=f"({low!r}D)", width=f"{self._width(low, high)!r}D"))
            for f, low, high in self.bounds})

    def scale(self, df: DataFrame) -> DataFrame:
        """(x - min) / (max - min), not clipped."""
        return self._apply(df, "({x} - {low}) / {width}")

    def unscale(self, df: DataFrame) -> DataFrame:
        return self._apply(df, "{x} * {width} + {low}")

    @staticmethod
    def _width(low: float, high: float) -> float:
        """A feature with one value only is moved, not stretched."""
        return high - low or 1.0


def project(df: DataFrame, features: Iterable[str], keep: Iterable[str | Column] = ()) -> DataFrame:
    """Kept columns, then the retained features in order; a missing feature raises."""
    return df.select(*keep, *[F.col(f"`{f}`") for f in features])
