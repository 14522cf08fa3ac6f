"""Synthetic rows of a class from a Gaussian copula.

The copula keeps how the features of a class depend on each other: each feature becomes normal
scores of its ranks, the scores' correlations are the model, and a draw is a correlated
normal vector taken back through the class's own quantiles. So a feature stays in the range
and near the distribution it has in the class, and two features stay as correlated as they
are there. A trained generator learns the same in one network; this needs no training.

Only classes with fewer rows than the target are modelled, so a class is less than ``target``
rows in and out of one task: its size has the bound that the caller gives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftflow.operators.balancing import GROUP, class_counts
from driftflow.operators.sampling import SEED
from driftflow.session import small_table

# The normal distribution function at the points that it is looked up by.
_Z = np.linspace(-8, 8, 1 << 15)
_P = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _Z])
# Share of independence that is mixed in until the correlations of a small class have a root.
_RIDGE = 1e-6


def normal_scores(values: np.ndarray) -> np.ndarray:
    """Normal scores of the ranks of each column: the mean of the normal values that a value stands for, which
    is a narrow range for a value that occurs once and a wide one for a value that repeats."""
    n = len(values)
    out = np.empty(values.shape)
    for j, column in enumerate(values.T):
        _, inverse, counts = np.unique(column, return_inverse=True, return_counts=True)
        ends = np.concatenate([[0.0], np.cumsum(counts) / n])
        height = np.exp(-np.interp(ends, _P, _Z) ** 2 / 2) / math.sqrt(2 * math.pi)
        out[:, j] = (-np.diff(height) * n / counts)[inverse]
    return out


def correlations(scores: np.ndarray) -> np.ndarray:
    """Correlations of the normal values behind the scores. Scores of values that repeat vary less than those
    values do, so their products are made up for it; a column of one value depends on nothing."""
    spread = (scores ** 2).mean(axis=0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    found = np.clip(scores.T @ scores / len(scores) / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(found, 1.0)
    return found


def root(correlation: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor; the fewer rows a class has, the more independence it takes."""
    ridge, one = _RIDGE, np.eye(len(correlation))
    while True:
        try:
            return np.linalg.cholesky((1 - ridge) * correlation + ridge * one)
        except np.linalg.LinAlgError:
            ridge = min(1.0, ridge * 10)


def draw(values: np.ndarray, wanted: int, name: str) -> np.ndarray:
    """``wanted`` rows like ``values`` (rows by features). ``name`` alone decides the random numbers."""
    n, d = values.shape
    key = int.from_bytes(hashlib.md5(name.encode()).digest(), "little")
    normal = np.random.Generator(np.random.Philox(key=key)).standard_normal((wanted, d))
    share = np.interp(normal @ root(correlations(normal_scores(values))).T, _Z, _P)
    out = np.empty((wanted, d))
    for j, column in enumerate(np.sort(values, axis=0).T):
        if n > 1 and (column[1:] > column[:-1]).all():
            out[:, j] = np.interp(share[:, j] * n - 0.5, np.arange(n), column)
        else:  # a value that repeats has a weight of its own, and nothing lies between two values
            out[:, j] = column[np.minimum((share[:, j] * n).astype(np.int64), n - 1)]
    return out


def _model(by: list[str], features: list[str], seed: int, schema: pa.Schema):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_row").combine_chunks()
        values = np.column_stack([table.column(f).to_numpy() for f in features])
        wanted = table.column("_wanted")[0].as_py()
        rows = draw(values, wanted, ":".join(str(k.as_py()) for k in key) + f":{seed}")
        columns = [pa.array([k.as_py()] * wanted, schema.field(b).type) for k, b in zip(key, by)]
        return pa.Table.from_arrays([*columns, pa.array(np.arange(1, wanted + 1)), *map(pa.array, rows.T)], schema=schema)
    return run


def synthesize_copula(scaled: DataFrame, features: Sequence[str], target: int, key: Column,
                      by: Sequence[str] = GROUP, seed: int = SEED) -> DataFrame:
    """``target - n`` synthetic rows for every class with n < ``target`` rows: ``by``, ``draw``, the features.

    Rows with a null feature are no model of the class and are left out of it; a class of only such rows gets
    none. A class of one row gives copies. Results do not depend on how the rows are split."""
    from pyspark.sql.pandas.types import to_arrow_schema
    by, features = list(by), list(features)
    poor = small_table(class_counts(scaled, by).where(F.col("n") < target).select(*by, (target - F.col("n")).alias("_wanted")))
    values = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    rows = scaled.select(*by, key.cast("string").alias("_row"), *values).na.drop(subset=features).join(poor, by)
    out = T.StructType([*[scaled.schema[b] for b in by], T.StructField("draw", T.LongType()),
                        *[T.StructField(f, T.DoubleType()) for f in features]])
    return rows.groupBy(*by).applyInArrow(_model(by, features, seed, to_arrow_schema(out)), out)
