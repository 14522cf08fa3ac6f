"""Class balancing of day tables.

Rich classes are sampled down to the target. Poor classes keep their rows and get
synthetic ones: a point between two rows of the same class and day, picked by hash.
This replaces a trained generator. It stays inside the range each feature has in the
class, but does not learn how features depend on each other beyond pairs of rows;
:func:`copula.synthesize_copula` does, and can be given to :func:`balance_days` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.functions import scalars as S
from driftflow.operators.sampling import (
    SEED, cap_rows, draws, group_sizes, number_rows, salt_of_draw, salted, with_salts,
)
from driftflow.operators.scaling import MinMax
from driftflow.session import settle, small_table

TARGET = 100_000
GROUP = ("day", "label")


def class_counts(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """``(by, n)``; rows with a null label belong to no class."""
    return group_sizes(df.na.drop(subset=list(by)), by)


def ranked_class_counts(df: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Class counts in descending order."""
    return class_counts(df, by).orderBy(F.desc("n"), *by)


def downsample_classes(df: DataFrame, target: int, key: Column, by: Sequence[str] = GROUP,
                       seed: int = SEED) -> DataFrame:
    """Exactly ``target`` rows of each class that has as many; smaller classes stay whole."""
    return cap_rows(df, target, by, key, seed)


def synthesize_minority(scaled: DataFrame, features: Sequence[str], target: int, key: Column,
                        by: Sequence[str] = GROUP, seed: int = SEED) -> DataFrame:
    """``target - n`` synthetic rows for every class with n < ``target`` rows.

    Input and output are in scaled space; output is clipped to [0, 1] and has the
    columns ``by``, ``draw`` and the features. Row numbers i and j and the weight a of
    ``a x_i + (1 - a) x_j`` are hashes of the class, the draw and the seed. A class of
    one row gives copies.
    """
    by, features = list(by), list(features)
    classes = class_counts(scaled, by).where(F.col("n") < target).withColumn("_wanted", target - F.col("n"))
    poor = small_table(with_salts(classes, "n", "_wanted"))
    # Written once, since both rows of a pair come from it: fewer than ``target`` rows of a class.
    pool = settle(number_rows(scaled.join(poor.select(*by, "_salts"), by).select(
        *by, "_salts", key.alias("_row"), *_quoted(features)), by, F.col("_row"), seed, most=target), "pool")
    pool = salted(pool)
    parts = [F.col(c) for c in by] + [F.col("draw")]

    def pick(which: str) -> Column:
        return 1 + F.pmod(S.hash_number(*parts, which, seed), F.col("n"))

    drawn = draws(poor, by, "_wanted").select(
        *by, "draw", salt_of_draw(), pick("i").alias("_i"), pick("j").alias("_j"), S.hash_uniform(*parts, "a", seed).alias("_a"))
    first = pool.select(*by, "_salt", F.col("_index").alias("_i"), F.struct(*_quoted(features)).alias("_x"))
    second = pool.select(*by, "_salt", F.col("_index").alias("_j"), F.struct(*_quoted(features)).alias("_y"))
    mixed = drawn.join(first, [*by, "_salt", "_i"]).join(second, [*by, "_salt", "_j"])
    a = F.col("_a")
    return mixed.select(*by, "draw", *[
        S.clip(a * F.col("_x").getField(f) + (1 - a) * F.col("_y").getField(f)).alias(f) for f in features])


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def balance_days(df: DataFrame, scaler: MinMax, target: int, key: Column, by: Sequence[str] = GROUP,
                 seed: int = SEED, synthesize: Callable[..., DataFrame] = synthesize_minority) -> DataFrame:
    """Every class of every day brought to exactly ``target`` rows, in raw units.

    One plan for all days and classes. Columns: ``by``, the retained features and
    ``row_key``, which tells the rows of a class apart; a table without one of the
    features raises. Real rows keep their raw values.
    """
    by = list(by)
    table = df.select(*by, *_quoted(scaler.features), key.cast("string").alias("row_key"))
    real = downsample_classes(table, target, F.col("row_key"), by, seed)
    synthetic = synthesize(scaler.scale(table), scaler.features, target, F.col("row_key"), by, seed)
    return (
        real.withColumn("row_key", F.concat(F.lit("real:"), "row_key"))
        .unionByName(scaler.unscale(synthetic).withColumn("row_key", F.concat(F.lit("new:"), F.col("draw").cast("string")))
                     .drop("draw"))
    )
