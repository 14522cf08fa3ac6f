"""The ordered days and who is compared with, or trained on, what.

These tables have one row per day (times the window length), whatever the size of
the data, and are joined as broadcast tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.session import local_table, small_table

WINDOW = 3


def timeline(spark: SparkSession, days: Sequence, baseline: int = WINDOW) -> DataFrame:
    """``(ord, day, role)`` from the days in time order; ord starts at 1."""
    rows = [(i, day, "baseline" if i <= baseline else "future") for i, day in enumerate(days, 1)]
    kind = pa.int32() if rows and isinstance(rows[0][1], int) else pa.string()
    return local_table(spark, rows, pa.schema([("ord", pa.int32()), ("day", kind), ("role", pa.string())]))


def timeline_of(df: DataFrame, baseline: int = WINDOW, day: str = "day", most: int | None = None) -> DataFrame:
    """The same table from the distinct days of ``df``, in the order of their values; null is no day.

    The calendar (one value per day) is read once and fixed from then on. A caller that
    expects no more than ``most`` days is told when the column holds more."""
    values = df.select(F.col(day).alias("day")).where("day IS NOT NULL").distinct()
    found = [row["day"] for row in (values if most is None else values.limit(most + 1)).collect()]
    if most is not None and len(found) > most:
        raise ValueError(f"column {day} has more than {most} values")
    return timeline(df.sparkSession, sorted(found), baseline)


def window_schedule(days: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(test_ord, test_day, window_ord, window_day)``: the k days before each future day."""
    before = days.select(
        F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + k)).alias("test_ord"),
        F.col("ord").alias("window_ord"), F.col("day").alias("window_day"))
    return _tests(days).join(before, "test_ord").select("test_ord", "test_day", "window_ord", "window_day")


def exit_schedule(days: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(test_ord, test_day, exit_ord, exit_day)``: the day that leaves the window after each test."""
    leaving = days.select((F.col("ord") + k).alias("test_ord"),
                          F.col("ord").alias("exit_ord"), F.col("day").alias("exit_day"))
    return _tests(days).join(leaving, "test_ord").select("test_ord", "test_day", "exit_ord", "exit_day")


def anchor_schedule(days: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(test_ord, test_day, anchor_ord, anchor_day)``: every day that left the window before a test."""
    numbered = days.withColumn("_last", F.max("ord").over(W.partitionBy()))
    past = numbered.where(F.col("ord") + k + 1 <= F.col("_last")).select(
        F.explode(F.sequence(F.col("ord") + k + 1, F.col("_last"))).alias("test_ord"),
        F.col("ord").alias("anchor_ord"), F.col("day").alias("anchor_day"))
    return _tests(days).join(past, "test_ord").select("test_ord", "test_day", "anchor_ord", "anchor_day")


def _tests(days: DataFrame) -> DataFrame:
    return days.where("role = 'future'").select(F.col("ord").alias("test_ord"), F.col("day").alias("test_day"))


def baseline_pairs(days: DataFrame) -> DataFrame:
    """``(cmp, day, side)``: every future day against all baseline days."""
    base_days = F.collect_list(F.when(F.col("role") == "baseline", F.col("day"))).over(W.partitionBy())
    future = (
        days.withColumn("_base", base_days).where("role = 'future'")
        .select(F.col("day").alias("cmp"), "_base")
    )
    base = future.select("cmp", F.explode("_base").alias("day"), F.lit("base").alias("side"))
    return small_table(base.unionByName(
        future.select("cmp", F.col("cmp").alias("day"), F.lit("test").alias("side"))))


def window_pairs(days: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(cmp, day, side)``: every future day against the k days before it."""
    base = window_schedule(days, k).select(
        F.col("test_day").alias("cmp"), F.col("window_day").alias("day"), F.lit("base").alias("side"))
    test = _tests(days).select(
        F.col("test_day").alias("cmp"), F.col("test_day").alias("day"), F.lit("test").alias("side"))
    return small_table(base.unionByName(test))
