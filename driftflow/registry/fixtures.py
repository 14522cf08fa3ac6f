"""The given tables in the shape of labelled day tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.operators.scaling import MinMax
from driftflow.operators.timeline import timeline_of
from driftflow.plans.static_drift import baseline_scaler

L_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
L_BENIGN = "N"
V_FEATURES = [f"f{i:02d}" for i in range(64)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def lineitem_days(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """``(day, label, features)``: the ship year is the day, the return flag the label.
    ``row_key`` joins all columns as integers and text, since no smaller key is unique."""
    key = F.concat_ws(
        "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _cents("l_quantity"), _cents("l_extendedprice"),
        _cents("l_discount"), _cents("l_tax"), "l_returnflag", "l_linestatus",
        F.unix_date(F.to_date("l_shipdate")))
    return read(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("day"), F.col("l_returnflag").alias("label"), *L_FEATURES,
        *([key.alias("row_key")] if keyed else []))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(day, label, value, event_id)``: calendar day, event type, one feature."""
    return read(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("label"), "value", "event_id")


def vector_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(day, label, f00..f63, vec_id)``: ten pseudo-days by ``vec_id``."""
    return read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).cast("int").alias("day"), F.col("label").cast("string").alias("label"), "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(V_FEATURES)])


def fitted(table: DataFrame, features: list[str]) -> tuple[DataFrame, MinMax]:
    """The days of a table and the scaler of its baseline days."""
    days = timeline_of(table)
    return days, MinMax.of(baseline_scaler(table, days, features))
