"""Fitted state: the scaler table (one row per retained feature)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def save_scaler(scaler: DataFrame, path: str, mode: str = "overwrite") -> None:
    scaler.repartition(1).write.mode(mode).parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no fitted scaler at {path}; fit the baseline first") from error
        raise
