"""Day tables: CSV at the edges, Parquet partitioned by day in between."""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Iterable, Mapping
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftflow.session import local_table, small_table

log = logging.getLogger(__name__)

# Day keys, in time order, with the file each day is published as.
DAY_FILES = {
    "feb14": "Wednesday-14-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb15": "Thursday-15-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb16": "Friday-16-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb20": "Thuesday-20-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb21": "Wednesday-21-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb22": "Thursday-22-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb23": "Friday-23-02-2018_TrafficForML_CICFlowMeter.csv",
    "feb28": "Wednesday-28-02-2018_TrafficForML_CICFlowMeter.csv",
    "mar01": "Thursday-01-03-2018_TrafficForML_CICFlowMeter.csv",
    "mar02": "Friday-02-03-2018_TrafficForML_CICFlowMeter.csv",
}


def day_files(base: str) -> dict[str, str]:
    """Registry day -> full path under ``base`` (a folder or an object-store prefix)."""
    return {day: f"{base.rstrip('/')}/{name}" for day, name in DAY_FILES.items()}


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _existing(spark: SparkSession, files: Mapping[str, str]) -> dict[str, str]:
    """The day files that exist. Every folder is listed once, however many files are asked for."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    by_folder: dict[str, dict[str, list[str]]] = {}
    for day, path in files.items():
        place = path_of(path)
        by_folder.setdefault(place.getParent().toString(), {}).setdefault(place.getName(), []).append(day)
    found = set()
    for folder, names in by_folder.items():
        place = path_of(folder)
        try:
            listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(place)
            while listed.hasNext():
                found.update(names.get(listed.next().getPath().getName(), ()))
        except Py4JJavaError as error:
            if "FileNotFoundException" not in str(error.java_exception.getClass().getName()):
                raise
    for day in files:
        if day not in found:
            log.warning("no file for day %s at %s, skipped", day, files[day])
    return {day: path for day, path in files.items() if day in found}


def _plain_path(path: str) -> str:
    """Without the slashes that stand for no host, and with the characters that a URL can't hold as they are."""
    return unquote(re.sub(r"^(\w+):/+(?=/)", r"\1:", path))


def _header_names(line: str) -> list[str]:
    """Column names of a header line; names that are empty or there twice are told apart by their place."""
    names = next(csv.reader([line], skipinitialspace=False), [])
    seen = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _headers(spark: SparkSession, files: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """``(file, day, first line)`` of every file, in one job. A day may be a folder of files."""
    lines = spark.read.text(list(files.values())).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("place"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("line")).collect()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    days = {}
    for day, path in files.items():
        place = fs_path(path)
        days[_plain_path(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())] = day
    out = []
    for row in first:
        plain = _plain_path(row["file"])
        day = days.get(plain) or days.get(plain.rsplit("/", 1)[0])
        if day is not None:
            out.append((row["file"], day, row["line"]))
    return sorted(out)


def day_groups(spark: SparkSession, files: Mapping[str, str], chunked: bool = False) -> list[tuple[list[str], DataFrame]]:
    """Every existing day file as text columns with trimmed names, plus ``day``, and the days in it; one table
    per set of columns, since days may differ in theirs.

    A day without a file is skipped with a warning. One job reads the first lines of all files; files with the
    same header are then one scan. ``chunked`` adds ``chunk``, the offset of the file split a row was read from.
    """
    there = _existing(spark, files)
    if not there:
        raise FileNotFoundError(f"none of the day files exists: {sorted(files.values())}")
    by_header: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for file, day, line in _headers(spark, there):
        by_header.setdefault(tuple(_header_names(line)), []).append((file, day))
    groups: dict[tuple[str, ...], list[tuple[list[str], DataFrame]]] = {}
    for header, found in by_header.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        raw = spark.read.schema(schema).option("header", True).csv([unquote(file) for file, _ in found])
        days = small_table(local_table(spark, found, pa.schema([("_file", pa.string()), ("day", pa.string())])))
        extra = [F.col("_metadata.file_block_start").alias("chunk")] if chunked else []
        table = raw.select(F.col("_metadata.file_path").alias("_file"), *extra,
                           *[F.col(f"`{name}`").alias(name.strip()) for name in header]).join(days, "_file")
        table = table.select("day", *[f"`{c}`" for c in table.columns if c not in ("_file", "day")])
        groups.setdefault(tuple(sorted(table.columns)), []).append((sorted({day for _, day in found}), table))
    return [(sorted({d for days, _ in parts for d in days}), reduce(DataFrame.unionByName, [t for _, t in parts]))
            for parts in groups.values()]


def read_day_files(spark: SparkSession, files: Mapping[str, str], chunked: bool = False) -> DataFrame:
    """All day files as one table; a column a day does not have is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t for _, t in day_groups(spark, files, chunked)])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows. Write the result before using the number more than once:
    only a written number is sure to be the same on every read."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_day_table(df: DataFrame, path: str, mode: str = "ignore") -> DataFrame:
    """Write a table partitioned by day and read it back.

    ``ignore`` keeps an earlier result (materialise once), ``append`` adds rows,
    ``overwrite`` replaces. The rebalance hint gathers each day into few files and
    still splits a day that is much bigger than the others.
    """
    df.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)
    return read_day_table(df.sparkSession, path, day_type=df.schema["day"].dataType, empty=df.schema)


def read_day_table(spark: SparkSession, path: str, days: Iterable | None = None,
                   day_type: T.DataType = T.StringType(), empty: T.StructType | None = None) -> DataFrame:
    """Read a day table; ``days`` prunes partitions, and absent days contribute no rows.

    Days that were appended later may have further columns. A table that was written
    without rows has no files to tell its columns: ``empty`` states them."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(path).schema
    except AnalysisException as error:
        if _is_missing(error):
            raise FileNotFoundError(f"no day table at {path}") from error
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA" and empty is not None:
            return spark.read.schema(empty).parquet(path)
        raise
    # The type of a partition column is only guessed from folder names, so state it.
    fields = [T.StructField("day", day_type) if f.name == "day" else f for f in found.fields]
    table = spark.read.schema(T.StructType(fields)).parquet(path)
    return table if days is None else table.where(F.col("day").isin(list(days)))


def days_in(spark: SparkSession, path: str) -> set:
    """The days that a day table holds; none if there is no such table. Only folder names are read."""
    try:
        table = read_day_table(spark, path, empty=T.StructType([T.StructField("day", T.StringType())]))
    except FileNotFoundError:
        return set()
    return {row["day"] for row in table.select("day").distinct().collect()}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line and no index; white space in cells is kept."""
    df.write.mode(mode).options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def empty_day_table(spark: SparkSession, features: Iterable[str], day_type: T.DataType = T.StringType(),
                    label: str = "label") -> DataFrame:
    """A table with the columns of a day table and no rows."""
    columns = [T.StructField("day", day_type)]
    columns += [T.StructField(f, T.DoubleType()) for f in features]
    columns += [T.StructField(label, T.StringType())]
    return spark.createDataFrame([], T.StructType(columns))


def is_populated(df: DataFrame) -> bool:
    return not df.isEmpty()


def day_of(path: Column, names: Mapping[str, str] = DAY_FILES) -> Column:
    """Day key of a file path, by its file name."""
    pairs = [F.lit(x) for day, name in names.items() for x in (name, day)]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(path, r"([^/]+)$", 1))

