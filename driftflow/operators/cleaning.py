"""Cleaning of raw day tables: labels, numbers, bad values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.functions import scalars as S

# Raw label text -> standard label.
LABEL_MAP = {
    "Benign": "Benign",
    "FTP-BruteForce": "FTP-BruteForce",
    "SSH-Bruteforce": "SSH-Bruteforce",
    "DoS attacks-GoldenEye": "DoS attacks-GoldenEye",
    "DoS attacks-Slowloris": "DoS attacks-Slowloris",
    "DoS attacks-Hulk": "DoS attacks-Hulk",
    "DoS attacks-SlowHTTPTest": "DoS attacks-SlowHTTPTest",
    "DDoS attacks-LOIC-HTTP": "DDoS attacks-LOIC-HTTP",
    "DDOS attack-HOIC": "DDoS attacks-HOIC",
    "DDOS attack-LOIC-UDP": "DDoS attacks-LOIC-UDP",
    "Brute Force -Web": "Brute Force-Web",
    "Brute Force -XSS": "Brute Force-XSS",
    "SQL Injection": "SQL-Injection",
    "Infilteration": "Infiltration",
    "Infiltration": "Infiltration",
    "Bot": "Bot",
}


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def feature_names(df: DataFrame, without: Iterable[str] = ("Label",)) -> list[str]:
    """All columns but the label and other named ones, in order."""
    dropped = set(without)
    return [name for name in df.columns if name not in dropped]


def drop_header_rows(df: DataFrame, label: str = "Label") -> DataFrame:
    """Drop header lines that repeat inside a file; rows with a null label stay."""
    return df.where(~S.strip(F.col(label).cast("string")).eqNullSafe(F.lit(label)))


def standard_label(raw: Column, mapping: Mapping[str, str] = LABEL_MAP) -> Column:
    """Trimmed label looked up in ``mapping``; null when it is not there."""
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), S.strip(raw.cast("string")))


def standardize_labels(df: DataFrame, label: str = "Label", into: str = "label",
                       mapping: Mapping[str, str] = LABEL_MAP) -> DataFrame:
    """Drop repeated headers, map the labels and drop rows whose label is unknown or null."""
    table = drop_header_rows(df, label)
    table = table.withColumn("_label", standard_label(F.col(label), mapping)).drop(label)
    return table.withColumnRenamed("_label", into).na.drop(subset=[into])


def coerce_numbers(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Text features to double, unreadable text to null."""
    return df.withColumns({f: S.to_number(F.col(f"`{f}`")) for f in features})


def drop_bad_rows(df: DataFrame, features: Iterable[str], others: Iterable[str] = ()) -> DataFrame:
    """Drop rows with a missing or infinite feature, or a missing value in ``others``.

    Works on raw text; text that is no number is kept here and settled by
    :func:`zero_bad`.
    """
    bad = F.lit(False)
    for f in features:
        bad = bad | S.missing_text(F.col(f"`{f}`")) | S.infinite_text(F.col(f"`{f}`"))
    for name in others:
        bad = bad | S.missing_text(F.col(f"`{name}`"))
    return df.where(~bad)


def drop_unfinite(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Numeric form of the drop policy: infinities become null, rows with a null go."""
    features = list(features)
    return df.withColumns({f: S.finite(F.col(f"`{f}`")) for f in features}).na.drop("any", subset=features)


def zero_bad(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Null, NaN and infinite features become 0.0."""
    return df.withColumns({f: S.zero_if_bad(F.col(f"`{f}`")) for f in features})


def clean(df: DataFrame, features: Iterable[str], label: str = "Label", into: str = "label",
          mapping: Mapping[str, str] = LABEL_MAP) -> DataFrame:
    """Sampled raw day table -> clean day table."""
    features = list(features)
    table = standardize_labels(df.drop("Timestamp"), label, into, mapping)
    return zero_bad(coerce_numbers(table, features), features)


def require_features(df: DataFrame, features: Iterable[str], day: str = "day") -> DataFrame:
    """``df``, after a look at every day: a feature without any value on a day raises.

    A day file that lacks a column leaves it null in the joint table; without this the
    feature would drop out of that day's drift and means unseen."""
    features = list(features)
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"features {absent} are in no day")
    counted = df.groupBy(day).agg(*[F.count(F.col(f"`{f}`")).alias(f"n{i}") for i, f in enumerate(features)])
    empty = F.filter(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(f)) for i, f in enumerate(features)]), lambda f: f.isNotNull())
    bad = counted.select(day, empty.alias("absent")).where(F.size("absent") > 0).orderBy(day).limit(5).collect()
    if bad:
        raise ValueError("features without a value: " + "; ".join(f"day {r[day]}: {r['absent']}" for r in bad))
    return df
