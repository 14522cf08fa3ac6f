"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that a CSV read treats as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Decimal notation or a spelled infinity / nan. Refuses what Java's parser would
# also take, such as a trailing type letter ("1d").
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"

INFINITY = float("inf")


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def to_number(text: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    bare = strip(text.cast("string"))
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def finite(number: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(INFINITY)), number)


def missing_text(text: Column) -> Column:
    """True for null and for the texts a CSV read treats as missing."""
    return F.coalesce(text.isin(MISSING_TEXTS), F.lit(True))


def infinite_text(text: Column) -> Column:
    """True for text that reads as an infinity."""
    return F.coalesce(F.abs(to_number(text)) == F.lit(INFINITY), F.lit(False))


def zero_if_bad(number: Column) -> Column:
    """Null, NaN and infinities become 0.0."""
    return F.coalesce(finite(number), F.lit(0.0))


def clip(number: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), number))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def grid(bins: int) -> Column:
    """Array 0, 1/bins, ..., 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i / F.lit(float(bins)))


def is_attack(label: Column, benign: str) -> Column:
    """0 for the benign label, 1 for any other one and for null."""
    return F.when(label == F.lit(benign), 0).otherwise(1)


def hash_text(*parts: Column | int | str) -> Column:
    """md5 of the parts joined by ':'; the source of every reproducible draw."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts).cast("binary"))


def hash_number(*parts: Column | int | str) -> Column:
    """Integer in [0, 2**32) from the first 8 hex digits of :func:`hash_text`."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | int | str) -> Column:
    """Double in [0, 1), an exact multiple of 2**-32."""
    return hash_number(*parts) / F.lit(4294967296.0)
