"""Raw day files to clean day tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.operators import cleaning, sampling
from driftflow.session import discard, fresh_path, settle
from driftflow.sources import days as D
from driftflow.sources.ledger import DayLedger

TARGET_ROWS = 200_000

# The share of rows taken from each chunk of a day, and the one exception.
FRACTION = 0.30
FRACTIONS = {"feb20": 0.15}


def day_fraction(day: Column, fractions: Mapping[str, float] | None = None, default: float = FRACTION) -> Column:
    result = F.lit(default)
    for name, part in (FRACTIONS if fractions is None else fractions).items():
        result = F.when(day == F.lit(name), F.lit(part)).otherwise(result)
    return result


def sample_days(raw: DataFrame, key: Column, target_rows: int | None = TARGET_ROWS,
                fraction: Column | float | None = FRACTION, without: Iterable[str] = ("day", "chunk"),
                label: str = "Label") -> DataFrame:
    """Exact fraction of each ``(day, chunk)``, rows with missing or infinite values
    dropped, then exactly ``target_rows`` rows of each day (copies where it has fewer).
    Either step takes all rows when its parameter is None."""
    features = cleaning.feature_names(raw, [*without, label, "Timestamp"])
    others = [c for c in ("Timestamp", label) if c in raw.columns]
    chosen = raw
    if fraction is not None:
        part = fraction if isinstance(fraction, Column) else F.lit(fraction)
        chosen = sampling.take_per_group(
            raw.withColumn("_part", part), ["day", "chunk", "_part"], key,
            lambda n: F.bround(F.col("_part") * n, 0)).drop("_part")
    usable = cleaning.drop_bad_rows(chosen.drop("chunk"), features, others)
    if target_rows is None:
        return usable
    # Written once: the second sample takes several passes, over the part that is left.
    return sampling.sample_rows(settle(usable, "sampled"), target_rows, ["day"], key)


def ingest_days(spark: SparkSession, files: Mapping[str, str], out: str, target_rows: int | None = TARGET_ROWS,
                fractions: Mapping[str, float] | None = None, default_fraction: float | None = FRACTION) -> DataFrame:
    """Every day of ``files`` that the ledger of ``{out}/clean`` does not name yet is sampled, cleaned and added.

    Days with the same columns go through one plan and are committed together; days are done once their entry
    is in the ledger, whether rows of them are left or not, and a run that dies before loads them again. Raw
    rows are written with a number for as long as that takes: written numbers are the same on every read, so
    the samples drawn by them are too. Since a small day holds copies, the clean rows are numbered anew, from
    the last number in use on. With ``target_rows`` and ``default_fraction`` None and no ``fractions`` all
    rows are kept.
    """
    ledger = DayLedger(spark, f"{out}/clean")
    done = ledger.days()
    todo = {day: file for day, file in files.items() if day not in done}
    try:
        groups = D.day_groups(spark, todo, chunked=True) if todo else []
    except FileNotFoundError:
        if not done:
            raise
        groups = []
    whole = default_fraction is None and fractions is not None and not fractions
    for days, group in groups:
        rows = fresh_path(spark, "raw")
        D.with_row_id(group).write.parquet(rows)
        raw = spark.read.schema(D.with_row_id(group).schema).parquet(rows)
        default = 1.0 if default_fraction is None else default_fraction
        part = None if whole else day_fraction(F.col("day"), fractions, default)
        sampled = sample_days(raw, F.col("row_id"), target_rows, part, without=("day", "chunk", "row_id"))
        features = cleaning.feature_names(sampled, ["day", "row_id", "Label", "Timestamp"])
        table = cleaning.clean(sampled.drop("row_id"), features)
        numbered = D.with_row_id(table).withColumn("row_id", F.col("row_id") + F.lit(ledger.last_row_id()) + 1)
        ledger.append(numbered, days)
        discard(spark, rows)
    return ledger.read()
