"""Training and test sets of the static and the adaptive run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.functions import scalars as S
from driftflow.operators.sampling import SEED, sample_fraction
from driftflow.operators.scaling import MinMax
from driftflow.operators.timeline import WINDOW

BENIGN = "Benign"
ANCHOR_FRACTION = 0.05


def binary_target(df: DataFrame, label: str = "label", benign: str = BENIGN, into: str = "target") -> DataFrame:
    """0 for benign, 1 for everything else, null included."""
    return df.withColumn(into, S.is_attack(F.col(label), benign))


def model_rows(df: DataFrame, scaler: MinMax, benign: str = BENIGN, keep: Sequence[str] = ("day",),
               single: bool = False) -> DataFrame:
    """Kept columns, scaled features and ``target``. ``single`` narrows to 32-bit floats."""
    table = binary_target(scaler.scale(df), benign=benign)
    kind = "float" if single else "double"
    return table.select(*keep, *[F.col(f"`{f}`").cast(kind).alias(f) for f in scaler.features], "target")


def static_sets(clean: DataFrame, balanced: DataFrame, days: DataFrame, scaler: MinMax,
                benign: str = BENIGN) -> tuple[DataFrame, DataFrame]:
    """Training rows (balanced baseline days) and test rows (clean future days)."""
    roles = F.broadcast(days.select("day", "role"))
    train = balanced.join(roles.where("role = 'baseline'").drop("role"), "day", "left_semi")
    test = clean.join(roles.where("role = 'future'").drop("role"), "day", "left_semi")
    return model_rows(train, scaler, benign), model_rows(test, scaler, benign)


def history_anchor(balanced: DataFrame, key: Column, fraction: float = ANCHOR_FRACTION,
                   seed: int = SEED) -> DataFrame:
    """Exact fraction per day and label. Which of it a test day may see is decided by
    :func:`training_pool`; nothing is appended, so a second run changes nothing."""
    return sample_fraction(balanced, fraction, ["day", "label"], key, seed)


def training_pool(balanced: DataFrame, anchor: DataFrame, days: DataFrame, test_ord: int,
                  k: int = WINDOW) -> DataFrame:
    """Rows a model for ``test_ord`` trains on: the k balanced days before it, and the
    anchor rows of every day that left the window earlier. Tagged by ``src``."""
    numbered = F.broadcast(days.select("day", "ord"))
    window = balanced.join(numbered, "day").where(F.col("ord").between(test_ord - k, test_ord - 1))
    past = anchor.join(numbered, "day").where(F.col("ord") <= test_ord - k - 1)
    return (
        window.withColumn("src", F.lit("window"))
        .unionByName(past.withColumn("src", F.lit("anchor"))).drop("ord")
    )


def pool_counts(balanced: DataFrame, anchor: DataFrame, days: DataFrame, clean: DataFrame | None = None,
                k: int = WINDOW) -> DataFrame:
    """``(test_ord, test_day, window_rows, anchor_rows, total_rows, test_rows)``.

    Rows are counted per day; the sums run over the calendar, a row for each day.
    """
    sizes = _day_sizes(balanced, "window").unionByName(_day_sizes(anchor, "anchor")).unionByName(
        _day_sizes(balanced if clean is None else clean, "test"))
    daily = days.join(sizes, "day", "left").groupBy("ord", "day", "role").agg(*[
        F.coalesce(F.sum(F.when(F.col("src") == src, F.col("n"))), F.lit(0)).alias(src)
        for src in ("window", "anchor", "test")])
    calendar = W.orderBy("ord")
    window = F.coalesce(F.sum("window").over(calendar.rangeBetween(-k, -1)), F.lit(0))
    past = F.coalesce(F.sum("anchor").over(calendar.rangeBetween(W.unboundedPreceding, -k - 1)), F.lit(0))
    return daily.withColumns({"window_rows": window, "anchor_rows": past}).where("role = 'future'").select(
        F.col("ord").alias("test_ord"), F.col("day").alias("test_day"), "window_rows", "anchor_rows",
        (F.col("window_rows") + F.col("anchor_rows")).alias("total_rows"), F.col("test").alias("test_rows"))


def _day_sizes(df: DataFrame, src: str) -> DataFrame:
    return df.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("src", F.lit(src))
