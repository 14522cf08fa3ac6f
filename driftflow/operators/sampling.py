"""Samples of an exact size that are the same on every run.

Rows are ordered by ``md5(key ':' seed)``, then by the key, and the first ones of
each group are taken. ``key`` has to tell the rows of a group apart.

No group is ever sorted as a whole. The hash spreads a group evenly over buckets, by its
first hex digits. One aggregate counts the buckets, and the counts tell in which of them the
last taken row lies. That bucket is split by its next digits, round by round, until it is
small enough to be ranked (``ROWS_PER_RANK``), so a group of any size takes a few passes, each
over a small part of the one before. The result is a threshold per group; taking the sample
is then a plain filter.

A sample that is a small part of the rows is taken from those alone whose hash is low enough to
be in it, which are written first, so that all keys are made and hashed once. How low follows
from the sizes of the groups. The written rows are counted; should they be too few, all are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.functions import scalars as S
from driftflow.session import settle, small_table

SEED = 42
# Hex digits by which a bucket is split in a round.
DIGITS = 3
# Rows that are ranked in one task; a key that repeats more often than that can't be split.
ROWS_PER_RANK = 100_000
HASH_DIGITS = 32
# Part of all rows up to which a sample is taken from rows of low hashes, and the standard deviations left above it.
SMALL_PART = 1 / 8
SPARE = 8


def _hashed(df: DataFrame, key: Column, seed: int, digits: int | None = None) -> DataFrame:
    table = df.withColumns({"_hash": S.hash_text(key, seed), "_key": key.cast("string")})
    return table.withColumn("_bucket", F.substring("_hash", 1, digits or DIGITS))


def digits_for(rows: int) -> int:
    """Hex digits that spread a group of that many rows over buckets of at most about ``ROWS_PER_RANK``."""
    digits = DIGITS
    while rows > ROWS_PER_RANK << 4 * digits:
        digits += 1
    return digits


def group_sizes(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def _low_hashes(hashed: DataFrame, by: list[str], size: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame] | None:
    """The rows among which a small sample must be, written, and ``(by, _wanted)``; None where it is not small."""
    wanted = size(F.col("_all")).cast("bigint")
    groups = group_sizes(hashed, by, "_all")
    for name in by:
        groups = groups.where(F.col(name).isNotNull())
    groups = groups.withColumn("_wanted", wanted).where("_wanted > 0").withColumn(
        "_rows", F.least(F.col("_all").cast("double"), F.col("_wanted") + SPARE * (F.sqrt("_wanted") + SPARE)))
    groups = small_table(groups)
    all_rows, low_rows = groups.agg(F.sum("_all"), F.sum("_rows")).first()
    if all_rows is None or low_rows > all_rows * SMALL_PART:
        return None
    limit = F.least(F.ceil(F.col("_rows") / F.col("_all") * (1 << 32)), F.lit((1 << 32) - 1).cast("bigint"))
    limits = groups.select(*by, F.lower(F.lpad(F.hex(limit), 8, "0")).alias("_limit"))
    low = hashed.join(limits, by).where(F.substring("_hash", 1, 8) <= F.col("_limit")).drop("_limit")
    low = settle(low, "low-hashes")
    found = groups.join(group_sizes(low, by, "_found"), by, "left")
    if not found.where(F.coalesce("_found", F.lit(0)) < F.least("_wanted", "_all")).isEmpty():
        return None
    return low, groups.select(*by, "_wanted")


def _thresholds(hashed: DataFrame, by: list[str], size: Callable[[Column], Column], sizes: DataFrame | None = None) -> DataFrame:
    """Per group: hash and key of the last row to take. Groups with nothing to take are absent.

    ``sizes``: how many that are, ``(by, _wanted)``, where ``hashed`` is not all rows."""
    rows = hashed.select(*by, "_hash", "_key", "_bucket")
    buckets = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if sizes is None:
        buckets = buckets.withColumn("_wanted", size(F.sum("_n").over(W.partitionBy(*by))).cast("bigint"))
    else:
        buckets = buckets.join(sizes, by)
    last = small_table(_last_bucket(buckets.withColumnsRenamed({"_bucket": "_prefix"}), by))
    digits = DIGITS
    while digits < HASH_DIGITS and not last.where(F.col("_n") > ROWS_PER_RANK).isEmpty():
        digits += DIGITS
        inside = _inside(rows, last.where(F.col("_n") > ROWS_PER_RANK), by)
        split = inside.groupBy(*by, F.substring("_hash", 1, digits).alias("_prefix"), F.col("_room").alias("_wanted")).agg(
            F.count(F.lit(1)).alias("_n"))
        small = last.where(F.col("_n") <= ROWS_PER_RANK).select(*by, "_prefix", "_room", "_n")
        last = small_table(small.unionByName(_last_bucket(split, by)))
    order = W.partitionBy(*by).orderBy("_hash", "_key")
    place = F.struct("_hash", "_key")
    return (
        _inside(rows, last, by)
        .withColumns({"_rank": F.row_number().over(order), "_next": F.lead(place).over(order)})
        .where("_rank = _room")
        .select(*by, place.alias("_last"),
                F.when(place == F.col("_next"),
                       F.raise_error(F.lit("the sampling key does not tell rows apart")))
                .cast("boolean").alias("_tie"))
    )


def _last_bucket(buckets: DataFrame, by: list[str]) -> DataFrame:
    """``(by, _prefix, _room, _n)``: the bucket that holds the last of the ``_wanted`` rows, how many of its rows
    are taken, and how many it has."""
    so_far = W.partitionBy(*by).orderBy("_prefix")
    return (
        buckets.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        .where("_before < _wanted")
        .groupBy(*by)
        .agg(F.max("_prefix").alias("_prefix"), F.max("_before").alias("_before"),
             F.first("_wanted").alias("_wanted"), F.max_by("_n", "_prefix").alias("_n"))
        .select(*by, "_prefix", F.least(F.col("_wanted") - F.col("_before"), F.col("_n")).alias("_room"), "_n")
    )


def _inside(rows: DataFrame, last: DataFrame, by: list[str]) -> DataFrame:
    """Rows of those buckets, whatever their number of digits. They meet by their first digits, so that a join
    that is not broadcast is spread too."""
    first = last.withColumn("_bucket", F.substring("_prefix", 1, DIGITS))
    return rows.join(first, [*by, "_bucket"]).where("startswith(_hash, _prefix)")


def take_per_group(df: DataFrame, by: Sequence[str], key: Column, size: Callable[[Column], Column],
                   seed: int = SEED) -> DataFrame:
    """Per group of ``by`` the first ``size(rows in the group)`` rows in hash order.

    Rows with a null in ``by`` belong to no group and are left out.
    """
    by = list(by)
    hashed = _hashed(df, key, seed)
    low = _low_hashes(hashed, by, size)
    if low is None:
        last = small_table(_thresholds(hashed, by, size))
    else:
        hashed, sizes = low
        last = small_table(_thresholds(hashed, by, size, sizes))
    return (
        hashed.join(last, by)
        .where((F.struct("_hash", "_key") <= F.col("_last")) & F.col("_tie").isNull())
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def sample_fraction(df: DataFrame, fraction: float | Column, by: Sequence[str], key: Column,
                    seed: int = SEED) -> DataFrame:
    """Exactly round-half-even(fraction * n) rows of each group, without replacement."""
    part = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return take_per_group(df, by, key, lambda n: F.bround(part * n, 0), seed)


def sample_rows(df: DataFrame, rows: int, by: Sequence[str], key: Column, seed: int = SEED) -> DataFrame:
    """Exactly ``rows`` rows of each group: without replacement where the group is big
    enough, else with replacement (a group that is too small grows by copies)."""
    whole = take_per_group(df, by, key, lambda n: F.when(n >= rows, F.lit(rows)).otherwise(0), seed)
    return whole.unionByName(sample_with_replacement(df, rows, by, key, seed))


def sample_with_replacement(df: DataFrame, rows: int, by: Sequence[str], key: Column,
                            seed: int = SEED) -> DataFrame:
    """``rows`` draws with replacement from each group that has fewer rows than that."""
    by = list(by)
    sizes = group_sizes(df, by, "_size").where(F.col("_size") < rows)
    short = small_table(with_salts(sizes.withColumn("_wanted", F.lit(rows).cast("bigint")), "_size", "_wanted"))
    pool = salted(number_rows(df.join(short, by), by, key, seed, most=rows))
    drawn = draws(short, by, "_wanted").withColumn(
        "_index", 1 + F.pmod(S.hash_number(*[F.col(c) for c in by], F.col("draw"), seed), F.col("_size")))
    return (
        drawn.select(*by, "_index", salt_of_draw()).join(pool, [*by, "_index", "_salt"])
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def cap_rows(df: DataFrame, rows: int, by: Sequence[str], key: Column, seed: int = SEED) -> DataFrame:
    """At most ``rows`` rows of each group."""
    return take_per_group(df, by, key, lambda n: F.least(n, F.lit(rows)), seed)


def number_rows(df: DataFrame, by: Sequence[str], key: Column, seed: int = SEED,
                into: str = "_index", most: int | None = None) -> DataFrame:
    """Number the rows of each group 1..n in hash order.

    Ranks run inside a hash bucket and start from the number of rows in the buckets
    before it, so a big group is spread over many tasks. ``most`` says how many rows a group
    has at most, where that is known; else they are counted.
    """
    by = list(by)
    if most is None:
        most = group_sizes(df, by, "_size").agg(F.max("_size")).first()[0] or 0
    hashed = _hashed(df, key, seed, digits_for(most))
    buckets = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = buckets.select(
        *by, "_bucket",
        (F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_hash", "_key"))
    return (
        hashed.join(before, [*by, "_bucket"])
        .withColumn(into, (F.col("_before") + rank).cast("bigint"))
        .drop("_hash", "_key", "_bucket", "_before")
    )


DRAW_BLOCK = 10_000
DRAWS_PER_KEY = 100_000


def with_salts(groups: DataFrame, size: str, wanted: str) -> DataFrame:
    """Add ``_salts``, the number of join keys each row of a group gets, so that no key
    is drawn much more often than ``DRAWS_PER_KEY`` times even from a group of one row."""
    return groups.withColumn("_salts", F.greatest(F.lit(1).cast("bigint"), F.ceil(
        F.col(wanted) / (F.col(size) * F.lit(DRAWS_PER_KEY)))))


def salted(pool: DataFrame) -> DataFrame:
    """Every row once per salt of its group: at most one copy per ``DRAWS_PER_KEY`` draws."""
    return pool.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))


def salt_of_draw() -> Column:
    return F.pmod("draw", "_salts").alias("_salt")


def draws(groups: DataFrame, by: Sequence[str], wanted: str) -> DataFrame:
    """One row per draw, numbered 1..``wanted`` in each group.

    Draws are made in blocks that are spread over the cluster before they are
    filled, so one group with very many draws does not sit in one task.
    """
    blocks = (
        groups.where(F.col(wanted) > 0)
        .withColumn("_block", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.expr(f"(`{wanted}` - 1) div {DRAW_BLOCK}"))))
        .repartition(*by, "_block")
    )
    first = F.col("_block") * DRAW_BLOCK + 1
    last = F.least((F.col("_block") + 1) * DRAW_BLOCK, F.col(wanted).cast("bigint"))
    return blocks.withColumn("draw", F.explode(F.sequence(first, last))).drop("_block")
