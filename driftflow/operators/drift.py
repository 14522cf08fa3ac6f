"""Drift of each feature between a base and a test set of days.

``pairs`` says who is compared: ``(cmp, day, side)`` with side ``base`` or ``test``
(:func:`timeline.baseline_pairs`, :func:`timeline.window_pairs`). It has a few rows
per day and is broadcast when it is small.

Tables are in the long form of :mod:`distribution`, melted or counted. ``cuts`` are the cut
points of :func:`distribution.value_cuts` and ``daily`` the counts of
:func:`distribution.bucket_counts`. They are looked up when not given; pass them to several
measures of the same table to look them up once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from driftflow.operators import distribution as D
from driftflow.session import settle, small_table, spread

BINS = 10
EMPTY_SHARE = 1e-4
SIDES = ("base", "test")
# Days and comparisons whose running counts stand side by side in one row; longer calendars get rows for each.
MOST_COLUMNS = 32


def _psi(binned: DataFrame, bins: int) -> DataFrame:
    """``(cmp, side, feature, bin, n)`` to ``(cmp, feature, psi)``.

    Values without a bin (null) count in the denominators only. A share of zero is
    replaced by 1e-4. A comparison with an empty side is left out.
    """
    sums = [f"sum(if(side = '{side}', n, 0)) AS {side}_all" for side in SIDES]
    sums += [f"sum(if(side = '{side}' AND bin = {i}, n, 0)) AS {side}_{i}" for side in SIDES for i in range(bins)]
    shares = [f"if({side}_{i} = 0, {EMPTY_SHARE}D, {side}_{i} / {side}_all) AS {side}_{i}"
              for side in SIDES for i in range(bins)]
    terms = [f"(test_{i} - base_{i}) * ln(test_{i} / base_{i})" for i in range(bins)]
    return (
        binned.groupBy("cmp", "feature").agg(*map(F.expr, sums)).where("base_all > 0 AND test_all > 0")
        .selectExpr("cmp", "feature", *shares)
        .selectExpr("cmp", "feature", " + ".join(["0D", *terms]) + " AS psi")
    )


def open_psi_edges(counts: DataFrame, pairs: DataFrame, bins: int = BINS, cuts: D.Cuts | None = None,
                   daily: DataFrame | None = None) -> DataFrame:
    """Edges per feature from the rows of all base days together."""
    base_days = small_table(pairs.where("side = 'base'").select("day").distinct())
    percentiles = D.quantile_edges(counts, bins, cuts=cuts, groups=base_days, daily=daily)
    return percentiles.withColumn("edges", D.open_edges(F.col("edges")))


def psi_open(counts: DataFrame, pairs: DataFrame, bins: int = BINS, cuts: D.Cuts | None = None,
             daily: DataFrame | None = None) -> DataFrame:
    """PSI with open-ended bins; all comparisons share one base.

    Values are binned and summed where they lie; only the sums move.
    """
    edges = open_psi_edges(counts, pairs, bins, cuts, daily)
    found = D.with_bin(counts, edges, bins).groupBy("day", "feature", "bin").agg(F.sum("n").alias("n"))
    return _psi(found.join(pairs, "day"), bins)


def window_psi_edges(counts: DataFrame, pairs: DataFrame, bins: int = BINS, cuts: D.Cuts | None = None,
                     daily: DataFrame | None = None) -> DataFrame:
    """Edges per comparison and feature from the rows of that comparison's base days."""
    base = pairs.where("side = 'base'").select("day", "cmp")
    percentiles = D.quantile_edges(counts, bins, by=["cmp"], cuts=cuts, groups=base, daily=daily)
    return percentiles.withColumn("edges", D.window_edges(F.col("edges")))


def psi_window(counts: DataFrame, pairs: DataFrame, bins: int = BINS, cuts: D.Cuts | None = None,
               daily: DataFrame | None = None) -> DataFrame:
    """PSI with closed bins and a base of its own for every comparison.

    Values are counted by day between the edges of all comparisons; a comparison's bins are sums of these.
    """
    edges = small_table(window_psi_edges(counts, pairs, bins, cuts, daily))
    parts = D.point_counts(counts, edges).join(pairs, "day").join(edges, ["cmp", "feature"])
    inner = "size(filter(slice(edges, 2, greatest(size(edges) - 2, 0)), e -> e <= at))"
    high = "get(edges, size(edges) - 1)"
    out = f"size(edges) >= 2 AND (at IS NULL OR at < get(edges, 0) OR at > {high} OR (at = {high} AND NOT on))"
    binned = parts.withColumn("bin", F.expr(f"IF({out}, NULL, coalesce({inner}, 0))"))
    return _psi(binned.groupBy("cmp", "side", "feature", "bin").agg(F.sum("n").alias("n")), bins)


def wasserstein(counts: DataFrame, pairs: DataFrame, cuts: D.Cuts | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Wasserstein-1 distance ``(cmp, feature, wasserstein)``: the area between the two
    empirical distribution functions.

    Values are laid out by (feature, bucket) in one shuffle. With cut points every bucket
    integrates its own range: it opens at its lower cut point with the number of rows below
    it and closes at its upper one, both from the counts per bucket and added as rows of the
    day tables, so no bucket waits for another. A bucket of one value opens with its own rows
    too, and these stay where they are. They are sorted once: a row has the running counts of all
    days side by side, from which all comparisons follow. On a calendar of more than
    ``MOST_COLUMNS`` days, rows are repeated for the comparisons they serve, after the shuffle.
    """
    cuts = D.value_cuts(counts) if cuts is None else cuts
    sides = {side: F.when(F.col("side") == side, F.col("n")).otherwise(0) for side in SIDES}
    if not cuts:
        rows = counts.join(pairs, "day")
        whole = W.partitionBy("cmp", "feature")
        rows = rows.withColumns({f"{side}_all": F.sum(n).over(whole) for side, n in sides.items()})
        group = ["cmp", "feature"]
    else:
        daily = D.bucket_counts(counts, cuts) if daily is None else daily
        ends = _bucket_ends(daily, D.cuts_table(counts.sparkSession, cuts))
        moved = D.with_bucket(counts, cuts).where("NOT single").select("day", "feature", "bucket", "value", "n")
        compared = pairs.where("day IS NOT NULL AND cmp IS NOT NULL").limit(MOST_COLUMNS * MOST_COLUMNS + 1).collect()
        if max(len(compared) // MOST_COLUMNS, *(len({r[c] for r in compared}) for c in ("day", "cmp"))) <= MOST_COLUMNS:
            return _areas_side_by_side(moved.unionByName(ends), daily, pairs, compared)
        rows = moved.unionByName(ends).repartition("feature", "bucket").join(
            small_table(_side_sizes(daily, pairs)), ["day", "feature"])
        group = ["cmp", "feature", "bucket"]
    place = W.partitionBy(*group).orderBy("value")
    so_far = place.rowsBetween(W.unboundedPreceding, W.currentRow)
    base, test = (F.sum(n).over(so_far) / F.col(f"{side}_all") for side, n in sides.items())
    gap = F.coalesce(F.lead("value").over(place) - F.col("value"), F.lit(0.0))
    return (
        rows.where("base_all > 0 AND test_all > 0")
        .select("cmp", "feature", (F.abs(base - test) * gap).alias("area"))
        .groupBy("cmp", "feature").agg(F.sum("area").alias("wasserstein"))
    )


def _areas_side_by_side(rows: DataFrame, daily: DataFrame, pairs: DataFrame, compared: Sequence[Row]) -> DataFrame:
    """``(cmp, feature, wasserstein)`` from ``(day, feature, bucket, value, n)``, every row shuffled and sorted once.

    ``compared`` are the rows of ``pairs``. A comparison with an empty side is left out."""
    days = sorted({r["day"] for r in compared})
    names = sorted({r["cmp"] for r in compared})
    if not names:
        return rows.join(pairs, "day").select("cmp", "feature", F.lit(0.0).alias("wasserstein")).limit(0)
    members = {side: [[days.index(r["day"]) for r in compared if (r["cmp"], r["side"]) == (c, side)] for c in names] for side in SIDES}

    def total(columns: Sequence[Column]) -> Column:
        return reduce(Column.__add__, columns, F.lit(0).cast("bigint"))

    known = F.array(*[F.lit(d) for d in days])
    kind = pairs.schema["day"].dataType
    at = F.array_position(known.cast(ArrayType(kind)), F.col("day")).cast("int") - 1
    sizes = daily.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(at == i, F.col("n"))), F.lit(0)).alias(f"_{i}") for i in range(len(days))])
    sizes = small_table(sizes.select("feature", *[
        F.nullif(total([F.col(f"_{i}") for i in members[side][c]]), F.lit(0)).alias(f"_{side}{c}")
        for side in SIDES for c in range(len(names))]))
    laid = rows.select("feature", "bucket", "value", "n", at.alias("_day")).where("_day >= 0").repartition("feature", "bucket")
    place = W.partitionBy("bucket", "feature").orderBy("value")
    so_far = place.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = laid.select(
        "feature", "bucket", F.coalesce(F.lead("value").over(place) - F.col("value"), F.lit(0.0)).alias("_gap"),
        *[F.sum(F.when(F.col("_day") == i, F.col("n")).otherwise(0)).over(so_far).alias(f"_{i}") for i in range(len(days))])

    def share(side: str, c: int) -> Column:
        return total([F.col(f"_{i}") for i in members[side][c]]) / F.col(f"_{side}{c}")

    areas = [F.sum(F.abs(share("base", c) - share("test", c)) * F.col("_gap")) for c in range(len(names))]
    found = running.join(sizes, "feature").groupBy("feature", "bucket").agg(*[a.alias(f"_{c}") for c, a in enumerate(areas)])
    each = F.inline(F.array(*[F.struct(F.lit(name).cast(pairs.schema["cmp"].dataType).alias("cmp"), F.col(f"_{c}").alias("area"))
                              for c, name in enumerate(names)]))
    return (
        found.select("feature", each).where("area IS NOT NULL")
        .groupBy("cmp", "feature").agg(F.sum("area").alias("wasserstein"))
    )


def _side_sizes(daily: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs times features with the number of rows on either side."""
    whole = W.partitionBy("cmp", "feature")
    sizes = {f"{side}_all": F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).over(whole)
             for side in SIDES}
    totals = daily.groupBy("day", "feature").agg(F.sum("n").alias("n"))
    return totals.join(pairs, "day").withColumns(sizes).drop("n")


def _bucket_ends(daily: DataFrame, cuts: DataFrame) -> DataFrame:
    """Opening and closing rows ``(day, feature, bucket, value, n)`` of every bucket.

    The cut points are laid out one a row before anything is shuffled, so a row has a fixed width and the
    rows are days times features times buckets."""
    ranges = cuts.select("feature", "cuts", F.posexplode("single").alias("bucket", "_single")).select(
        "feature", "bucket", "_single", F.get("cuts", F.col("bucket") - 1).alias("_low"), F.get("cuts", F.col("bucket")).alias("_high"))
    held = (
        daily.select("day", "feature").distinct().join(small_table(ranges), "feature")
        .join(daily.groupBy("day", "feature", "bucket").agg(F.sum("n").alias("_n")), ["day", "feature", "bucket"], "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
    )
    through = F.sum("_n").over(W.partitionBy("day", "feature").orderBy("bucket"))
    ends = held.withColumn("_before", through - F.when(F.col("_single"), 0).otherwise(F.col("_n")))
    opening = F.struct(F.col("_low").alias("value"), F.col("_before").alias("n"))
    closing = F.struct(F.col("_high").alias("value"), F.lit(0).cast("bigint").alias("n"))
    return ends.select("day", "feature", "bucket", F.inline(F.array(opening, closing))).where("value IS NOT NULL")


def feature_drift(df: DataFrame, features: Sequence[str], pairs: DataFrame, closed: bool = False,
                  bins: int = BINS, rows_per_bucket: int = D.ROWS_PER_BUCKET) -> DataFrame:
    """``(cmp, feature, psi, wasserstein)`` for all comparisons and features.

    ``closed`` takes the window form of PSI with a base per comparison. The features are
    written once, as they are, for the passes that follow; they are melted on the way, and of
    the values only those that few rows share are shuffled, once.
    """
    features = list(features)
    wide = settle(spread(df.select("day", *[F.col(f"`{f}`") for f in features])), "features")
    return drift_of_counts(D.melt(wide, features), pairs, closed, bins, rows_per_bucket)


def drift_of_counts(counts: DataFrame, pairs: DataFrame, closed: bool = False, bins: int = BINS,
                    rows_per_bucket: int = D.ROWS_PER_BUCKET) -> DataFrame:
    cuts = D.value_cuts(counts, rows_per_bucket)
    daily = D.bucket_counts(counts, cuts) if cuts else None
    psi = (psi_window if closed else psi_open)(counts, pairs, bins, cuts, daily)
    return psi.join(wasserstein(counts, pairs, cuts, daily), ["cmp", "feature"])


def mean_drift(drift: DataFrame) -> DataFrame:
    """``(day, mean_psi, mean_wd)``: the mean over the features of each comparison."""
    return drift.groupBy(F.col("cmp").alias("day")).agg(
        F.avg("psi").alias("mean_psi"), F.avg("wasserstein").alias("mean_wd"))
