"""Value distributions of many features at once, in long form.

Long form is one row per value, ``(day, feature, value, n)``: every row for itself with
n = 1 (:func:`melt`), or equal values of a day counted (:func:`value_counts`). All features
and days go through one plan, and a melted table is never shuffled as a whole just to be
counted: it is laid over a grid of cut points where it lies, and only the counts move.

A grid has the quantiles of a mergeable sketch, which is built map-side, and every value that
many rows share with its next double, so that such a value has a range of its own and its
rows are known by their number. Cut points steer the work, never the result, and they are
fixed before the plan runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.session import local_table, settle, small_table

ROWS_PER_BUCKET = 50_000
# Quantiles a grid is made from, at least: a value that more than 2 in so many rows share is told apart.
QUANTILES = 256
SAMPLE_PER_BUCKET = 200
# Ranges of a feature, at most. Cut points are part of plans and sent to all tasks, so their number has a bound
# whatever the rows; a range of a longer table holds more of them, which are sorted with spilling.
MOST_RANGES = 1_024

# Ascending cut points per feature.
Cuts = dict[str, list[float]]


def melt(df: DataFrame, features: Iterable[str], keep: Sequence[str] = ("day",)) -> DataFrame:
    """Wide to long: kept columns, ``feature``, ``value``, ``n`` = 1; null values go."""
    features = list(features)
    wide = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    long = wide.unpivot(list(keep), [F.col(f"`{f}`") for f in features], "feature", "value")
    return long.where(F.col("value").isNotNull()).withColumn("n", F.lit(1).cast("bigint"))


def value_counts(long: DataFrame) -> DataFrame:
    """Equal values of a day counted."""
    return long.groupBy("day", "feature", "value").agg(F.sum("n").alias("n"))


def value_cuts(long: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = 42) -> Cuts:
    """Cut points that split each feature into ``QUANTILES`` ranges, or as many more (up to ``MOST_RANGES``) as it
    takes for about ``rows_per_bucket`` rows in each, and give every value that many rows share a range of its
    own. A feature with no more rows than that has none.

    One pass counts the rows and takes ``QUANTILES`` quantiles, from sketches that are merged from those of all
    tasks. Only features that need more ranges than that are looked at again, for as many quantiles as they
    have ranges, in a sample of ``SAMPLE_PER_BUCKET`` values for each."""
    first = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx("value", _shares(QUANTILES), 4 * QUANTILES).alias("at")).collect()
    rows = {r["feature"]: r["rows"] for r in first}
    buckets = {f: min(math.ceil(n / rows_per_bucket), MOST_RANGES) for f, n in rows.items() if n > rows_per_bucket}
    quantiles = {r["feature"]: r["at"] for r in first}
    finest = max(buckets.values(), default=0)
    if finest > QUANTILES:
        fractions = {f: min(1.0, SAMPLE_PER_BUCKET * finest / rows[f]) for f, k in buckets.items() if k > QUANTILES}
        finer = long.sampleBy("feature", fractions, seed).groupBy("feature").agg(
            F.percentile_approx("value", _shares(finest), 10 * finest).alias("at"))
        quantiles |= {r["feature"]: r["at"] for r in finer.collect()}
    return {f: _grid(quantiles[f]) for f in buckets}


def _shares(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _grid(quantiles: list[float]) -> list[float]:
    """The quantiles, and with each value that two of them agree on the next double."""
    shared = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    return sorted({*quantiles, *(math.nextafter(v, math.inf) for v in shared)})


def cuts_table(spark: SparkSession, cuts: Cuts) -> DataFrame:
    """``feature, cuts, single, shared``: whether a bucket holds one value only, for buckets 0 to the number of
    cuts, and the values of those."""
    rows = []
    for feature, points in cuts.items():
        single = [False, *(math.nextafter(a, math.inf) == b for a, b in zip(points, points[1:])), False]
        rows.append((feature, points, single, [v for v, x in zip(points, single[1:]) if x]))
    schema = pa.schema([("feature", pa.string()), ("cuts", pa.list_(pa.float64())), ("single", pa.list_(pa.bool_())),
                        ("shared", pa.list_(pa.float64()))])
    return F.broadcast(local_table(spark, rows, schema))


def with_place(table: DataFrame, points: str, most: int, into: str) -> DataFrame:
    """Add ``into``: how many of the ascending ``points`` (an array of at most ``most``) are at or below ``value``.

    Halves the array in one column after the other, so it takes log2 steps however many points there are. A
    filter by the new column would be pushed below them and repeat them all; filter by something else."""
    step = 1 << max(most, 1).bit_length() - 1
    table = table.withColumn(into, F.lit(0))
    while step:
        table = table.withColumn(into, F.expr(
            f"IF(get(`{points}`, `{into}` + {step - 1}) <= value, `{into}` + {step}, `{into}`)"))
        step //= 2
    return table


def with_bucket(long: DataFrame, cuts: Cuts) -> DataFrame:
    """Add ``bucket``, the number of cut points at or below the value, and ``single``: whether that bucket has
    one value only."""
    if not cuts:
        return long.withColumns({"bucket": F.lit(0), "single": F.lit(False)})
    lookup = cuts_table(long.sparkSession, cuts).select("feature", F.col("cuts").alias("_cuts"), F.col("shared").alias("_shared"))
    placed = with_place(long.join(F.broadcast(lookup), "feature", "left"), "_cuts", max(map(len, cuts.values())), "bucket")
    # Told from the value, not from the bucket: a filter by it then takes none of the steps above with it.
    single = F.coalesce(F.array_contains("_shared", F.col("value")), F.lit(False))
    return placed.withColumn("single", single).drop("_cuts", "_shared")


def bucket_counts(long: DataFrame, cuts: Cuts) -> DataFrame:
    """``(day, feature, bucket, single, n)``, run once: days times features times buckets, whatever the rows."""
    counts = with_bucket(long, cuts).groupBy("day", "feature", "bucket", "single").agg(F.sum("n").alias("n"))
    return settle(counts, "bucket-counts")


def quantile_edges(counts: DataFrame, bins: int = 10, by: Sequence[str] = (), cuts: Cuts | None = None,
                   groups: DataFrame | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Exact percentiles 0, 100/bins, ..., 100 with linear interpolation, as the array
    ``edges``, one row per ``(by, feature)``.

    ``groups`` (``day`` and the columns of ``by``) tells which groups a day belongs to; without it ``by``
    are columns of ``counts``. Percentile k needs the values of ranks floor(k (n-1) / bins) and the next one.
    With cut points, a count per bucket (``daily``, of :func:`bucket_counts`) tells which of them hold such a
    rank; only the values in those (at most two per percentile) are shuffled and ranked, once for a day.
    Ranks are found with integer arithmetic, so the result does not depend on rounding.
    """
    group = [*by, "feature"]
    cuts = value_cuts(counts) if cuts is None else cuts
    if cuts:
        ranked = _ranked_in_buckets(counts, group, bins, cuts, groups, daily)
    else:
        values = (counts if groups is None else counts.join(groups, "day")).groupBy(*group, "value").agg(F.sum("n").alias("n"))
        ranked = values.withColumns({
            "through": F.sum("n").over(W.partitionBy(*group).orderBy("value")),
            "total": F.sum("n").over(W.partitionBy(*group))})
    found = (
        _holding_ranks(ranked, bins)
        .withColumn("rank", F.explode(F.filter(
            _wanted_ranks(bins), lambda r: (r >= F.col("through") - F.col("n")) & (r < F.col("through")))))
        .groupBy(*group)
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"),
             F.first("total").alias("total"))
    )
    edges = (
        f"transform(sequence(0L, {bins}L), k -> at[(k * (total - 1)) div {bins}] + "
        f"(at[(k * (total - 1) + {bins - 1}) div {bins}] - at[(k * (total - 1)) div {bins}]) "
        f"* (((k * (total - 1)) % {bins}) / {bins}D))")
    return found.select(*group, F.expr(edges).alias("edges"))


def _wanted_ranks(bins: int) -> Column:
    """0-based ranks the percentiles of ``total`` values need."""
    return F.expr(
        f"array_distinct(flatten(transform(sequence(0L, {bins}L), "
        f"k -> array((k * (total - 1)) div {bins}, (k * (total - 1) + {bins - 1}) div {bins}))))")


def _holding_ranks(spans: DataFrame, bins: int) -> DataFrame:
    """Keep spans of ranks ``[through - n, through)`` of ``total`` that hold a wanted rank.

    Checks the first k whose lower (or upper) rank is not before the span.
    """
    low_k = f"((through - n) * {bins} + greatest(total - 1, 1) - 1) div greatest(total - 1, 1)"
    high_k = f"CASE WHEN through = n THEN 0L ELSE ((through - n - 1) * {bins}) div greatest(total - 1, 1) + 1 END"
    return spans.withColumns({"_low": F.expr(low_k), "_high": F.expr(high_k)}).where(
        f"(_low <= {bins} AND (_low * (total - 1)) div {bins} < through) OR "
        f"(_high <= {bins} AND (_high * (total - 1) + {bins - 1}) div {bins} < through)").drop("_low", "_high")


def _ranked_in_buckets(counts: DataFrame, group: list[str], bins: int, cuts: Cuts, groups: DataFrame | None,
                       daily: DataFrame | None) -> DataFrame:
    place = W.partitionBy(*group).orderBy("bucket")
    placed = with_bucket(counts, cuts).drop("single")
    if groups is None:
        sums, days = placed, []
    else:
        sums, days = (daily if daily is not None else bucket_counts(counts, cuts)).join(groups, "day"), ["day"]
    spans = sums.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).withColumns({
        "through": F.sum("n").over(place), "total": F.sum("n").over(W.partitionBy(*group))})
    # At most 2 (bins + 1) buckets per group, and a row per group: comparisons x features.
    needed = small_table(_holding_ranks(spans, bins).select(
        *group, "bucket", "total", (F.col("through") - F.col("n")).alias("before")))
    if groups is None:
        values = placed.join(needed, [*group, "bucket"])
    else:
        # Once for a day, then for each group the day is in.
        some = small_table(needed.select("feature", "bucket").distinct())
        values = placed.join(small_table(groups.select("day").distinct()), "day", "left_semi").join(some, ["feature", "bucket"])
        values = values.groupBy(*days, "feature", "bucket", "value").agg(F.sum("n").alias("n"))
        values = values.join(groups, "day").join(needed, [*group, "bucket"])
    values = values.groupBy(*group, "bucket", "before", "total", "value").agg(F.sum("n").alias("n"))
    inside = F.sum("n").over(W.partitionBy(*group, "bucket").orderBy("value"))
    return values.withColumn("through", F.col("before") + inside)


def open_edges(percentiles: Column) -> Column:
    """Distinct edges. The outer two stand for minus and plus infinity."""
    return F.array_distinct(percentiles)


WINDOW_MARGIN = 1e-5


def window_edges(percentiles: Column) -> Column:
    """Edges whose ends are moved out by a margin, then made distinct. Values beyond
    the ends fall in no bin."""
    last = F.size(percentiles)
    return F.array_distinct(F.concat(
        F.array(F.get(percentiles, F.lit(0)) - F.lit(WINDOW_MARGIN)),
        F.slice(percentiles, F.lit(2), last - 2),
        F.array(F.get(percentiles, last - 1) + F.lit(WINDOW_MARGIN))))


def with_bin(counts: DataFrame, edges: DataFrame, bins: int = 10, closed: bool = False,
             on: Sequence[str] = ("feature",)) -> DataFrame:
    """Add ``bin``: bins hold their lower edge, the last one also its upper edge.

    ``closed`` edges leave values beyond the ends without a bin (null). The edge table
    has one row per feature (and comparison); it is run once, and broadcast when it is small.
    """
    lookup = edges.selectExpr(
        *on, "slice(edges, 2, greatest(size(edges) - 2, 0)) AS _inner",
        "if(size(edges) >= 2, get(edges, 0), NULL) AS _low",
        "if(size(edges) >= 2, get(edges, size(edges) - 1), NULL) AS _high")
    table = with_place(counts.join(small_table(lookup), list(on)), "_inner", bins - 1, "bin")
    if closed:
        table = table.withColumn("bin", F.expr("IF(value < _low OR value > _high, NULL, bin)"))
    return table.drop("_inner", "_low", "_high")


def point_counts(long: DataFrame, edges: DataFrame) -> DataFrame:
    """``(day, feature, at, on, n)``: rows whose greatest edge at or below the value is ``at`` (null: below all),
    and whether the value is that edge; over the edges of all comparisons of a feature together.

    Every row is looked up once, however many comparisons its day is in; only the counts move."""
    merged = edges.groupBy("feature").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("edges")))).alias("_points"))
    merged = small_table(merged)
    most = merged.agg(F.max(F.size("_points"))).first()[0] or 0
    placed = with_place(long.join(merged, "feature"), "_points", most, "_place")
    at = F.get("_points", F.col("_place") - 1)
    return placed.groupBy("day", "feature", F.when(F.col("_place") > 0, at).alias("at"),
                          F.coalesce(F.col("value") == at, F.lit(False)).alias("on")).agg(F.sum("n").alias("n"))


def histogram(counts: DataFrame, edges: DataFrame, by: Sequence[str] = (), bins: int = 10,
              closed: bool = False) -> DataFrame:
    """Counts ``(by, feature, bin, n)`` with a row for every bin, empty ones too."""
    cells = F.expr("array(" + ", ".join(f"sum(if(bin = {i}, n, 0))" for i in range(bins)) + ")")
    return (
        with_bin(counts, edges, bins, closed).groupBy(*by, "feature").agg(cells.alias("_cells"))
        .join(edges.select("feature", F.size("edges").alias("_edges")), "feature")
        .withColumn("_cells", F.slice("_cells", F.lit(1), F.greatest(F.col("_edges") - 1, F.lit(1))))
        .select(*by, "feature", F.posexplode("_cells").alias("bin", "n"))
    )
