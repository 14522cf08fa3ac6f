"""Results that must not depend on how rows are split, and helper tables of any size."""

import pytest
from pyspark.sql import functions as F

from driftflow import session
from driftflow.operators import drift, scaling, timeline, training
from driftflow.operators import distribution as D


@pytest.mark.parametrize("parts", [1, 3, 4, 7, 8])
def test_constant_features_go_however_rows_are_split(spark, parts):
    table = spark.range(1000).select(
        *[F.lit(x).alias(n) for n, x in (("a", 7.5), ("b", 0.1), ("c", 3.0))], (F.col("id") % 2).alias("d"),
        F.lit(None).cast("double").alias("e"), F.when(F.col("id") == 5, 4.0).alias("single")).repartition(parts)
    kept = scaling.fit_scaler(table, ["a", "b", "c", "d", "e", "single"]).collect()
    assert [(r["ord"], r["feature"]) for r in kept] == [(3, "d"), (5, "single")]


def test_more_features_than_one_aggregate_takes(spark):
    names = [f"f{i}" for i in range(230)]
    table = spark.range(4).select(*[(F.col("id") * i).cast("double").alias(n) for i, n in enumerate(names)])
    fits = {r["feature"]: (r["ord"], r["min"], r["max"]) for r in scaling.fit_scaler(table, names).collect()}
    assert fits == {n: (i, 0.0, 3.0 * i) for i, n in enumerate(names) if i}
    assert scaling.fit_scaler(table, []).count() == 0


def test_a_long_calendar(spark):
    rows = [(d, f"l{d % 2}") for d in range(2000) for _ in range(2)]
    table = spark.createDataFrame(rows + [(None, "l0")], "day int, label string")
    days = timeline.timeline_of(table)
    assert days.count() == 2000
    with pytest.raises(ValueError):
        timeline.timeline_of(table, most=1999)
    anchor = table.where("day % 10 = 0 AND label = 'l0'")
    got = {r["test_ord"]: r for r in training.pool_counts(table, anchor, days).collect()}
    assert len(got) == 1997
    last = got[2000]
    assert (last["window_rows"], last["test_rows"], last["anchor_rows"]) == (6, 2, 2 * 200)
    assert (got[4]["window_rows"], got[4]["anchor_rows"], got[5]["anchor_rows"]) == (6, 0, 2)


def test_helper_tables_beyond_the_limit_are_joined_without_a_hint(spark, monkeypatch):
    table = spark.range(600).select((F.col("id") % 6).cast("int").alias("day"), (F.col("id") * 7 % 101).cast("double").alias("x"),
                                    (F.col("id") % 13).cast("double").alias("y"))
    days = timeline.timeline_of(table)

    def measured():
        pairs = timeline.window_pairs(days)
        found = drift.feature_drift(table, ["x", "y"], pairs, closed=True, rows_per_bucket=40)
        return sorted((r["cmp"], r["feature"], round(r["psi"], 9), round(r["wasserstein"], 9)) for r in found.collect())

    want = measured()
    small = session.small_table
    for module in (timeline, drift, D):
        monkeypatch.setattr(module, "small_table", lambda df: small(df, limit_mb=0))
    assert measured() == want


def test_small_tables_are_told_by_their_size(spark):
    hinted = session.small_table(spark.range(5))
    assert "ResolvedHint" in hinted._jdf.queryExecution().analyzed().toString()
    big = session.small_table(spark.range(5), limit_mb=0)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString() and big.count() == 5


def test_few_parts_are_dealt_out_and_many_left(spark):
    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(3)
    assert session.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(many) is many
    wide = spark.range(0, 100, 1, 50)
    assert session.spread(wide) is wide
