import hashlib

import pytest
from pyspark.sql import functions as F

from driftflow.operators import sampling


def groups(spark, sizes):
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, id int").repartition(7)


def in_hash_order(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), str(i)))


def taken(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r["id"])
    return out


def test_fraction_rounds_half_to_even(spark):
    sizes = {"a": 9, "b": 10, "c": 30, "d": 50, "e": 70}
    got = taken(sampling.sample_fraction(groups(spark, sizes), 0.05, ["g"], F.col("id")))
    assert {g: len(ids) for g, ids in got.items()} == {"c": 2, "d": 2, "e": 4}


def test_takes_the_first_rows_in_hash_order(spark):
    got = taken(sampling.cap_rows(groups(spark, {"a": 500, "b": 20}), 123, ["g"], F.col("id"), seed=5))
    assert sorted(got["a"]) == sorted(in_hash_order(500, 5)[:123])
    assert sorted(got["b"]) == list(range(20))


def test_same_rows_however_partitioned(spark):
    table = groups(spark, {"a": 300, "b": 40})
    once = taken(sampling.sample_fraction(table, 0.3, ["g"], F.col("id")))
    again = taken(sampling.sample_fraction(table.repartition(3, "id"), 0.3, ["g"], F.col("id")))
    assert {g: sorted(x) for g, x in once.items()} == {g: sorted(x) for g, x in again.items()}


def test_exact_rows_with_and_without_replacement(spark):
    got = taken(sampling.sample_rows(groups(spark, {"big": 50, "even": 10, "small": 3}), 10, ["g"], F.col("id")))
    assert sorted(got["big"]) == sorted(in_hash_order(50)[:10])
    assert sorted(got["even"]) == list(range(10))
    order = in_hash_order(3)
    drawn = [order[int(hashlib.md5(f"small:{d}:42".encode()).hexdigest()[:8], 16) % 3] for d in range(1, 11)]
    assert sorted(got["small"]) == sorted(drawn)


def test_numbers_run_through_the_hash_order(spark):
    rows = sampling.number_rows(groups(spark, {"a": 200}), ["g"], F.col("id")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_index"])] == in_hash_order(200)


def test_draws_in_blocks(spark):
    table = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 0)], "g string, wanted bigint")
    rows = sampling.draws(table, ["g"], "wanted").groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.min("draw").alias("a"),
        F.max("draw").alias("b")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 25_001, 25_001, 1, 25_001), ("b", 1, 1, 1, 1)]


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "g string, id int")
    assert taken(sampling.cap_rows(df, 5, ["g"], F.col("id"))) == {"a": [2]}


def test_a_key_that_repeats_is_refused_where_it_matters(spark):
    df = spark.createDataFrame([("a", 1)] * 6, "g string, id int")
    with pytest.raises(Exception, match="tell rows apart"):
        sampling.cap_rows(df, 3, ["g"], F.col("id")).collect()


def test_too_many_groups_to_broadcast(spark, monkeypatch):
    table = groups(spark, {"a": 30, "b": 12, "c": 7})
    want = taken(sampling.sample_fraction(table, 0.5, ["g"], F.col("id")))
    small = sampling.small_table
    monkeypatch.setattr(sampling, "small_table", lambda df: small(df, limit_mb=0))
    got = taken(sampling.sample_fraction(table, 0.5, ["g"], F.col("id")))
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in want.items()}


def test_salts_spread_the_draws_and_change_nothing(spark, monkeypatch):
    table = groups(spark, {"one": 1, "few": 3})
    want = taken(sampling.sample_with_replacement(table, 40, ["g"], F.col("id")))
    monkeypatch.setattr(sampling, "DRAWS_PER_KEY", 2)
    sizes = sampling.group_sizes(table, ["g"]).withColumn("wanted", F.lit(40))
    assert {r["g"]: r["_salts"] for r in sampling.with_salts(sizes, "n", "wanted").collect()} == {"one": 20, "few": 7}
    got = taken(sampling.sample_with_replacement(table, 40, ["g"], F.col("id")))
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in want.items()}


@pytest.mark.parametrize("per_rank", [1, 3, 50])
def test_buckets_are_split_until_they_can_be_ranked(spark, monkeypatch, per_rank):
    """Every number of rounds gives the same rows, for groups of several sizes in one call."""
    monkeypatch.setattr(sampling, "ROWS_PER_RANK", per_rank)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    table = groups(spark, {"a": 900, "b": 40, "c": 1})
    got = taken(sampling.take_per_group(table, ["g"], F.col("id"), lambda n: F.floor(n * 0.4)))
    assert sorted(got["a"]) == sorted(in_hash_order(900)[:360]) and sorted(got["b"]) == sorted(in_hash_order(40)[:16])
    assert "c" not in got
    rows = sampling.number_rows(table.where("g = 'a'"), ["g"], F.col("id")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_index"])] == in_hash_order(900)


def test_digits_follow_the_rows():
    assert [sampling.digits_for(n) for n in (0, 10 ** 6, 10 ** 9, 10 ** 12)] == [3, 3, 4, 6]


def test_a_group_of_many_million_rows(spark, monkeypatch):
    """17 million keys in one group: two rounds, and nothing larger than a bucket is ever ranked."""
    monkeypatch.setattr(sampling, "ROWS_PER_RANK", 1_000)
    table = spark.range(17_000_000).select(F.lit("g").alias("g"), "id")
    hashed = sampling._hashed(table, F.col("id"), 42)
    last = sampling._thresholds(hashed, ["g"], lambda n: F.lit(5_000_000)).first()["_last"]
    assert hashed.where(F.struct("_hash", "_key") <= F.struct(F.lit(last["_hash"]), F.lit(last["_key"]))).count() == 5_000_000


def test_keys_of_a_small_sample_are_hashed_once(spark):
    table = groups(spark, {"a": 20_000, "b": 9_000, None: 5_000}).withColumn("more", F.col("id") + 1)
    for sample in (sampling.cap_rows(table, 400, ["g"], F.col("id"), seed=5),
                   sampling.sample_fraction(table, F.lit(400) / F.when(F.col("g") == "a", 20_000).otherwise(9_000), ["g"], F.col("id"), seed=5)):
        assert sample.columns == table.columns
        got = taken(sample)
        assert {g: sorted(ids) for g, ids in got.items()} == {g: sorted(in_hash_order(n, 5)[:400]) for g, n in (("a", 20_000), ("b", 9_000))}
        assert "md5" not in sample._jdf.queryExecution().optimizedPlan().toString()


def test_a_limit_that_is_too_low_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SPARE", -5)
    got = taken(sampling.cap_rows(groups(spark, {"a": 20_000}), 400, ["g"], F.col("id"), seed=5))
    assert sorted(got["a"]) == sorted(in_hash_order(20_000, 5)[:400])


def test_equal_keys_at_the_end_of_a_small_sample_are_told(spark):
    twice = spark.range(2_000).crossJoin(spark.range(2).select()).select(F.lit("a").alias("g"), F.col("id").cast("int").alias("id"))
    with pytest.raises(Exception, match="does not tell rows apart"):
        sampling.cap_rows(twice, 25, ["g"], F.col("id")).collect()
