import math

import pytest
from pyspark.sql import functions as F

from driftflow.functions import scalars as S
from driftflow.operators import cleaning, scaling, training


def column(df, name):
    return [r[name] for r in df.collect()]


def test_numbers_from_text(spark):
    cells = [" 2 ", "1e3", ".5", "1.", "-7", "Infinity", "-inf", "abc", "1d", "0x1f", "1_0", "", None, "\t3\t"]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    got = column(df.select(S.to_number(F.col("x")).alias("x")), "x")
    assert got == [2.0, 1000.0, 0.5, 1.0, -7.0, math.inf, -math.inf, None, None, None, None, None, None, 3.0]


def test_zero_policy_and_drop_policy(spark):
    rows = [(1.0,), (math.inf,), (-math.inf,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert column(cleaning.zero_bad(df, ["x"]), "x") == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert column(cleaning.drop_unfinite(df, ["x"]), "x") == [1.0]


def test_unreadable_text_survives_the_drop_and_becomes_zero(spark):
    rows = [(1, "5", "Benign"), (2, "abc", "Bot"), (3, "Infinity", "Bot"), (4, "", "Bot"), (5, None, "Bot"),
            (6, "1", None), (7, "x", "Label"), (8, "1", "nobody knows")]
    df = spark.createDataFrame(rows, "id int, x string, Label string")
    usable = cleaning.drop_bad_rows(df, ["x"], ["Label"])
    assert column(usable, "id") == [1, 2, 7, 8]
    cleaned = cleaning.clean(usable, ["x"]).select("id", "x", "label")
    assert [tuple(r) for r in cleaned.collect()] == [(1, 5.0, "Benign"), (2, 0.0, "Bot")]


def test_labels(spark):
    raw = [" Benign\t", "DDOS attack-HOIC", "Infilteration", "Infiltration", "SQL Injection", "Label", " Label ",
           None, "else"]
    df = spark.createDataFrame([(x,) for x in raw], "Label string")
    got = column(cleaning.standardize_labels(df), "label")
    assert got == ["Benign", "DDoS attacks-HOIC", "Infiltration", "Infiltration", "SQL-Injection"]
    assert cleaning.drop_header_rows(df).count() == 7  # the null passes here and goes with the unmapped ones
    assert len(cleaning.LABEL_MAP) == 16 and len(set(cleaning.LABEL_MAP.values())) == 15


def test_binary_target_counts_null_as_attack(spark):
    df = spark.createDataFrame([("Benign",), ("Bot",), (None,)], "label string")
    assert column(training.binary_target(df), "target") == [0, 1, 1]


def test_headers_and_projection(spark):
    df = cleaning.trim_headers(spark.createDataFrame([(1, 2, 3)], "` b` int, `a ` int, Label int"))
    assert cleaning.feature_names(df) == ["b", "a"]
    assert scaling.project(df, ["a"]).columns == ["a"]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        scaling.project(df, ["absent"])


def test_clip_and_grid(spark):
    df = spark.createDataFrame([(-1.0,), (0.25,), (3.0,)], "x double")
    assert column(df.select(S.clip(F.col("x")).alias("x")), "x") == [0.0, 0.25, 1.0]
    assert spark.range(1).select(S.grid(4).alias("g")).first()["g"] == [0.0, 0.25, 0.5, 0.75, 1.0]
