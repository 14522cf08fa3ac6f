"""All named queries next to their SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402
from driftflow.registry import queries as registry  # noqa: E402
from driftflow.registry.oracles import ORACLES  # noqa: E402
from driftflow.registry.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_flagship(spark):
    assert contract.entry(spark).columns == ["day", "mean_psi", "mean_wd"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = check.spark_rows(QUERIES[name](spark, SF))
    assert check.compare(got, check.sql_rows(check.connect(SF), ORACLES[name])) is None


def test_models_learn_from_every_row(spark, tmp_path):
    """Classes of 400 to 6,500 rows a day: none is left out, and the smaller ones are filled up."""
    whole = spark.range(70_000).withColumn("l_discount", F.expr("floor(id / 7) % 11 / 100")).where(
        "id % 7 > 0 OR l_discount < 0.05 OR id < 8000")
    whole.select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (1 + F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") % 977).cast("double").alias("l_extendedprice"),
        F.col("l_discount").cast("double").alias("l_discount"), (F.col("id") % 9 / 100).cast("double").alias("l_tax"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.expr("cast(make_date(1995 + cast(id % 7 as int), 6, 1) as timestamp_ntz)").alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    table, _, _, balanced = registry._rule_lineitem(spark, str(tmp_path))
    real = balanced.where("row_key LIKE 'real:%'")
    keys = table.select("day", "label", F.concat(F.lit("real:"), "row_key").alias("row_key"))
    assert real.count() == table.count() and keys.exceptAll(real.select(keys.columns)).isEmpty()
    most = table.groupBy("day", "label").count().agg(F.max("count")).first()[0]
    assert {r["count"] for r in balanced.groupBy("day", "label").count().collect()} == {most}
    assert most > 5000
