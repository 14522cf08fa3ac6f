"""The named queries next to their SQL; those without are tested against brute force beside their operators."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from driftflow.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


def test_every_operator_and_the_pipeline_are_named():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = check.spark_rows(QUERIES[name](spark, SF))
    assert check.compare(got, check.sql_rows(check.connect(SF), ORACLES[name])) is None


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95


def test_quality_of_rated_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = QUERIES["op10_ordinal_quality"](spark, SF).join(labels, "doc_id").toPandas()
    assert (out.selected == ((out.quality == 1) & (out.toxic == 0))).mean() > 0.9


def test_stages_keep_their_columns_and_survive_odd_rows(spark, odd, clashing, nothing):
    for docs in (clashing, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns, name
            assert kept.exceptAll(docs).count() == 0 or name == "repeated_lines"
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert mixed.columns == [*docs.columns, "mix_"] if "mix" in docs.columns else [*docs.columns, "mix"]
        assert mixed.drop(mixed.columns[-1]).exceptAll(docs).count() == 0


def test_one_of_each_class_stays(spark, odd):
    kept = corpus_pipeline.near_copies(spark, odd, SF)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id in (1, 2, 3, 11, 12)) == [
        (False, 1), (False, 3), (False, 11)]


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "mix"] and 0 < out.count() < docs.count()
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.where("mix.taken > 2 * mix.size OR mix.taken = 0").count() == 0
