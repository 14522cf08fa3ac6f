import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from driftflow.operators import cleaning
from driftflow.plans import ingest
from driftflow.session import discard, fresh_path
from driftflow.sources import days as D
from driftflow.sources import state
from driftflow.sources.ledger import DayLedger


def write_day(path, header, rows):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_registry():
    files = D.day_files("s3a://somewhere/flows/")
    assert len(files) == 10 and list(files)[:3] == ["feb14", "feb15", "feb16"]
    assert files["feb20"] == "s3a://somewhere/flows/Thuesday-20-02-2018_TrafficForML_CICFlowMeter.csv"


def test_day_of_a_path(spark):
    df = spark.createDataFrame([("/x/Friday-02-03-2018_TrafficForML_CICFlowMeter.csv",), ("/x/y.csv",)], "p string")
    assert [r[0] for r in df.select(D.day_of(F.col("p"))).collect()] == ["mar02", None]


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        D.read_day_files(spark, {"a": str(tmp_path / "no.csv")})
    with pytest.raises(FileNotFoundError):
        D.read_day_table(spark, str(tmp_path / "no"))
    with pytest.raises(FileNotFoundError):
        state.load_scaler(spark, str(tmp_path / "no"))


def test_day_table_keeps_types_and_first_result(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("01", 1.0), ("02", 2.0)], "day string, x double")
    D.write_day_table(table, path)
    back = D.write_day_table(table.limit(0), path)
    assert sorted(tuple(r) for r in back.select("day", "x").collect()) == [("01", 1.0), ("02", 2.0)]
    part = D.read_day_table(spark, path, ["02", "03"])
    assert [tuple(r) for r in part.select("day", "x").collect()] == [("02", 2.0)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ingest_from_csv(spark, tmp_path):
    plain = " Dur ,Pkts,Timestamp, Label"
    a = write_day(tmp_path / "a.csv", plain, [
        *[f"{i},{i * 2},t,Benign" for i in range(1, 31)], plain, "Infinity,1,t,Bot", "5,,t,Bot", "6,abc,t, Bot "])
    b = write_day(tmp_path / "b.csv", plain + ",Src", [f"{i},{i},t,Infilteration,10.0.0.{i}" for i in range(4)])
    files = {"d1": a, "d2": b, "d3": str(tmp_path / "absent.csv")}
    out = str(tmp_path / "out")
    table = ingest.ingest_days(spark, files, out, target_rows=33, fractions={}, default_fraction=1.0)
    rows = table.collect()
    first = [r for r in rows if r["day"] == "d1"]
    assert len(first) in (31, 32)  # 32 usable rows: 30 benign, the header row, one bot, drawn up to 33 with copies
    assert {r["label"] for r in rows} <= {"Benign", "Bot", "Infiltration"}
    assert all(r["Pkts"] == 0.0 for r in rows if r["label"] == "Bot")
    assert sum(r["day"] == "d2" for r in rows) == 33
    assert len({r["row_id"] for r in rows}) == len(rows)
    assert "Timestamp" not in table.columns and "Label" not in table.columns
    again = ingest.ingest_days(spark, files, out, target_rows=3, fractions={}, default_fraction=1.0)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))


def test_fraction_by_day(spark):
    df = spark.createDataFrame([("feb20",), ("feb21",)], "day string")
    assert [r[0] for r in df.select(ingest.day_fraction(F.col("day"))).collect()] == [0.15, 0.30]



ALL_ROWS = {"target_rows": None, "default_fraction": None, "fractions": {}}


def test_later_days_are_added(spark, tmp_path):
    header = "Dur,Timestamp,Label"
    files = {d: write_day(tmp_path / f"{d}.csv", header, [f"{i},t,Benign" for i in range(n)]) for d, n in (("d1", 3), ("d2", 4))}
    out = str(tmp_path / "out")
    assert ingest.ingest_days(spark, files, out, **ALL_ROWS).count() == 7
    files["d3"] = write_day(tmp_path / "d3.csv", header + ",Src", ["9,t,Bot,1", "8,t,Bot,2"])
    files["d0"] = write_day(tmp_path / "d0.csv", "Other,Timestamp,Label", ["1,t,Bot"])
    table = ingest.ingest_days(spark, files, out, **ALL_ROWS)
    assert {r["day"]: r["count"] for r in table.groupBy("day").count().collect()} == {"d0": 1, "d1": 3, "d2": 4, "d3": 2}
    assert table.select("row_id").distinct().count() == 10
    assert set(table.columns) == {"day", "row_id", "label", "Dur", "Src", "Other"}
    files["d4"] = str(tmp_path / "absent.csv")
    assert ingest.ingest_days(spark, files, out, **ALL_ROWS).count() == 10


def test_an_absent_feature_raises(spark):
    df = spark.createDataFrame([("d1", 1.0, 2.0), ("d2", None, 2.0)], "day string, a double, b double")
    assert cleaning.require_features(df, ["b"]) is df
    with pytest.raises(ValueError, match=r"day d2: \['a'\]"):
        cleaning.require_features(df, ["a", "b"])
    with pytest.raises(ValueError, match="c"):
        cleaning.require_features(df, ["c"])


def test_an_empty_day_table_says_so(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = D.write_day_table(D.empty_day_table(spark, ["x"]), path, "overwrite")
    assert not D.is_populated(empty) and set(empty.columns) == {"day", "x", "label"}
    assert D.days_in(spark, path) == set() and D.days_in(spark, str(tmp_path / "no")) == set()
    part = spark.createDataFrame([("d1", 1.0, "Bot")], "day string, x double, label string")
    assert D.is_populated(D.write_day_table(part, path, "append")) and D.days_in(spark, path) == {"d1"}


def test_a_table_is_taken_out_again(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    discard(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_a_run_that_dies_leaves_no_half_days(spark, tmp_path):
    """A batch without an entry, a half-written entry, and a batch whose writing failed are not there."""
    files = {d: write_day(tmp_path / f"{d}.csv", "Dur,Timestamp,Label", [f"{i},t,Benign" for i in range(n)]) for d, n in (("d1", 3), ("d2", 4))}
    out = str(tmp_path / "out")
    assert ingest.ingest_days(spark, {"d1": files["d1"]}, out, **ALL_ROWS).count() == 3
    half = tmp_path / "out/clean/rows/batch=dead/day=d2"
    half.mkdir(parents=True)
    spark.createDataFrame([(1.0, "Bot", 77)], "Dur double, label string, row_id long").write.mode("overwrite").parquet(str(half))
    (tmp_path / "out/clean/ledger/.00000001-dead.json").write_text('{"number": 1, "batch": "dead", "days": ["d2"]')
    (tmp_path / "out/clean/ledger/00000002-dead.json").write_text('{"number": 2, "batch": "dead", "days": ["d')
    ledger = DayLedger(spark, f"{out}/clean")
    assert ledger.days() == {"d1"} and ledger.read().count() == 3
    failing = spark.range(10).selectExpr("'d2' AS day", "IF(id > 8, raise_error('gone'), 1.0D) AS Dur", "'Bot' AS label", "id AS row_id")
    with pytest.raises(Exception, match="gone"):
        ledger.append(failing, ["d2"])
    assert ledger.days() == {"d1"}
    table = ingest.ingest_days(spark, files, out, **ALL_ROWS)
    assert {r["day"]: r["count"] for r in table.groupBy("day").count().collect()} == {"d1": 3, "d2": 4}
    assert table.where("label = 'Bot'").isEmpty() and sorted(r["row_id"] for r in table.select("row_id").collect())[:3] == [0, 1, 2]
    assert ledger.last_row_id() == max(r["row_id"] for r in table.select("row_id").collect())


def test_a_group_of_days_that_cleans_to_nothing(spark, tmp_path):
    """The other group is loaded, and neither day is loaded again."""
    files = {"a": write_day(tmp_path / "a.csv", "Dur,Timestamp,Label", ["1,t,what"]),
             "b": write_day(tmp_path / "b.csv", "Dur,Src,Timestamp,Label", ["1,2,t,Benign"])}
    out = str(tmp_path / "out")
    table = ingest.ingest_days(spark, files, out, **ALL_ROWS)
    assert [(r["day"], r["Dur"], r["Src"]) for r in table.collect()] == [("b", 1.0, 2.0)]
    assert DayLedger(spark, f"{out}/clean").days() == {"a", "b"}
    alone = ingest.ingest_days(spark, {"a": files["a"]}, str(tmp_path / "alone"), **ALL_ROWS)
    assert alone.count() == 0 and {"day", "Dur", "label"} <= set(alone.columns)


def test_many_headers_in_one_job(spark, tmp_path):
    """Files with two headers, one of them padded, in two folders; some are absent, one is empty, one is a folder."""
    (tmp_path / "more files").mkdir()
    files = {}
    for i in range(40):
        files[f"d{i}"] = str((tmp_path / "more files" if i % 2 else tmp_path) / f"day {i}.csv")
        if i % 5 < 3:
            header, row = (" A ,B,Label", f"{i},x,Benign") if i % 3 else ("B,A,Label", f"x,{i},Benign")
            write_day(tmp_path / files[f"d{i}"], header, [row] * (i % 4))
    (tmp_path / "empty.csv").write_text("")
    files["empty"] = str(tmp_path / "empty.csv")
    D.write_csv(spark.range(5).selectExpr("id AS A", "'y' AS B", "'Bot' AS Label").repartition(3), str(tmp_path / "folder"))
    files["folder"] = str(tmp_path / "folder")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    groups = D.day_groups(spark, files)
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 8
    (days, table), = groups
    assert set(days) == {f"d{i}" for i in range(40) if i % 5 < 3} | {"folder"}
    got = {}
    for r in table.collect():
        got.setdefault(r["day"], []).append((r["A"], r["B"]))
    assert got.pop("folder") and sorted(got) == sorted(f"d{i}" for i in range(40) if i % 5 < 3 and i % 4)
    assert all(v == [(d[1:], "x")] * (int(d[1:]) % 4) for d, v in got.items())


def test_header_names():
    assert D._header_names('a, b ,"c,d",,a') == ["a0", " b ", "c,d", "_c3", "a4"]
