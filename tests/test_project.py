import pytest

from driftflow.operators import models
from driftflow.plans.project import Project


def test_a_whole_run_over_a_folder(spark, tmp_path):
    files, days = {}, [f"d{i}" for i in range(1, 7)]
    for d, day in enumerate(days):
        if day == "d6":
            files[day] = str(tmp_path / "absent.csv")
            continue
        rows = [f"{i % 10 + 5 * (i % 3 == 0)},{i + d},1,t,{'Bot' if i % 3 == 0 else 'Benign'}" for i in range(60)]
        path = tmp_path / f"{day}.csv"
        path.write_text("\n".join([" a,b ,flat,Timestamp,Label", *rows]) + "\n")
        files[day] = str(path)
    run = Project(spark, str(tmp_path / "out"), days)
    with pytest.raises(FileNotFoundError):
        run.scaler()
    run.load(files, target_rows=50, default_fraction=1.0)
    assert run.fit_baseline().features == ["a", "b"]

    first = run.balance(20, days=["d1"])
    assert {r["day"] for r in first.select("day").distinct().collect()} == {"d1"}
    balanced = run.balance(20).groupBy("day", "label").count().collect()
    assert {(r["day"], r["label"]): r["count"] for r in balanced} == {
        (d, x): 20 for d in days[:5] for x in ("Benign", "Bot")}

    drift = run.static_drift().collect()
    assert [r["Day"] for r in drift] == ["d4", "d5"] and all(r["Mean_WD"] > 0 for r in drift)
    stages = {"f": (models.forest(["a", "b"], trees=2, depth=3), None)}
    static = run.static_experiment(stages).collect()
    assert [(r["Model"], r["Deployment_Day"]) for r in static] == [("f", "d4"), ("f", "d5")]
    adaptive = run.adaptive_experiment(stages)
    assert adaptive.columns[-2:] == ["Active_Window_PSI", "Active_Window_WD"] and adaptive.count() == 2
    anchor = run.history_anchor().groupBy("day", "label").count().collect()
    assert {(r["day"], r["label"]): r["count"] for r in anchor} == {
        (d, x): 1 for d in ("d1", "d2", "d3") for x in ("Benign", "Bot")}
