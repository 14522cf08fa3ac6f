import numpy as np
import pytest
from pyspark.sql import functions as F

from driftflow.operators import distribution as D
from driftflow.operators import drift, timeline


def long_table(spark, days):
    """days: {day: {feature: values}}"""
    rows = [(d, f, float(v)) for d, fs in days.items() for f, vs in fs.items() for v in vs]
    return spark.createDataFrame(rows, "day int, feature string, value double").withColumn("n", F.lit(1).cast("bigint"))


def pairs(spark, rows=((2, 1, "base"), (2, 2, "test"))):
    return spark.createDataFrame(list(rows), "cmp int, day int, side string")


def psi_by_hand(base, test, closed):
    base, test = np.asarray(base, float), np.asarray(test, float)
    edges = np.percentile(base, np.arange(0, 101, 10))
    if closed:
        edges[0], edges[-1] = edges[0] - 1e-5, edges[-1] + 1e-5
    edges = np.array(sorted(set(edges)))
    if len(edges) < 2:
        return 0.0
    total = 0.0
    for i in range(len(edges) - 1):
        low, high = edges[i], edges[i + 1]
        last = i == len(edges) - 2
        if not closed:
            low, high = (-np.inf if i == 0 else low), (np.inf if last else high)
        p, q = (((x >= low) & ((x <= high) if last else (x < high))).sum() / len(x) for x in (base, test))
        p, q = p or 1e-4, q or 1e-4
        total += (q - p) * np.log(q / p)
    return total


def wd_by_hand(u, v):
    grid = np.array(sorted(set(u) | set(v)), float)
    fu, fv = (np.searchsorted(np.sort(np.asarray(x, float)), grid, side="right") / len(x) for x in (u, v))
    return float(np.sum(np.abs(fu - fv)[:-1] * np.diff(grid)))


rng = np.random.default_rng(3)
CASES = {
    "normal": (rng.normal(0, 1, 700), rng.normal(0.3, 1.2, 400)),
    "repeated_min": (np.r_[np.zeros(60), rng.random(100)], np.r_[np.zeros(5), rng.random(70)]),
    "out_of_range": (rng.random(200), rng.random(100) * 3 - 1),
    "few_values": (rng.integers(0, 4, 300), rng.integers(0, 6, 200)),
    "constant_base": (np.full(30, 5.0), np.array([5.0, 5.0, 6.0])),
    "one_base_row": (np.array([1.0]), np.array([1.0, 2.0])),
}


@pytest.fixture(scope="module")
def cases(spark):
    table = long_table(spark, {1: {k: b for k, (b, _) in CASES.items()}, 2: {k: t for k, (_, t) in CASES.items()}})
    return table.cache()


@pytest.mark.parametrize("rows_per_bucket", [10_000, 40])
@pytest.mark.parametrize("closed", [False, True])
def test_measures_follow_their_definitions(spark, cases, closed, rows_per_bucket):
    found = drift.drift_of_counts(D.value_counts(cases), pairs(spark), closed, rows_per_bucket=rows_per_bucket)
    found = {r["feature"]: r for r in found.collect()}
    assert set(found) == set(CASES)
    for name, (base, test) in CASES.items():
        assert found[name]["psi"] == pytest.approx(psi_by_hand(base, test, closed), abs=1e-9), name
        assert found[name]["wasserstein"] == pytest.approx(wd_by_hand(base, test), abs=1e-9), name


@pytest.mark.parametrize("rows_per_bucket", [10_000, 25])
def test_percentiles(spark, cases, rows_per_bucket):
    base = cases.where("day = 1")
    cuts = D.value_cuts(base, rows_per_bucket)
    for r in D.quantile_edges(base, cuts=cuts).collect():
        want = np.percentile(np.asarray(CASES[r["feature"]][0], float), np.arange(0, 101, 10))
        assert r["edges"] == pytest.approx(list(want), abs=1e-12), r["feature"]


def test_buckets_hold_what_lies_between_their_cuts(spark):
    values = sorted(rng.random(3000))
    long = long_table(spark, {1: {"x": values, "y": [1.0, 2.0]}})
    cuts = D.value_cuts(long, 50)
    assert set(cuts) == {"x"} and len(cuts["x"]) > 40
    for r in D.with_bucket(long, cuts).collect():
        want = sum(c <= r["value"] for c in cuts["x"]) if r["feature"] == "x" else 0
        assert r["bucket"] == want


def test_ranges_have_a_bound_whatever_the_rows(spark):
    """Cut points are part of plans: a longer table has more rows in a range, not more ranges, and the same result."""
    values, moved = rng.random(6000), rng.random(5000) * 1.2
    long = long_table(spark, {1: {"x": values}, 2: {"x": moved}}).cache()
    cuts = D.value_cuts(long, 2)
    assert D.QUANTILES <= len(cuts["x"]) <= 2 * D.MOST_RANGES
    edges = D.quantile_edges(long, by=["day"], cuts=cuts).where("day = 1").first()["edges"]
    assert edges == pytest.approx(list(np.percentile(values, np.arange(0, 101, 10))), abs=1e-12)
    got = drift.drift_of_counts(long, pairs(spark), rows_per_bucket=2).first()
    assert got["wasserstein"] == pytest.approx(wd_by_hand(values, moved), abs=1e-9)
    assert got["psi"] == pytest.approx(psi_by_hand(values, moved, False), abs=1e-9)


def test_places_take_log_steps(spark):
    """A thousand cut points are eleven short columns, in the plan and in the code made of it."""
    long = long_table(spark, {1: {"x": rng.random(500)}})
    cuts = {"x": sorted(set(rng.random(1000).tolist()))}
    placed = D.with_bucket(long, cuts)
    plan = placed.where("NOT single").groupBy("bucket").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("if ((get(") <= 2 * 11 and len(plan) < 40_000
    assert all(r["bucket"] == sum(c <= r["value"] for c in cuts["x"]) for r in placed.collect())


def test_values_that_many_share_have_buckets_of_their_own(spark):
    """Their rows are counted and stay where they are; only the others are shuffled."""
    values = np.r_[np.repeat([1.0, 2.0, 3.0], 300), rng.random(100) * 4]
    long = long_table(spark, {1: {"x": values}, 2: {"x": values[::2]}})
    cuts = D.value_cuts(long, 50)
    daily = D.bucket_counts(long, cuts)
    assert {r["n"] for r in daily.where("single AND day = 1").collect()} == {300}
    assert D.with_bucket(long, cuts).where("NOT single").count() == 150
    got = drift.wasserstein(long, pairs(spark), cuts, daily).first()["wasserstein"]
    assert got == pytest.approx(wd_by_hand(values, values[::2]), abs=1e-12)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_rows_at_the_ends_of_buckets_are_narrow(spark):
    """No array of all cut points goes along with every row that is shuffled and sorted."""
    long = long_table(spark, {1: {"x": rng.random(500)}, 2: {"x": rng.random(400)}})
    cuts = D.value_cuts(long, 20)
    ends = drift._bucket_ends(D.bucket_counts(long, cuts), D.cuts_table(spark, cuts))
    windows = [n for n in _nodes(ends._jdf.queryExecution().sparkPlan()) if n.nodeName() == "Window"]
    assert windows and all(kind not in w.schema().json() for w in windows for kind in ('"array"', '"map"'))
    assert ends.count() == 2 * 2 * len(cuts["x"])


def test_values_are_sorted_once_for_all_comparisons(spark, monkeypatch):
    """Rows are not repeated for the comparisons their day is in; longer calendars give the same result."""
    table = {d: {"x": rng.random(200 + 30 * d) * (1 + d / 9), "y": rng.integers(0, 5, 150)} for d in range(1, 7)}
    del table[6]["y"]
    long = long_table(spark, table).cache()
    rows = [(c, d, "base") for c in (4, 5, 6, 7) for d in range(c - 3, c)] + [(c, c, "test") for c in (4, 5, 6, 7)]
    cuts = D.value_cuts(long, 20)

    def found():
        return drift.wasserstein(long, pairs(spark, rows), cuts)

    windows = [n for n in _nodes(found()._jdf.queryExecution().sparkPlan()) if n.nodeName() == "Window"]
    assert all("cmp" not in n.toString().split("\n")[0] for n in windows)
    got = {(r["cmp"], r["feature"]): r["wasserstein"] for r in found().collect()}
    assert set(got) == {(c, f) for c in (4, 5, 6) for f in "xy"} - {(6, "y")}
    for (c, f), area in got.items():
        assert area == pytest.approx(wd_by_hand(np.concatenate([table[d][f] for d in range(c - 3, c)]), table[c][f]), abs=1e-9)
    monkeypatch.setattr(drift, "MOST_COLUMNS", 2)
    assert {(r["cmp"], r["feature"]): pytest.approx(r["wasserstein"], abs=1e-12) for r in found().collect()} == got


def test_identical_shifted_and_two_point(spark):
    base = {"same": [1, 2, 3, 4], "moved": [1, 2, 3, 4], "two": [0, 1]}
    test = {"same": [4, 3, 2, 1], "moved": [3, 4, 5, 6], "two": [0, 0, 1, 1, 1]}
    counts = D.value_counts(long_table(spark, {1: base, 2: test}))
    wd = {r["feature"]: r["wasserstein"] for r in drift.wasserstein(counts, pairs(spark)).collect()}
    assert wd["same"] == 0 and wd["moved"] == pytest.approx(2) and wd["two"] == pytest.approx(0.1)
    psi = {r["feature"]: r["psi"] for r in drift.psi_open(counts, pairs(spark)).collect()}
    assert psi["same"] == 0 and psi["moved"] > 0


def test_a_day_without_rows_has_no_record(spark):
    counts = D.value_counts(long_table(spark, {1: {"x": [1, 2, 3]}, 2: {"x": [1, 2]}}))
    both = pairs(spark, [(2, 1, "base"), (2, 2, "test"), (3, 1, "base"), (3, 3, "test")])
    for cuts in ({}, {"x": [2.0]}):
        found = drift.psi_open(counts, both, cuts=cuts).join(drift.wasserstein(counts, both, cuts), ["cmp", "feature"])
        assert [r["cmp"] for r in found.collect()] == [2]


def test_a_third_of_all_rows_share_one_value(spark):
    base = np.r_[np.full(2000, 0.5), rng.random(4000)]
    test = np.r_[np.full(900, 0.5), rng.random(1800)]
    counts = D.value_counts(long_table(spark, {1: {"x": base}, 2: {"x": test}}))
    got = drift.drift_of_counts(counts, pairs(spark), rows_per_bucket=100).first()
    assert got["wasserstein"] == pytest.approx(wd_by_hand(base, test), abs=1e-9)
    assert got["psi"] == pytest.approx(psi_by_hand(base, test, False), abs=1e-9)


def test_base_days_meet_their_comparisons_after_the_shuffle(spark):
    """The plan lays out the values once, by (feature, bucket)."""
    counts = D.value_counts(long_table(spark, {1: {"x": range(50)}, 2: {"x": range(40)}}))
    plan = drift.wasserstein(counts, pairs(spark), {"x": [10.0, 20.0]})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature" in plan and "hashpartitioning(cmp" in plan
    windows = plan[:plan.index("hashpartitioning(feature")]
    assert windows.count("Exchange hashpartitioning(cmp") == 1  # only the final sums move again


def test_mean_over_features(spark):
    df = spark.createDataFrame([(4, "a", 1.0, 2.0), (4, "b", 3.0, 6.0)], "cmp int, feature string, psi double, wasserstein double")
    assert [tuple(r) for r in drift.mean_drift(df).collect()] == [(4, 2.0, 4.0)]


def test_schedules(spark):
    days = timeline.timeline(spark, [f"d{i}" for i in range(1, 11)])
    window = {}
    for r in timeline.window_schedule(days).collect():
        window.setdefault(r["test_ord"], []).append(r["window_ord"])
    assert {t: sorted(w) for t, w in window.items()} == {t: [t - 3, t - 2, t - 1] for t in range(4, 11)}
    assert sorted((r["test_ord"], r["exit_ord"]) for r in timeline.exit_schedule(days).collect()) == [
        (t, t - 3) for t in range(4, 11)]
    assert sorted((r["test_ord"], r["anchor_ord"]) for r in timeline.anchor_schedule(days).collect()) == [
        (t, a) for t in range(5, 11) for a in range(1, t - 3)]
    sides = timeline.baseline_pairs(days).groupBy("cmp", "side").count().collect()
    assert {(r["cmp"], r["side"]): r["count"] for r in sides} == {
        (f"d{t}", s): n for t in range(4, 11) for s, n in (("base", 3), ("test", 1))}
