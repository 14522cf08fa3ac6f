import numpy as np
import pytest
from pyspark.sql import functions as F

from driftflow.operators import balancing, copula
from driftflow.operators.scaling import MinMax

rng = np.random.default_rng(4)
SCHEMA = "day int, label string, id long, a double, b double, c double, d double"


def rows_of(label, n, twist, start=0):
    """a and b depend on each other, c has three values that follow a, d is constant."""
    a = rng.normal(size=n)
    b = np.exp(twist * a + np.sqrt(1 - twist ** 2) * rng.normal(size=n))
    c = np.digitize(a + 0.3 * rng.normal(size=n), [-0.5, 0.5]).astype(float)
    return [(1, label, start + i, *map(float, x), 7.0) for i, x in enumerate(zip(a, b, c))]


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of("rich", 3000, 0.0) + rows_of("up", 400, 0.9, 5000) + rows_of("down", 400, -0.8, 6000) + rows_of("one", 1, 0.5, 7000)
    rows += [(1, "few", 8000 + i, float(i), 2.0 * i, 0.0, 7.0) for i in range(3)] + [(1, "up", 9000, None, 1.0, 1.0, 7.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def made(table):
    out = copula.synthesize_copula(table, ["a", "b", "c", "d"], 2500, F.col("id")).toPandas()
    return {label: part for label, part in out.groupby("label")}


def spearman(x, y):
    return np.corrcoef(x.rank(), y.rank())[0, 1]


def test_sizes(made):
    assert {label: len(part) for label, part in made.items()} == {"up": 2099, "down": 2100, "one": 2499, "few": 2497}
    assert all(sorted(part.draw) == list(range(1, len(part) + 1)) for part in made.values())


@pytest.mark.parametrize("label", ["up", "down"])
def test_features_stay_as_dependent_as_they_are(made, table, label):
    real = table.where(f"label = '{label}' AND a IS NOT NULL").toPandas()
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        assert spearman(made[label][x], made[label][y]) == pytest.approx(spearman(real[x], real[y]), abs=0.07)


@pytest.mark.parametrize("label", ["up", "down", "one", "few"])
def test_features_stay_in_their_range_and_distribution(made, table, label):
    real, new = table.where(f"label = '{label}' AND a IS NOT NULL").toPandas(), made[label]
    for f in "abcd":
        assert real[f].min() <= new[f].min() and new[f].max() <= real[f].max()
    assert set(new.c) <= set(real.c) and set(new.d) == {7.0}
    if len(real) > 100:
        for q in (0.1, 0.5, 0.9):
            assert (new.b <= real.b.quantile(q)).mean() == pytest.approx(q, abs=0.04)
        assert np.allclose(new.c.value_counts(normalize=True).sort_index(), real.c.value_counts(normalize=True).sort_index(), atol=0.04)


def test_rows_do_not_depend_on_the_split(table):
    def some(df):
        return sorted(map(tuple, copula.synthesize_copula(df, ["a", "b"], 410, F.col("id"), seed=9).collect()))
    assert some(table) == some(table.repartition(2, "id").sortWithinPartitions(F.desc("id")))


def test_balancing_with_it(spark, table):
    scaler = MinMax.of(spark.createDataFrame([(0, "a", -3.0, 3.0), (1, "b", 0.0, 20.0)], "ord int, feature string, min double, max double"))
    out = balancing.balance_days(table, scaler, 500, F.col("id"), synthesize=copula.synthesize_copula)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {
        "rich": 500, "up": 500, "down": 500, "one": 500, "few": 500}
    up = out.where("label = 'up' AND row_key LIKE 'new:%'").toPandas()
    assert spearman(up.a, up.b) > 0.8
    none = copula.synthesize_copula(table.limit(0), ["a"], 5, F.col("id"))
    assert none.columns == ["day", "label", "draw", "a"] and none.count() == 0
