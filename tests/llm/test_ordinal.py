import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftflow.llm import ordinal
from driftflow.llm.linear import sigmoid
from driftflow.llm.ordinal import QualityModel


def sample(n, seed):
    """Grade 0 holds a bad word, grade 1 is shouted, grade 2 is plain."""
    rng = random.Random(seed)
    docs, ratings = [], []
    for i in range(n):
        words, grade = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 80))], rng.randrange(3)
        if grade == 0:
            words.insert(rng.randrange(len(words)), "rude" + rng.choice(["ly", "ness", "", "st"]))
        docs.append((i, " ".join(w.upper() + "!!" if grade == 1 else w for w in words)))
        ratings.append((i, grade))
    return docs, ratings


def frames(spark, docs, ratings):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, grade int")


def rate(docs, model):
    return docs.select("doc_id", model.rate(F.col("text")).alias("r")).select("doc_id", "r.*")


def test_grades_not_seen_before(spark):
    model = QualityModel.fit(*frames(spark, *sample(900, 1)))
    docs, ratings = sample(300, 2)
    out = {r.doc_id: r for r in rate(frames(spark, docs, ratings)[0], model).collect()}
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in out.values())
    assert sum((out[i].tail_probability >= 0.5) == (g == 2) for i, g in ratings) >= 285
    means = [np.mean([out[i].expected_grade for i, g in ratings if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert (np.diff(model.thresholds) >= 0).all()


def test_the_slope_is_that_of_the_likelihood():
    """After many steps no change of a weight or threshold makes the ratings likelier."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    grade = np.searchsorted([-0.5, 0.7], x @ [1.0, -0.5, 0.0] + rng.logistic(size=200))
    row, slot = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    weights, cuts = ordinal.fit_thresholds(row, slot, x.ravel(), grade, np.ones(200), 3, rounds=3000)

    def loss(w, c):
        side = sigmoid((x @ w)[:, None] - c)
        full = np.hstack([np.ones((200, 1)), side, np.zeros((200, 1))])
        at = np.arange(200)
        return -np.log(full[at, grade] - full[at, grade + 1]).mean() + 5e-4 * (w @ w)

    best = loss(weights, cuts)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert loss(weights + step * np.eye(3)[k], cuts) > best
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(weights, cuts + step * np.eye(2)[k]) > best


def test_features_do_not_depend_on_neighbours():
    texts = pa.array(["a b b B!! 12", "", None, "x y", "a b b B!! 12"])
    row, slot, value = ordinal.features(texts)
    own = [sorted(zip(slot[row == i].tolist(), value[row == i].tolist())) for i in range(5)]
    assert own[0] == own[4] and own[1] == own[2] == [] and own[3]
    alone = ordinal.features(texts.slice(3, 1))
    assert sorted(zip(alone[1].tolist(), alone[2].tolist())) == own[3]


def test_odd_rows(spark, odd, clashing, nothing):
    ratings = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (7, 0), (7, 0), (4, 1), (None, 1), (99, 2), (8, None)], "doc_id long, grade int")
    model = QualityModel.fit(clashing, ratings)
    out = rate(clashing, model)
    assert out.count() == odd.count() and out.where("expected_grade IS NULL OR tail_probability IS NULL").count() == 0
    assert rate(nothing, model).count() == 0
    for none in (QualityModel.fit(nothing, ratings), QualityModel.fit(odd, ratings.where("false"))):
        assert rate(odd, none).count() == odd.count()
    one = QualityModel.fit(odd, ratings.where("grade = 2"))
    assert {r.expected_grade for r in rate(odd, one).collect()} == {2.0}


def test_too_many_grades(spark, odd):
    ratings = spark.createDataFrame([(i, i) for i in range(40)], "doc_id long, grade int")
    with pytest.raises(ValueError):
        QualityModel.fit(odd, ratings)
