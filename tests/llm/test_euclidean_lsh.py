"""p-stable hashing next to all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftflow.llm import euclidean_lsh as lsh

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, similar=0.95):
    """Rows as ``(vec_id, vector)``; all pairs in double precision."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if g else None for (_, v), g in zip(rows, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(n) if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j])
             and float(unit[i] @ unit[j]) >= similar] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def made(rng, dim=16):
    """Copies, scaled copies, near groups of several widths, chains along an arc, and unrelated vectors."""
    rows = [rng.standard_normal(dim) for _ in range(60)]
    rows += [rows[3]] * 20 + [rows[3] * 2.5, rows[4] * 1e-30, rows[4] * 1e30]
    for spread in (0.02, 0.05, 0.08, 0.12):
        heart = rng.standard_normal(dim)
        heart /= np.linalg.norm(heart)
        rows += [heart + spread * rng.standard_normal(dim) for _ in range(40)]
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    rows += [a * math.cos(t) + b * math.sin(t) for t in np.arange(0, 1.5, 0.04)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


ODD = [(None, [1.0] * 16), (None, None), (7, [0.0] * 16), (8, [float("nan")] + [1.0] * 15), (9, [float("inf")] * 16), (10, []),
       (11, [1.0, None]), (12, [1.0, 0.0]), (13, [1.0, 0.01]), (5, [2.0] * 16), (5, [-1.0] * 16), (14, [3.0]), (15, [1.0]),
       (16, [-0.0, 1.0]), (17, [0.0, 1.0])]


@pytest.mark.parametrize("block", [lsh.BLOCK, 7])
def test_equals_all_pairs(spark, block):
    rows = made(np.random.default_rng(5)) + ODD
    out = lsh.link(spark.createDataFrame(rows, SCHEMA).repartition(5), miss=1e-9, block=block)
    assert told(out) == brute(rows)


def test_clashing_columns_and_empty_tables(spark):
    rows = made(np.random.default_rng(6))[:80] + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", *[f"'x' AS {n}" for n in ("row", "node", "bucket", "ball", "label", "h1", "kept")])
    assert told(lsh.link(clash)) == brute(rows)
    assert told(lsh.link(df.limit(0))) == []
    assert told(lsh.link(spark.createDataFrame([(7, [0.0])], SCHEMA))) == [(7, 0, 7, True)]
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [-2, 1])], "vec_id long, embedding array<int>")
    assert told(lsh.link(whole)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_a_third_in_one_group_makes_no_pairs(spark):
    """Near copies are a ball: what is written stays in proportion to the rows."""
    rng = np.random.default_rng(8)
    heart = rng.standard_normal(32)
    heart /= np.linalg.norm(heart)
    rows = [(i, [float(x) for x in (heart + 0.012 * rng.standard_normal(32) if i % 3 == 0 else rng.standard_normal(32))]) for i in range(1500)]
    out = lsh.link(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert out.where("n_links = 499 AND component_id = 0").count() == 500
    assert out.where("vec_id % 3 > 0 AND n_links = 0 AND kept").count() == 1000


def test_recall_at_the_threshold(spark):
    """Pairs just within the wanted cosine, each alone: nearly all are found, and none below it."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1000):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        t = math.acos(0.952 if i % 2 else 0.948)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (a * math.cos(t) + b * math.sin(t)).tolist())]
    out = lsh.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    n = out.groupBy((F.floor(F.col("vec_id") / 2) % 2).alias("odd")).agg(F.sum("n_links").alias("n")).collect()
    n = {r.odd: r.n for r in n}
    assert n[0] == 0 and n[1] >= 0.995 * 1000


def test_meeting_probability():
    """The closed form next to drawn projections."""
    rng = np.random.default_rng(10)
    for distance in (0.3, 1.0, 1.4):
        step, shift = rng.standard_normal(200_000) * distance, rng.random(200_000) * 2
        assert abs(np.mean(np.floor((shift + step) / 2) == 0) - lsh.meets(distance, 2.0)) < 0.005
