import random
import re

import numpy as np
import pyarrow as pa
import pytest

from driftflow.llm import arrays, substring_dedup

LAST = (1 << 63) - 1


def brute(docs, length=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    order = [LAST if i is None else i for i, _ in docs]
    first = {}
    for o, ws in zip(order, split):
        for p in range(len(ws) - length + 1):
            w = tuple(ws[p:p + length])
            first[w] = min(first.get(w, o), o)
    out = []
    for (i, _), o, ws in zip(docs, order, split):
        gone = {p + k for p in range(len(ws) - length + 1) if first[tuple(ws[p:p + length])] < o for k in range(length)}
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def rows(out):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.select("row.doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


@pytest.mark.parametrize("vocabulary", [2, 5, 1000])
def test_against_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    source = [f"w{rng.randrange(vocabulary)}" for _ in range(3000)]
    docs = []
    for i in range(120):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at, n, spot = rng.randrange(2900), rng.randrange(5, 60), rng.randrange(len(words) + 1)
            words[spot:spot] = source[at:at + n]
        docs.append((rng.randrange(100), rng.choice([" ", "\n", "\t "]).join(words)))
    assert rows(substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_runs_of_one_word(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(" ".join([rng.choice("ab")] * rng.randrange(1, 40)) for _ in range(4))) for i in range(80)]
    assert rows(substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_equal_windows_have_equal_marks_whatever_surrounds_them():
    rng = random.Random(9)
    for _ in range(300):
        vocabulary = rng.choice([2, 3, 8, 50])
        window = [f"w{rng.randrange(vocabulary)}" for _ in range(13)]
        texts = [" ".join([f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(6))] + window
                          + [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(6))]) for _ in range(4)]
        words = arrays.Words(pa.array(texts))
        hashes = words.hashes()
        start, mark = substring_dedup.anchors(words, hashes)
        name = arrays.grams(hashes, 13)[start]
        wanted = arrays.grams(arrays.Words(pa.array([" ".join(window)])).hashes(), 13)[0]
        assert len(np.unique(mark[name == wanted])) == 1


def test_odd_rows(odd, clashing, nothing):
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(substring_dedup.dedup(odd)) == brute(plain)
    out = substring_dedup.dedup(clashing)
    assert rows(out) == brute(plain)
    assert out.select("row.*").columns == [c for c in clashing.columns if c != "text"]
    assert substring_dedup.dedup(nothing).count() == 0


def test_windows_are_made_and_shuffled_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 97}" for k in range(i, i + 40))) for i in range(20)], "doc_id long, text string")
    plan = substring_dedup.repeated_windows(docs)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Exchange hashpartitioning")) == (1, 1)


def test_long_runs_of_one_mark(spark):
    """More windows of one mark side by side than a row holds."""
    docs = [(i, " ".join(["x"] * n + ["a", "b"] + ["x"] * n)) for i, n in enumerate((300, 700, 20, 700))]
    assert rows(substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
