"""Importance resampling next to a definition in plain Python."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftflow.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def runs(text, grams):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, grams=1, buckets=10_000, percent=10, least=20):
    def tally(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t, grams):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out
    s, t = tally(x for _, x in docs), tally(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        f = [gain[zlib.crc32(x.encode()) % buckets] for x in runs(text, grams)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(words(text))])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for place, r in enumerate(order[:percent * len(order) // 100], 1):
        r[5] = place
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in out), key=str)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("grams, percent", [(1, 10), (2, 50), (3, 100)])
def test_equals_the_definition(spark, odd, rng, grams, percent):
    aim = ["the w1 w2 w3 w4", "w5 w6 ÜNÏ çödé 🙂", None, ""]
    target = spark.createDataFrame([(x,) for x in aim], "text string")
    got = told(resampling.resample(odd, target, grams=grams, percent=percent))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], aim, grams, percent=percent)


def test_clashing_columns_and_empty_tables(spark, odd, clashing, nothing):
    target = spark.createDataFrame([("w1 w2",)], "text string")
    assert told(resampling.resample(clashing, target, percent=60)) == told(resampling.resample(odd, target, percent=60))
    assert told(resampling.resample(nothing, target)) == []
    none = target.limit(0)
    assert told(resampling.resample(odd, none, percent=60)) == brute([(r.doc_id, r.text) for r in odd.collect()], [], percent=60)


def test_ranks_over_many_ranges_and_ties(spark, rng):
    """One id holds a third of all rows, so that a third of the scores are equal."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    out = resampling.resample(docs.repartition(16), docs.limit(3), percent=50)
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in out.where("rank IS NOT NULL").collect())
    assert [d[0] for d in drawn] == list(range(1, 1501))
    assert [d[1:] for d in drawn] == sorted((-r.score, r.doc_id) for r in out.collect())[:1500]


def test_targeted_texts_are_drawn(spark, rng):
    """Documents in the words of the target are drawn far more often than others."""
    rows = [(i, " ".join(f"{'aim' if i % 10 == 0 else 'w'}{rng.randrange(50)}" for _ in range(40))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = resampling.resample(docs, docs.where("doc_id % 10 = 0").limit(20))
    assert out.where("rank IS NOT NULL AND doc_id % 10 = 0").count() > 80


def test_slices_of_a_column(rng):
    texts = ["Ünï " * rng.randrange(30) + "Wörds É" for _ in range(300)] + [None]
    column = pa.array(texts)
    for at, n in ((0, 301), (100, 150), (250, 51), (300, 1), (0, 0)):
        (text, bucket), = resampling.features(column.slice(at, n), 1, 10_000)
        want = [(i, zlib.crc32(w.encode()) % 10_000) for i, t in enumerate(texts[at:at + n]) for w in words(t)]
        assert list(zip(text.tolist(), bucket.tolist())) == want
