import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftflow.llm import tree_weighting as tree
from driftflow.llm.language import held_out


def kt(zeros, ones):
    """Sequential estimate: any order gives the same product."""
    p, a, b = 0.0, 0, 0
    for _ in range(zeros):
        p, a = p + math.log((a + 0.5) / (a + b + 1)), a + 1
    for _ in range(ones):
        p, b = p + math.log((b + 0.5) / (a + b + 1)), b + 1
    return p


def bits(symbol):
    return [(1 << k) + (symbol >> 8 - k) for k in range(8)], [symbol >> 7 - k & 1 for k in range(8)]


def grams(texts, depth):
    """Counter of (context, symbol) over the padded texts."""
    out = Counter()
    for text in texts:
        data = bytes([tree.START] * depth) + text.lower().encode() + bytes([tree.END])
        for i in range(depth, len(data)):
            out[data[i - depth:i], data[i]] += 1
    return out


class Plain:
    """The mixture by recursion over whole context trees, one for each binary node; every context kept."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for (context, symbol), n in grams(texts, depth).items():
            for node, bit in zip(*bits(symbol)):
                for d in range(depth + 1):
                    self.counts.setdefault((node, context[depth - d:]), [0, 0])[bit] += n

    def weighted(self, node, context):
        """Log probability of what followed the context, and the probability of a 1 for a path, by depth."""
        zeros, ones = self.counts.get((node, context), (0, 0))
        own = kt(zeros, ones)
        if len(context) == self.depth:
            return own
        below = sum(self.weighted(node, c) for n, c in self.counts if n == node and len(c) == len(context) + 1 and c.endswith(context))
        return np.logaddexp(own, below) - math.log(2)

    def one(self, node, path, d=0):
        context = path[len(path) - d:]
        zeros, ones = self.counts.get((node, context), (0, 0))
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return own
        stop = math.exp(kt(zeros, ones) - math.log(2) - self.weighted(node, context))
        return stop * own + (1 - stop) * self.one(node, path, d + 1)

    def log(self, path, symbol):
        total = 0.0
        for node, bit in zip(*bits(symbol)):
            p = self.one(node, path)
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.mark.parametrize("depth", [1, 2])
def test_model_against_the_recursion(spark, depth):
    texts = ["abab abba", "Ab", "", "cé"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = tree.count(frame, depth).where(F.col("kind") == tree.GRAM).select("key", "n")
    model, plain = tree.TreeModel.fit(counts, depth), Plain(texts, depth)
    seen = [(c, s) for c, s in grams(texts, depth)]
    for context, symbol in seen + [(context, 122) for context, _ in seen]:
        state = 0
        for k in range(1, depth + 1):
            goal = model.ways[state * 256 + context[-k]]
            state = goal if goal >= 0 else state
        assert model.logs[state * 256 + symbol] == pytest.approx(plain.log(context, symbol), abs=1e-5)
    for text in texts:
        data = bytes([tree.START] * depth) + text.lower().encode() + bytes([tree.END])
        want = sum(plain.log(data[i - depth:i], data[i]) for i in range(depth, len(data)))
        assert model.score(pa.array([text, "x"]))[0] == pytest.approx(want, abs=1e-4)


def test_probabilities_add_up_whatever_is_kept(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([("".join(rng.choice("abc d") for _ in range(300)),) for _ in range(5)], "text string")
    counts = tree.count(frame, 3).where(F.col("kind") == tree.GRAM).select("key", "n")
    for most in (1, 4, 40, 10_000):
        model = tree.TreeModel.fit(counts, 3, most)
        table = model.logs.reshape(-1, 256)
        assert len(table) <= most
        assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 8, 100.5, 1e9])
    assert np.allclose(tree._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def check_tokens(rows, out):
    words = {k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split() for k, (_, t) in enumerate(rows)}
    out_of = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for k, held in enumerate(out_of) if not held for w in words[k])
    ends = out_of.count(False)
    n, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for k, (i, _) in enumerate(rows):
        c = [counts[w] for w in words[k]] + [ends]
        want.append((i, out_of[k], len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + distinct + 1)) for x in c), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_tokens_and_base(spark, odd, clashing, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for frequent in (tree.FREQUENT, 4):
        monkeypatch.setattr(tree, "FREQUENT", frequent)
        check_tokens(rows, tree.score(clashing.withColumn("held_out", held_out(F.col("doc_id"), 7, 2)), contexts=500))
    assert tree.score(nothing.withColumn("held_out", F.lit(False))).count() == 0
    all_out = tree.score(odd.withColumn("held_out", F.lit(True))).collect()
    assert len(all_out) == len(rows) and {r.train_tokens for r in all_out} == {0} and {r.n_known for r in all_out} == {0}


def test_what_was_learned_scores_better_than_noise(spark):
    rng = random.Random(8)
    text = [" ".join(rng.choice(["the", "of", "rend", "oner", "thes", "and"]) for _ in range(60)) for _ in range(60)]
    noise = ["".join(rng.choice("abcdefghij ") for _ in range(len(t))) for t in text[:20]]
    rows = [(i, t, i < 20) for i, t in enumerate(text)] + [(100 + i, t, True) for i, t in enumerate(noise)]
    out = tree.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).toPandas()
    held = out[out.held_out & (out.doc_id < 100)]
    assert held.score.mean() > out[out.doc_id >= 100].score.mean() / 3
    assert -held.score.sum() / sum(len(t) + 1 for t in text[:20]) < 0.35


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_scores_against_the_recursion(spark, depth, monkeypatch):
    learned, others = ["abab abba", "Ab", "", "cé"], ["abac", "zé x", "abab"]
    rows = [(i, t, False) for i, t in enumerate(learned)] + [(10 + i, t, True) for i, t in enumerate(others)]
    frame, plain = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), Plain(learned, depth)
    for frequent in (1, 20, 1 << 20):  # no run, some and all of them in the table
        monkeypatch.setattr(tree, "FREQUENT_RUNS", frequent)
        got = {r.doc_id: r.score for r in tree.score(frame, depth).collect()}
        for i, text, _ in rows:
            data = bytes([tree.START] * depth) + text.lower().encode() + bytes([tree.END])
            want = sum(plain.log(data[k - depth:k], data[k]) for k in range(depth, len(data)))
            assert got[i] == pytest.approx(want, abs=1e-4)


def test_no_context_is_left_out(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(20)]
    frame = spark.createDataFrame([(i, t, i >= 18) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    counts = tree.count(frame.where("NOT held_out"), 3).where(F.col("kind") == tree.GRAM).select("key", "n")
    model = tree.TreeModel.fit(counts, 3, 1_000_000)
    assert len(model.logs) // 256 > 24_000
    monkeypatch.setattr(tree, "FREQUENT_RUNS", 10_000)
    monkeypatch.setattr(tree, "_RUNS", 500)
    got = {r.doc_id: r.score for r in tree.score(frame, 3).collect()}
    assert np.allclose([got[i] for i in range(20)], model.score(pa.array(texts)), rtol=1e-6)


def _column(rng):
    texts = ["".join(rng.choice("abAé ") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "a" * 100_000, ""]
    return pa.array(texts)


def test_counts_of_chunks_are_merged_before_they_are_handed_over(monkeypatch):
    rng = random.Random(5)
    column = _column(rng)
    for held in (tree._HELD, 300, 8):
        monkeypatch.setattr(tree, "_HELD", held)
        monkeypatch.setattr(tree, "_CHUNK", 500)
        out = list(tree._count(5)(iter([pa.RecordBatch.from_arrays([column], names=["text"])])))
        found = Counter()
        for batch in out:
            for row in batch.to_pylist():
                found[row["kind"], row["key"]] += row["n"]
        wanted = Counter((tree.GRAM, key) for key in tree._codes(column, 5)[0].tolist())
        words = tree.arrays.Words(column, tree.arrays.LOWER).hashes()
        wanted += Counter((tree.TOKEN, key) for key in tree.arrays.signed(words).tolist())
        assert found == wanted
        rows = sum(batch.num_rows for batch in out)
        assert rows == len(wanted) if held > 300 else rows >= len(wanted)


def test_runs_are_looked_up_by_blocks():
    rng = random.Random(6)
    column = _column(rng)
    code, first = tree._codes(column, 5)
    assert len(code) > tree._SORTED
    every = sorted(set(code.tolist()))
    for known in (every[::2], every, []):
        logs = [-rng.random() for _ in known]
        table = dict(zip(known, np.array(logs, np.float32).tolist()))
        each, hit = tree._looked_up(code, np.array(known, np.int64), np.array(logs, np.float32))
        assert each.tolist() == [table.get(c, 0.0) for c in code.tolist()] and hit.tolist() == [c in table for c in code.tolist()]
        added, keys, times, n = tree._added(column, 5, np.array(known, np.int64), np.array(logs, np.float32))
        assert np.array_equal(added, np.add.reduceat(each, first[:-1]))
        left = [Counter(c for c in code[a:b].tolist() if c not in table) for a, b in zip(first, first[1:])]
        assert list(zip(keys.tolist(), times.tolist())) == [x for part in left for x in sorted(part.items())]
        assert n.tolist() == [len(part) for part in left]
