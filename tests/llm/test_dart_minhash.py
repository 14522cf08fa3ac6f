import random

import numpy as np
import pyarrow as pa

from driftflow.llm import arrays, dart_minhash, groups


def sets_of(docs, size=5):
    split = [(t or "").split() for _, t in docs]
    return [frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset() for w in split], split


def brute(docs, similar=0.8):
    """Least id of the class of each row, by comparing all pairs."""
    sets, split = sets_of(docs)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if split[i] == split[j] or (both and both >= similar * len(sets[i] | sets[j]) - 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, least.get(find(i))) for i, (key, _) in enumerate(docs)), key=repr)


def told(out):
    return sorted(((r.doc_id, r.class_id) for r in out.collect()), key=repr)


def test_classes_against_brute_force(spark):
    rng = random.Random(2)
    docs, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 150))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append((n, " ".join(copy)))
            n += 1
    assert told(dart_minhash.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_buckets_of_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for n in range(60):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        docs.append((n, " ".join(copy)))
    assert told(dart_minhash.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = int(400 * share)
        agree = []
        for _ in range(30):
            items = rng.integers(0, 1 << 47, 400 + 400 - both).astype(np.uint64)
            text = np.concatenate([np.zeros(400, np.int64), np.ones(400, np.int64)])
            sig = dart_minhash.darts(text, np.concatenate([items[:400], items[400 - both:]]), 2)
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - both / (800 - both)) < 0.04


def test_counted_weights_see_how_often_a_shingle_occurs():
    texts = pa.array(["a b c d e " * 20, "a b c d e " * 10, "a b c d e " * 10])
    words = arrays.Words(texts)
    text, element = dart_minhash.elements(words, words.hashes(), 5, counted=True)
    sig = dart_minhash.darts(text, element, 3)
    assert (sig[1] == sig[2]).all() and 0.3 < (sig[0] == sig[1]).mean() < 0.65
    text, element = dart_minhash.elements(words, words.hashes(), 5)
    sig = dart_minhash.darts(text, element, 3)
    assert (sig[0] == sig[1]).all()


def test_short_and_empty_texts():
    words = arrays.Words(pa.array(["", "a", "a b c d", "a b c d e"]))
    text, element = dart_minhash.elements(words, words.hashes(), 5)
    assert text.tolist() == [1, 2, 3] and len(set(element.tolist())) == 3
    sig = dart_minhash.darts(text, element, 4)
    assert (sig[0] == 0).all() and (sig[1:] != 0).all()


def test_odd_rows(odd, clashing, nothing):
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    out = dart_minhash.dedup(clashing)
    assert told(out) == brute(plain)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len({(r.class_id, r.doc_id if r.class_id is None else 0, r.row if r.class_id is None else 0) for r in kept})
    assert out.groupBy("class_id").count().count() <= len(kept)
    assert dart_minhash.dedup(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in groups.components(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert groups.components(links.where("false")).count() == 0
