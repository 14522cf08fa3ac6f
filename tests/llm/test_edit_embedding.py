import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftflow.llm import arrays, edit_embedding


def brute(text):
    """The walk by its definition, one step at a time."""
    bits, at, path, codes = edit_embedding._bits(), 0, [], [ord(c) for c in text]
    for step in range(max(1, 2 * len(text))):
        path.append(at)
        if at < len(text):
            at += int(bits[step % edit_embedding.PERIOD * 256 + (codes[at] * 0x9E3779B1 % (1 << 32) >> 24)])
    out = b""
    for record in edit_embedding._records():
        place, name = path[[s for s in record.tolist() if s < len(path)][-1]], 0
        for k in range(edit_embedding.CONTEXT):
            name = (name * 0x100000001B3 + (codes[place + k] + 1 if place + k < len(text) else 0)) % (1 << 64)
        out += edit_embedding._LETTERS[int(arrays.mix(np.array([name], np.uint64))[0] >> np.uint64(58))].tobytes()
    return out.decode()


def test_walks_in_step_are_the_walks_by_definition():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé 🙂\n") for _ in range(n)) for n in [0, 0, 1, 2, 3, 50, 400, 5000, *range(0, 300, 7)]]
    assert edit_embedding.fingerprints(texts) == [brute(t) for t in texts]
    assert edit_embedding.fingerprints([]) == []


def test_likeness_falls_with_the_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klm") for _ in range(4000))
    few = text[:2000] + "x" + text[2001:3000] + text[3001:]
    half = text[:2000] + "".join(rng.choice("abcdefghij klm") for _ in range(2000))
    other = "".join(rng.choice("abcdefghij klm") for _ in range(4000))
    a, *rest = edit_embedding.fingerprints([text, few, half, other])
    near = [edit_embedding.likeness(a, b) for b in rest]
    assert near[0] > 0.8 and 0.35 < near[1] < 0.65 and near[2] < 0.1


def check(frame, out):
    order = sorted(((r.doc_id is None, r.doc_id or 0, r.th, r.text or "") for r in frame.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()))
    want = []
    for k, (null, key, _, text) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        cut = len(text) // 2
        edited = text[:len(text) - cut] + following[:cut]
        a, b, c = edit_embedding.fingerprints([text, edited, following])
        want.append((None if null else key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                     edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_next_documents_across_ranges(spark, rng):
    docs = [(rng.randrange(10**6), "".join(rng.choice("ab c") for _ in range(rng.randrange(80)))) for _ in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 2, 7, 200):
        check(frame, edit_embedding.edited_likeness(frame, parts))


def test_odd_rows(odd, clashing, nothing):
    check(odd, edit_embedding.edited_likeness(clashing, 3))
    assert edit_embedding.edited_likeness(nothing).count() == 0
    one = odd.where("doc_id = 1")
    check(one, edit_embedding.edited_likeness(one, 4))


def test_similar_pairs_are_verified(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:450] + "#" + t[451:]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", edit_embedding.fingerprint(F.col("text")))
    pairs = {(r.first_id, r.doc_id): r.likeness for r in edit_embedding.similar_pairs(frame, 0.6).collect()}
    assert {(i, 100 + i) for i in range(20)} >= set(pairs) and len(pairs) > 15
    prints = {r.doc_id: r.fingerprint for r in frame.collect()}
    assert all(abs(edit_embedding.likeness(prints[a], prints[b]) - x) < 1e-9 for (a, b), x in pairs.items())
    assert pa.types.is_string(frame.select("fingerprint").toArrow().schema.field(0).type)
