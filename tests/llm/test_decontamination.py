import random

import numpy as np
import pyarrow as pa

from driftflow.llm import decontamination


def plain_alignment(a, b):
    """Smith-Waterman by its definition."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[j - 1] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_against_its_definition():
    rng = random.Random(1)
    a = [[rng.randrange(4) + 10 for _ in range(rng.randrange(0, 12))] for _ in range(200)]
    b = [[rng.randrange(4) + 10 for _ in range(rng.randrange(0, 15))] for _ in range(200)]
    got = decontamination.align(pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())))
    assert got.tolist() == [plain_alignment(x, y) for x, y in zip(a, b)]


def corpus(rng):
    items = [[f"q{rng.randrange(4000)}" for _ in range(rng.randrange(12, 50))] for _ in range(20)]
    docs, planted = [], set()
    for n in range(150):
        words = [f"q{rng.randrange(4000)}" for _ in range(rng.randrange(0, 300))]
        if n % 3 == 0:
            i = rng.randrange(20)
            copy = list(items[i])
            for _ in range(len(copy) // 7):  # edits: replaced, dropped or inserted words
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(2)] = [f"z{rng.randrange(9)}"] * rng.randrange(2)
            spot = rng.randrange(len(words) + 1)
            words[spot:spot] = copy
            planted.add((n, i))
        docs.append((n, rng.choice([" ", ", ", "\n"]).join(words).title()))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], planted


def test_edited_copies_are_found_and_nothing_else(spark, rng):
    docs, items, planted = corpus(rng)
    found = decontamination.found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted


def test_scores_are_those_of_the_whole_text(spark, rng):
    docs, items, planted = corpus(rng)
    words = dict((i, t.replace(",", " ").lower().split()) for i, t in docs), dict((i, t.split()) for i, t in items)
    found = decontamination.found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found[:25]:
        item = words[1][r.item_id]
        assert r.score == plain_alignment(item, words[0][r.doc_id]) / (2 * len(item))


def test_an_item_in_most_texts_is_still_found(spark, rng):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(n, f"{n} {n + 1} {item} {n}") for n in range(200)] + [(300, "clean text of no item")]
    found = decontamination.found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, " -- ")], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(200))


def test_odd_rows(spark, odd, clashing, nothing):
    body = odd.where("doc_id = 1").first().text
    items = spark.createDataFrame([(1, body[:150]), (None, body[150:]), (4, ""), (5, None)], "item_id long, text string")
    got = decontamination.found_in(clashing, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d in (1, 2, 3, None) for i in (1, None)}
    assert decontamination.found_in(nothing, items).count() == 0
    assert decontamination.found_in(odd, items.where("false")).count() == 0
    assert np.isfinite([r.score for r in got.collect()]).all()


def test_items_shorter_than_a_seed_are_found_whole(spark):
    items = [(1, "Xylo"), (2, "two words"), (3, "three of them"), (4, None), (5, "...")]
    docs = [(1, "a xylo here"), (2, "two other words"), (3, "Two, words!"), (4, "xylophone two"), (5, "so three of them two words"),
            (6, "words two"), (7, "xylo"), (8, None), (9, "")]
    found = decontamination.found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.score) for r in found.collect()} == {(1, 1, 1.0), (7, 1, 1.0), (3, 2, 1.0), (5, 2, 1.0), (5, 3, 1.0)}


def test_items_in_a_script_without_blanks(spark, rng):
    def han(n):
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    item, other = han(40), han(40)
    edited = item[:10] + "文" + item[11:20] + item[22:]
    docs = [(1, han(100) + item + han(50)), (2, han(30) + edited + han(30)), (3, han(200)), (4, "x" + other + "y ไทย"), (5, item[:10] + han(90))]
    found = decontamination.found_in(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame([(1, item), (2, other)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (4, 2)}


def test_a_very_long_item_is_aligned_in_pieces_of_bounded_size(spark, rng, monkeypatch):
    sizes, plain = [], decontamination.align
    monkeypatch.setattr(decontamination, "align", lambda a, b: sizes.append((len(a), len(a) * (
        a.value_lengths().to_numpy().max() + b.value_lengths().to_numpy().max()))) or plain(a, b))
    lengths = [2, 3, 3000, 5, 900, 1, *[7] * 5000]
    words = [list(range(i, i + n)) for i, n in enumerate(lengths)]
    rows = pa.RecordBatch.from_pydict({
        "th": list(range(len(words))), "size": [1] * len(words), "item_id": list(range(len(words))), "low": [0] * len(words),
        "words": words, "passage": [w + [-1] for w in words]})
    monkeypatch.setattr(decontamination, "_SCORING_WORDS", 5000)
    out = [r for b in decontamination._scores(iter([rows])) for r in b.to_pylist()]
    assert sorted(r["th"] for r in out) == list(range(len(words))) and all(r["score"] == 1 for r in out)
    assert max(w for n, w in sizes if n > 1) <= 2 * 5000
