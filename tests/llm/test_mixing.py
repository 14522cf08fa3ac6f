import pytest
from pyspark.sql import functions as F

from driftflow.llm import mixing


def sized(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, doc_id long, source string, size long")


def targets(sizes, weights, share, most):
    """Deal the share out by weight, again and again, as its words say."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if target[s] < most * sizes[s]]
        whole, extra = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / whole
            over = target[s] - most * sizes[s]
            if over > 0:
                target[s], extra = float(most * sizes[s]), extra + over
        left = extra
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 20, None: 400}, {"a": 1, "b": 90000}])
def test_targets_are_the_reshared_ones(spark, sizes):
    docs = sized(spark, [(1, s, n) for s, n in sizes.items()])
    got = mixing.with_targets(mixing.weighted(mixing.source_sizes(docs), [3, 1, 2]), 1.5, 2)
    want = targets(sizes, [3, 1, 2], 1.5, 2)
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def test_schedule_ranks_its_slots_and_keeps_the_shares(spark):
    sources = spark.createDataFrame([("a", 600.0), ("b", 300.0), (None, 100.0), ("c", 0.0)], "source string, target double")
    slots = mixing.schedule(sources, 5000).collect()
    assert sorted(r.slot for r in slots) == list(range(5000))
    ranks = {}
    for r in sorted(slots, key=lambda r: r.slot):
        assert r.rank == ranks.get(r.source, 0)
        ranks[r.source] = r.rank + 1
        if r.slot in (99, 999, 4999):  # every beginning of the mix holds the sources in their shares
            assert abs(ranks["a"] - 0.6 * (r.slot + 1)) < 8
    assert "c" not in ranks


def test_a_source_that_no_point_hits_gets_a_slot(spark):
    sources = spark.createDataFrame([("a", 1e9), ("b", 1.0)], "source string, target double")
    assert mixing.schedule(sources, 4).where("source = 'b'").count() == 1


def test_pieces_add_up_and_meet_their_slots(spark, rng):
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 90)) for i in range(300)]
    docs = sized(spark, rows)
    sources, pieces = mixing.mix(docs, [3, 1, 2], block_words=64)
    target = {r.source: r.target for r in sources.collect()}
    size = {i: n for i, _, n in rows}
    found = pieces.collect()
    took, parts = {}, {}
    for p in found:
        took[p.source] = took.get(p.source, 0) + p.piece_words
        parts.setdefault((p.doc_id, p.epoch), []).append((p.piece_from, p.piece_from + p.piece_words))
    assert took == {s: int(t) for s, t in target.items()}
    for (doc, _), spans in parts.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= size[doc]
    order = sorted(found, key=lambda p: (p.source or "~", p.at))
    assert all(a.slot <= b.slot for a, b in zip(order, order[1:]) if a.source == b.source)
    taken = mixing.taken(docs, sources, pieces).collect()
    assert len(taken) == 300 and all(r.taken <= 2 * r.size for r in taken)


def test_odd_rows(clashing, nothing):
    docs = mixing.sized(clashing)
    sources, pieces = mixing.mix(docs, [3, 1, 2])
    out = mixing.taken(docs, sources, pieces)
    assert out.count() == clashing.count()
    assert out.where("size = 0 AND taken != 0").count() == 0
    again = mixing.taken(docs, *mixing.mix(docs, [3, 1, 2]))
    assert out.exceptAll(again).count() == 0
    docs = mixing.sized(nothing)
    assert mixing.taken(docs, *mixing.mix(docs, [3, 1, 2])).count() == 0


def test_sources_without_words(spark):
    docs = sized(spark, [(1, "a", 0), (2, None, 0)])
    sources, pieces = mixing.mix(docs, [3, 1, 2])
    assert pieces.count() == 0 and mixing.taken(docs, sources, pieces).agg(F.sum("taken")).first()[0] == 0
