import random

from pyspark.sql import functions as F

from driftflow.llm import line_dedup

LAST = (1 << 63) - 1


def brute(docs, run=2):
    """Kept text and numbers of lines of (doc_id, text) rows; equal rows count once."""
    def solid(text):
        return [(i, x.strip(" \t\r")) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]
    distinct = sorted({(LAST if i is None else i, t) for i, t in docs if t is not None})
    first = {}
    for key in distinct:
        lines = [x for _, x in solid(key[1])]
        for p in range(len(lines) - run + 1):
            first.setdefault(tuple(lines[p:p + run]), (key, p))
    out = []
    for i, text in docs:
        key, lines = (LAST if i is None else i, text), solid(text)
        gone = {p + k for p in range(len(lines) - run + 1) if first[tuple(x for _, x in lines[p:p + run])] != (key, p) for k in range(run)}
        drop = {lines[p][0] for p in gone}
        kept = text if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in drop)
        out.append((i, len(lines), len(gone), kept))
    return sorted(out, key=repr)


def rows(out):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in out.select("row.doc_id", "n_lines", "n_removed", "kept").collect()), key=repr)


def test_random_lines_against_brute_force(spark, rng):
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", " a ", "", "d", "e"]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    for run in (1, 2, 3):
        assert rows(line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), run)) == brute(docs, run)


def test_repeats_name_the_first_place(spark):
    docs = [(1, "x\na\nb\nc"), (2, "a\nb\nc\ny"), (3, "q\na\nb")]
    found = line_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.ord, r.low, r.high, r.ord0, r.low0) for r in found.collect()) == [(2, 0, 2, 1, 1), (3, 1, 2, 1, 1)]


def test_odd_rows(odd, clashing, nothing):
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    # Among equal ids the order is that of a hash; brute force orders by text, so leave the tied id out.
    some = [r for r in plain if r[0] != 3 and r[0] is not None]
    assert rows(line_dedup.dedup(odd.where("doc_id != 3"), long_line=None)) == brute(some)
    def trimmed(text):
        return "\n".join(x.strip(" \t\r") for x in text.split("\n") if x.strip(" \t\r"))
    told = {(i, n, gone, trimmed(kept)) for i, n, gone, kept in rows(line_dedup.dedup(odd.where("doc_id != 3 AND text IS NOT NULL")))}
    assert told == set(brute_long(some, line_dedup.LONG_LINE)) and (2, 1, 1, "") in told
    out = line_dedup.dedup(clashing)
    assert out.select("row.*").columns == clashing.columns and out.count() == odd.count()
    assert line_dedup.dedup(nothing).count() == 0
    assert out.where("row.text IS NULL").select(F.max(F.col("kept").isNotNull())).first()[0] is False


def test_a_line_repeated_very_often_stays_once(spark):
    out = line_dedup.dedup(spark.createDataFrame([(1, "\n".join(["same"] * 500))], "doc_id long, text string")).first()
    assert (out.n_lines, out.n_removed, out.kept) == (500, 499, "same")


def brute_long(docs, least):
    """``brute`` with two lines, and every line of more than ``least`` words a run by itself."""
    distinct = sorted({(LAST if i is None else i, t) for i, t in docs if t is not None})
    first, pairs = {}, {}
    places = {key: [x.strip(" \t\r") for x in key[1].split("\n") if x.strip(" \t\r")] for key in distinct}
    for key in distinct:
        for p, line in enumerate(places[key]):
            first.setdefault(line, (key, p))
            pairs.setdefault(tuple(places[key][p:p + 2]), (key, p))
    out = []
    for key in distinct:
        lines, gone = places[key], set()
        for p, line in enumerate(lines):
            if len(line.split()) > least and first[line] != (key, p):
                gone.add(p)
            if p + 1 < len(lines) and pairs[tuple(lines[p:p + 2])] != (key, p):
                gone |= {p, p + 1}
        out.append((key[0], len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return sorted(out, key=repr)


def test_long_lines_are_runs_by_themselves(spark, rng):
    kinds = ["a", "b", "c d", "e f g", "h i j k", "l m n o", "p q r s t"]
    docs = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (2, 3):
        assert rows(line_dedup.dedup(frame, long_line=least)) == brute_long(docs, least)


def test_the_pipeline_removes_a_long_line_with_other_neighbours(spark):
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(51))
    docs = [(1, f"one\n{line}\ntwo"), (2, f"three\n{line}\nfour"), (3, line), (4, "one"), (5, line.rsplit(" ", 1)[0]), (6, line.rsplit(" ", 1)[0])]
    out = corpus_pipeline.repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    want = dict(docs) | {2: "three\nfour"}
    del want[3]
    assert {r.doc_id: r.text for r in out.collect()} == want
