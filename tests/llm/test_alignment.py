"""Cross-tokenizer alignment next to a definition in plain Python."""

import hashlib
import os
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from driftflow.llm import alignment as al

A, B = f"{al.FOLDER}/{al.FILE_A}", f"{al.FOLDER}/{al.FILE_B}"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="the vocabularies are not here")


def plain_tokens(text):
    """Both sides by the libraries alone: ids with their bytes."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = plain_tokens.__dict__.setdefault("kept", (Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)))
    a.encode_special_tokens = True
    chars = al.byte_of_char()
    one = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
           for i in b.encode(text)]
    want = b" " + text.encode()
    return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(docs):
    made, corpus = [], Counter()
    for i, text in docs:
        one, two = map(spans, plain_tokens(text) if text else ([], []))
        links = [(x[0], y[0]) for x in one for y in two if x[1] < y[2] and y[1] < x[2]]
        corpus.update(set(links))
        cuts = sorted({x[2] for x in one} & {y[2] for y in two})
        groups = [[[str(t[0]) for t in side if a < t[2] <= b] for side in (one, two)] for a, b in zip([0, *cuts], cuts)]
        said = ";".join("|".join(map(",".join, g)) for g in groups)
        made.append((i, len(one), len(two), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    best = {}
    for (a, _), n in corpus.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, a, b, g, len(links), sum(corpus[x] == best[x[0]] for x in links), sum(corpus[x] for x in links), d)
                   for i, a, b, g, links, d in made), key=str)


TEXTS = [
    "<|endoftext|> <s> </s> <unk> <0x41> <0x0A>", " leading", "trailing  ", "   ", " ", "a", "\n", "\t\n x \n\n  y", "mark ▁ here",
    "日本語のテキスト。漢字", "Ünï çödé 🙂🙂 wörds", "nul \x00 and \x1f\x85​   blanks", "ﬁ ① Å Ａ", "it's we'll 1234 --!!",
    "a" * 500, "x  y   z    w", "́combining é", "don’t “quote” — dash…",
]


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def short(spark, odd):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 3000 else r.text[:3000]) for r in odd.collect()]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_segments_are_cut_as_in_the_whole_text():
    cut = al.cutter(A, B)
    assert cut.apart
    rng = random.Random(3)
    letters = "abcdeXYZ éßñ  \n\t\r.,'-1290 \u0085\u00a0ſ日あ🙂"
    plain = letters[:letters.index("\u0085")]
    texts = TEXTS + ["".join(rng.choice(x) for _ in range(rng.randrange(1, 60))) for x in (letters, plain, plain) for _ in range(2000)]
    cuts = {t: cut.segments(t) for t in texts if al._MARK not in t}
    order, wrong, sides = cut.cut(list(dict.fromkeys(s for x in cuts.values() for s in x)))
    assert not wrong and cut.fast is not None and sum(len(x) > 1 for x in cuts.values()) > 2000
    ends = [np.cumsum(n) for _, n in sides]
    ids = {s: [x[e[i] - n[i]:e[i]].tolist() for (x, n), e in zip(sides, ends)] for i, s in enumerate(order)}
    for text, segments in cuts.items():
        assert [i for s in segments for i in ids[s][0]] == cut.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for s in segments for i in ids[s][1]] == cut.b.encode(text), repr(text)


@pytest.mark.parametrize("settings", [{}, {"most_sent": 0}, {"most_sent": 0, "blocks": 3, "rows_per_task": 20}, {"blocks": 2, "rows_per_task": 5}])
def test_equals_the_definition(spark, short, settings):
    want = brute([(r.doc_id, r.text) for r in short.collect()])
    assert told(al.align(short, **settings)) == want


def test_clashing_columns_and_empty_tables(spark, odd, clashing, nothing):
    assert told(al.align(clashing, blocks=4)) == told(al.align(odd, blocks=4, most_sent=0))
    assert told(al.align(nothing, blocks=4)) == told(al.align(nothing, blocks=4, most_sent=0)) == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = rng.choice(1 << 40, n, replace=False)
        made = al.PerfectHash.of(keys)
        assert sorted(made.slots(keys)) == list(range(n))
        others = rng.choice(1 << 40, 100)
        assert (made.slots(others) < max(n, 1)).all()


def cut_rows(texts):
    """The rows of the first pass, made here."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return list(al._cut_chunks(A, B)(iter([batch])))


def test_small_slices_and_rows_say_the_same(monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + [None, ""] + ["".join(rng.choice("abcdeXY éß  \n.,'-129あ🙂") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    look, best = SimpleNamespace(value=lambda pair: pair % 97), SimpleNamespace(value=np.full(len(al.cutter(A, B).lengths[0]), 5))

    def made():
        rows = cut_rows(texts)
        pairs = [dict(zip(r.column("pairs")[0].as_py(), r.column("docs")[0].as_py())) for r in rows]
        out = [x for b in al._results(A, B, best, look)(iter(rows)) for x in b.to_pylist()]
        return [r.column("behind")[0].as_py() for r in rows], [x for x in pairs if x], out

    behind, pairs, want = made()
    assert behind == [0] and len(pairs) == 1 and sum(x["n_links"] > 0 for x in want) > 300
    monkeypatch.setattr(al, "_SLICE", 40)
    monkeypatch.setattr(al, "_PIECE", 30)
    behind, found, out = made()
    assert len(behind) > 10 and behind == list(range(len(behind)))[::-1]
    assert out == want and found == pairs


def test_what_the_first_pass_holds_is_bounded():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(120_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(1400)]
    al.cutter(A, B)
    tracemalloc.start()
    most = 0
    for row in al._cut_chunks(A, B)(iter([pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])])):
        most = max(most, row.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20 and peak < 80 << 20, (most, peak)
