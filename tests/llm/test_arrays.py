import random
import re

import numpy as np
import pyarrow as pa

from driftflow.llm import arrays, bloom

TEXTS = ["", None, "  ", "a", " b  c\n", "x y z", "é ü\tñ\x0b\x0c q", "tail", "🙂 🙂🙂 end "]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_those_of_the_pattern():
    found = arrays.Words(pa.array(TEXTS))
    data = found.data.tobytes()
    for i, text in enumerate(TEXTS):
        own = [data[a:b].decode() for a, b in zip(found.start, found.end)][found.first[i]:found.first[i + 1]]
        assert own == words(text)


def test_words_of_a_slice():
    found = arrays.Words(pa.array(TEXTS).slice(3, 4))
    assert found.count.tolist() == [len(words(t)) for t in TEXTS[3:7]]


def test_hashes_tell_words_apart_and_do_not_depend_on_the_place():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(50)) for _ in range(40)]
    hashes = arrays.Words(pa.array(texts)).hashes()
    flat = [w for t in texts for w in words(t)]
    named = {}
    assert all(named.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist()))
    assert len(set(named.values())) == len(named)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = pa.array([" ".join(str(i * 7919) for i in range(2000))])
    whole = arrays.Words(text).hashes()
    grams = arrays.grams(whole, 5)
    monkeypatch.setattr(arrays, "_PIECE_BYTES", 64)
    assert (arrays.Words(text).hashes() == whole).all()
    assert (arrays.grams(whole, 5) == grams).all()


def test_grams_are_equal_for_equal_words_only():
    hashes = arrays.Words(pa.array(["a b c d e a b c x b c d"])).hashes()
    grams = arrays.grams(hashes, 3)
    assert grams[0] == grams[5] and grams[1] == grams[9] and len(set(grams.tolist())) == 8


def test_plain_words_ignore_case_and_marks():
    a = arrays.Words(pa.array(["Don't -- STOP, (now)!"]), arrays.PLAIN).hashes()
    b = arrays.Words(pa.array(["don t stop now"]), arrays.PLAIN).hashes()
    assert a.tolist() == b.tolist()


def test_chunks_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(TEXTS)], names=["id", "text"])
    parts = list(arrays.chunks(iter([batch, batch.slice(0, 0)]), limit=3))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(9))


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = arrays.mix(np.arange(5000, dtype=np.uint64))
    table = spark.createDataFrame([(int(k),) for k in keys[:2500].view(np.int64)], "k long")
    built = bloom.build(table, "k")
    assert bloom.contains(built.value, keys[:2500]).all()
    assert bloom.contains(built.value, keys[2500:]).sum() == 0
    assert table.where(bloom.passes(built, table.k)).count() == 2500
    assert not bloom.contains(bloom.build(table.where("false"), "k").value, keys).any()


def test_characters_of_scripts_without_blanks_are_words():
    texts = ["a日本b c", "日", "ไทย x", "é日é", "", "日本", "𠀀z", "plain words", " 日 ", "日a"]
    words = arrays.Words(pa.array(texts), unspaced=True)
    data = "".join(texts).encode()
    got = [[data[words.start[k]:words.end[k]].decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert got == [["a", "日", "本", "b", "c"], ["日"], ["ไ", "ท", "ย", "x"], ["é", "日", "é"], [], ["日", "本"], ["𠀀", "z"],
                   ["plain", "words"], ["日"], ["日", "a"]]
