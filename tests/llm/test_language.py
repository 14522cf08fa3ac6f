import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftflow.llm import language
from driftflow.llm.language import LanguageId

SYLLABLES = {
    "en": "th er on an re he in ed nd ha of and the".split(), "de": "en er ch ei te der die ung sch ver zu".split(),
    "fr": "es ai ou eu é ê que les ion tre de la".split(), "es": "os as ar ie que ción ñ do el la de".split(),
}


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return LanguageId.fit(spark.createDataFrame(sample(400, 1), "doc_id long, text string, lang string"))


def told(frame, model):
    said = frame.select("doc_id", "text", model.predict(F.col("text")).alias("told"))
    return said.select("doc_id", "text", F.col("told.lang").alias("guess"), "told.score", "told.familiar")


def test_languages_not_seen_before(spark, model):
    rows = sample(200, 2)
    out = told(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert sum(r.guess == truth[r.doc_id] for r in out) >= 190
    assert all(0 <= r.score <= 1 for r in out)


def test_families_come_first(model):
    assert model.languages == ["de", "en", "es", "fr"]
    assert [[model.languages[i] for i in m] for m in model.families] == [["de", "en"], ["es", "fr"]]
    assert set(model.pairs) == {(0, 1), (2, 3)}


def test_only_the_text_counts(spark, model):
    texts = pa.array([t for _, t, _ in sample(30, 3)])
    whole = language.profiles(texts)
    for k in range(0, 30, 5):
        assert (language.profiles(texts.slice(k, 1))[0] == whole[k]).all()


def test_odd_rows(odd, clashing, nothing, model):
    out = {(r.doc_id, r.text): r for r in told(clashing, model).collect()}
    assert len(out) == odd.select("doc_id", "text").distinct().count()
    for (_, text), r in out.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r.guess, r.score) == (language.UNKNOWN, 0.0)
        else:
            assert r.guess in model.languages
    assert told(nothing, model).count() == 0
    empty = LanguageId.fit(nothing)
    assert {r.guess for r in told(odd, empty).collect()} == {language.UNKNOWN}
    single = LanguageId.fit(odd.where("lang = 'en'"))
    assert {r.guess for r in told(odd.where("doc_id = 1"), single).collect()} == {"en"}


def test_an_unlisted_language_is_its_own_family(spark):
    rows = sample(200, 4) + [(1000 + i, "zqx wvk jjy " * 10 + str(i) + "zz" * (i % 7), "xx") for i in range(30)]
    model = LanguageId.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [model.languages[m[0]] for m in model.families if len(m) == 1] == ["xx"]


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", language.held_out(F.col("doc_id"), 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in [*range(50), None]}


def test_every_language_is_learned(spark):
    """More languages than any list has, each with words of its own; one text of them a third of all rows."""
    rows = [(f"l{i:03d}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'aeiou'[k % 5]}x{k % 3}" for k in range(j, j + 12)))
            for i in range(260) for j in range(3)]
    rows += [rows[0]] * 400
    model = language.LanguageId.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert len(model.languages) == 260 and len(model.families) == 260


def plain_runs(text):
    """Hash of every run of 1 to 3 characters that does not lie in blanks only, by its definition."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    out = {1: [], 2: [], 3: []}
    for at in range(len(codes)):
        mixed = 0
        for size in (1, 2, 3):
            if at + size > len(codes):
                break
            mixed = ((mixed + codes[at + size - 1] * int(language._FACTORS[size - 1])) % 2**32 * 0x27D4EB2F) % 2**32
            mixed ^= mixed >> 15
            if any(c != 32 for c in codes[at:at + size]):
                out[size].append(mixed)
    return out


def plain_guess(model, text):
    """Family machines, then a vote of every two languages, with plain loops."""
    runs = plain_runs(text)
    counts = [0.0] * language.SLOTS
    for size in (1, 2, 3):
        for mixed in runs[size]:
            counts[mixed >> 20] += 1
    norm = sum(counts) ** 0.5
    x = [c ** 0.5 / norm for c in counts] + [1.0]

    def power(w):
        return sum(a * float(b) for a, b in zip(x, w) if a)

    chosen = max(range(len(model.families)), key=lambda f: power(model.family[f]))
    members = model.families[chosen]
    votes = {m: 0.0 for m in members}
    for i, a in enumerate(members):
        for b in members[i + 1:]:
            votes[a if power(model.pairs[a, b]) >= 0 else b] += 1
    best = max(members, key=lambda m: votes[m])
    slots = [mixed >> 32 - language.RUN_BITS for mixed in runs[3]]
    seen = sum(int(model.known[best][slot >> 5]) >> (slot & 31) & 1 for slot in slots)
    return model.languages[best], (seen + language.BENEFIT) / (len(slots) + language.BENEFIT)


def test_predictions_are_those_of_plain_loops(spark, model):
    rows = [*sample(60, 7), (100, "x", None), (101, "Straße 12, ÉTÉ!", None), (102, "zz " * 40, None)]
    out = {r.doc_id: r for r in told(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in rows:
        guess, familiar = plain_guess(model, text)
        assert (out[i].guess, out[i].familiar) == (guess, pytest.approx(familiar, abs=1e-12)), text


def test_known_runs_are_those_of_the_texts_learned_from(spark):
    rows = sample(80, 8)
    model = LanguageId.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for i, code in enumerate(model.languages):
        want = {mixed >> 32 - language.RUN_BITS for _, text, lang in rows if lang == code for mixed in plain_runs(text)[3]}
        got = {32 * w + b for w, bits in enumerate(model.known[i].tolist()) for b in range(32) if bits >> b & 1}
        assert got == want


def test_foreign_texts_and_noise_are_not_familiar(spark, model):
    import corpus_pipeline

    foreign = ["W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie", "zzz qqq xkcd vvv jjq",
               "日本語の文章はここにあります", "Мама мыла раму, а папа читал газету"]
    clean = [(i, t, lang) for i, t, lang in sample(200, 9)]
    short = [(1000 + i, " ".join(t.split()[:3]), lang) for i, t, lang in clean]
    rows = clean + short + [(5000 + i, t, None) for i, t in enumerate(foreign)] + [(6000, None, "en"), (6001, "12 -- !", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.familiar for r in told(docs, model).collect()}
    assert min(out[i] for i, _, _ in clean + short) >= corpus_pipeline.LEAST_FAMILIAR > max(out[5000 + i] for i in range(len(foreign)))
    learned = sample(400, 1)
    kept = corpus_pipeline.language(spark, docs.unionByName(
        spark.createDataFrame([(10_000 + i, t, lang) for i, t, lang in learned], docs.schema)), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in clean + short} | {10_000 + i for i, _, _ in learned}
