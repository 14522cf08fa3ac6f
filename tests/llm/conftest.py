import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves, of types they don't expect.
CLASHES = "row string, th string, ord string, size string, part string, mix string, bucket string, words string"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, copies and near copies."""
    rng = random.Random(5)
    body = sentence(rng, 60)
    near = body.replace(body.split()[7], "other", 1)
    long = "\n".join(sentence(rng, 50, 5000) for _ in range(300))
    rows = [
        (1, body, "en", "a"), (2, body, "en", "a"), (3, near, "en", "b"), (3, near, "en", "b"), (4, None, "en", "a"),
        (5, "", "de", None), (6, " \n\t ", None, "b"), (7, "be " * 60, "de", "b"), (8, "be " * 45 + "so", "de", "b"),
        (9, long, "en", "c"), (10, "Ünï çödé 🙂 wörds " * 20, None, None), (None, body, None, None), (None, None, None, None),
        (None, sentence(rng, 30), "en", "a"), (11, "one", "en", "a"), (12, "one", "en", "a"), (13, "12 34 -- !!", "en", "a"),
        (14, "one line\nand two\nand three", "en", "c"), (15, "zero\none line\nand two\nand three\nand two\nand three", "de", "c"),
        (16, sentence(rng, 20) + " " + " ".join(long.split()[100:130]), "en", "a"), (3, sentence(rng, 25), "fr", "b"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns of clashing names."""
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return odd.selectExpr("*", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def rng():
    return random.Random(11)
