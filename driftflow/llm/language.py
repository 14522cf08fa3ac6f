"""Language identification in two steps: the family, then the language within it.

A text is its letters in lower case, as hashed counts of runs of 1 to 3 characters (any
other character is a blank), square-rooted and scaled to length 1. Linear support vector
machines, one against the rest, choose the family; within it every two languages have a
machine of their own and the language of most votes wins.

The machines are fitted on at most about ``per_language`` texts of each language (chosen by
a hash of the text, equal texts once), so what the driver holds does not grow with the corpus.
Every language is learned; beyond ``SAMPLE / per_language`` of them each has fewer texts.

The machines choose among the languages they know, whatever the text. Whether it is in the chosen
one at all is told by ``familiar``: the share of the text's runs of 3 characters that the texts
learned from hold too. It depends neither on how many languages there are nor on the text's length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.llm.linear import sigmoid, support_vectors
from driftflow.session import settle

SLOTS = 4096
PER_LANGUAGE = 500
# Texts of all languages together, and of one at least.
SAMPLE = 100_000
LEAST_PER_LANGUAGE = 20
# Slots (as bits) for the runs of 3 characters of a language.
RUN_BITS = 16
BENEFIT = 4
UNKNOWN = "und"
# Languages that are not listed are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
_ROWS = 512
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return (codes >= 1 << 16) | _letters[0][np.minimum(codes, (1 << 16) - 1)]


def profiles(texts: pa.Array) -> np.ndarray:
    """Scaled character counts of each text (lower case), a row of ``SLOTS`` each."""
    return _looked_at(texts)[0]


def _looked_at(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``profiles``, and the runs of 3 characters: the number of the text of each, and its slot."""
    data, ends = arrays.text_bytes(texts)
    n = len(ends) - 1
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
    text = np.repeat(np.arange(n), np.diff(lead))
    solid = _is_letter(codes)
    codes = np.where(solid, codes, np.uint32(32))
    total = np.zeros(n * SLOTS)
    mixed = np.zeros(len(codes), np.uint32)
    lively = np.zeros(len(codes), bool)
    owner, slot = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    for size in (1, 2, 3):
        if len(codes) < size:
            break
        stop = len(codes) - size + 1
        mixed = (mixed[:stop] + codes[size - 1:] * _FACTORS[size - 1]) * np.uint32(0x27D4EB2F)
        mixed ^= mixed >> np.uint32(15)
        lively = lively[:stop] | solid[size - 1:]
        keep = lively & (text[:stop] == text[size - 1:])
        total += np.bincount(text[:stop][keep] * SLOTS + (mixed[keep] >> np.uint32(20)), minlength=n * SLOTS)
        if size == 3:
            owner, slot = text[:stop][keep], mixed[keep] >> np.uint32(32 - RUN_BITS)
    out = np.sqrt(total).reshape(n, SLOTS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), owner, slot


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in arrays.chunks(iter([batch])):
        for at in range(0, part.num_rows, _ROWS):
            yield part.column(0).slice(at, _ROWS)


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for texts in _pieces(batch.column("text")):
            x, owner, slot = _looked_at(texts)
            rows = [x.tobytes() for x in x.astype(np.float16)]
            held = np.unique(owner << RUN_BITS | slot)
            runs = arrays.lists(held & ((1 << RUN_BITS) - 1), np.bincount(held >> RUN_BITS, minlength=len(rows)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(done, len(rows)), pa.array(rows, pa.binary()), runs], names=["lang", "profile", "runs"])
            done += len(rows)


def has_letters(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def _runs_known(sample: DataFrame, languages: list[str]) -> np.ndarray:
    """Bits of the runs that the sample's texts hold, by language. What reaches the driver is at most
    ``1 << RUN_BITS - 5`` words a language."""
    spots = sample.select("lang", F.explode("runs").alias("slot"))
    words = spots.groupBy("lang", F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 31)")).alias("mask")).toArrow()
    out = np.zeros((len(languages), 1 << RUN_BITS - 5), np.uint32)
    number = {code: i for i, code in enumerate(languages)}
    rows = np.array([number[x] for x in words["lang"].to_pylist()], np.int64)
    out[rows, words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    return out


class LanguageId:
    """The fitted machines; small enough to be sent with every task."""

    def __init__(self, languages: list[str], families: list[list[int]], family: np.ndarray, pairs: dict, known: np.ndarray):
        """``known``: the runs of 3 characters of each language, a bit each, 32 in a word."""
        self.languages, self.families, self.family, self.pairs, self.known = languages, families, family, pairs, known

    @classmethod
    def fit(cls, docs: DataFrame, families: Mapping = FAMILIES, per_language: int = PER_LANGUAGE) -> LanguageId:
        """Learn from ``text`` and ``lang``; rows without a language or letters are left out."""
        usable = docs.select("text", F.col("lang").cast("string").alias("lang")).where(
            F.col("lang").isNotNull() & has_letters(F.col("text")))
        counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
        languages = sorted(counts)
        if not languages:
            return cls([], [], np.zeros((0, SLOTS + 1)), {}, np.zeros((0, 1 << RUN_BITS - 5), np.uint32))
        per_language = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE // len(languages)))
        part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
        most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)])
        sample = usable.where(part < F.try_element_at(most, F.col("lang"))).select("lang", F.lower("text").alias("text"))
        sample = sample.withColumn("hash", F.xxhash64("text")).dropDuplicates(["lang", "hash"])
        sample = settle(sample.mapInArrow(_profile_rows, "lang string, profile binary, runs array<int>"), "languages")
        rows = sample.select("lang", "profile").toArrow()
        label = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)
        x = np.array([np.frombuffer(p, np.float16) for p in rows["profile"].to_pylist()], np.float32).reshape(-1, SLOTS)
        order = np.lexsort((x[:, :8].sum(axis=1), label))  # the same sums whatever order the rows came in
        x, label = x[order], label[order]
        named = {code: name for name, codes in families.items() for code in codes}
        groups: dict[str, list[int]] = {}
        for i, code in enumerate(languages):
            groups.setdefault(named.get(code, code), []).append(i)
        members = [groups[name] for name in sorted(groups)]
        family = np.array([support_vectors(x, np.where(np.isin(label, m), 1.0, -1.0)) for m in members])
        pairs = {}
        for m in members:
            for a, b in itertools.combinations(m, 2):
                rows_ = np.isin(label, (a, b))
                pairs[a, b] = support_vectors(x[rows_], np.where(label[rows_] == a, 1.0, -1.0))
        return cls(languages, members, family, pairs, _runs_known(sample, languages))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each profile, and a score from 0 to 1."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        power = np.exp(np.clip(3 * x @ self.family.T, -30, 30))
        share = power / power.sum(axis=1, keepdims=True)
        best, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        chosen = share.argmax(axis=1)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            votes = np.zeros((len(rows), len(members)))
            sure = np.zeros((len(rows), len(members)))
            for i, j in itertools.combinations(range(len(members)), 2):
                p = sigmoid(3 * (x[rows] @ self.pairs[members[i], members[j]]))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                sure[:, i] += p
                sure[:, j] += 1 - p
            if len(members) == 1:
                sure += 1
            else:
                sure /= len(members) - 1
            winner = (votes + sure / len(members) / 2).argmax(axis=1)
            best[rows] = np.array(members)[winner]
            score[rows] = share[rows, f] * sure[np.arange(len(rows)), winner]
        return best, score

    def familiar(self, best: np.ndarray, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Share of the runs (of text ``owner``, in ``slot``) that are known in the text's language ``best``, with ``BENEFIT``."""
        seen = (self.known[best[owner], slot >> np.uint32(5)] >> (slot & np.uint32(31))) & np.uint32(1)
        runs = np.bincount(owner, minlength=len(best))
        return (np.bincount(owner, seen, minlength=len(best)) + BENEFIT) / (runs + BENEFIT)

    def predict(self, text: Column) -> Column:
        """Struct of ``lang``, ``score`` and ``familiar``; the unknown language and 0 for a null or a text without letters.

        A text of fewer than 3 characters has no runs and is familiar by 1."""
        model = self
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("familiar", pa.float64())])

        def run(texts: pa.Array) -> pa.Array:
            names, numbers = [], [np.zeros((2, 0))]
            for part in _pieces(texts):
                x, owner, slot = _looked_at(part)
                best, score = model.decide(x)
                names += [model.languages[i] for i in best]
                numbers.append(np.stack([score, model.familiar(best, owner, slot)]))
            score, familiar = np.concatenate(numbers, axis=1)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(familiar)], fields=list(kind))

        unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("familiar"))
        if not self.languages:
            return unknown
        told = F.arrow_udf(run, "struct<lang: string, score: double, familiar: double>")(F.lower(F.coalesce(text, F.lit(""))))
        return F.when(has_letters(text), told).otherwise(unknown)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether ``crc32`` of the id as text leaves this remainder (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest
