"""Quality by ordinal regression: one score per text, ordered thresholds between the grades.

P(grade > k) = sigmoid(score - threshold k), with the same weights for all k. The score is a
sum of weights of hashed features: the words of a text and their beginnings (present or not),
and the shapes of its words and the repeats among them (as shares of its words).

The weights are fitted on at most about ``per_grade`` rated texts of each grade (chosen by a
hash of the id) and weigh each grade as often as it occurs. Features of fewer than
``SEEN`` of those texts get no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.llm.linear import sigmoid

BITS = 20
PER_GRADE = 2000
SEEN = 5
GRADES = 16
_BEGINNING = 4

# Classes of bytes for the shape of a word: letters of either case, digits, and each mark by itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def _shapes(words: arrays.Words) -> np.ndarray:
    """Hash of each word's classes, runs of one class taken as one."""
    kind = _CLASS[words.data]
    change = np.bincount(words.start, minlength=len(kind) + 1) - np.bincount(words.end, minlength=len(kind) + 1)
    inside = np.cumsum(change)[:len(kind)] > 0
    fresh = inside.copy()
    fresh[1:] &= kind[1:] != kind[:-1]
    fresh[words.start] = True
    upto = np.concatenate([[0], np.cumsum(fresh)])
    return arrays.ranges_hash(kind[fresh].astype(np.uint64) + np.uint64(1), upto[words.start], upto[words.end])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, slot and value of every feature of the texts."""
    raw = arrays.Words(texts)
    plain = arrays.Words(texts, arrays.PLAIN)
    n = len(texts)
    short = np.minimum(plain.end, plain.start + _BEGINNING)
    begin = np.zeros(len(short), np.uint64)
    for i in range(_BEGINNING):
        at = plain.start + i
        live = at < short
        begin[live] = begin[live] * np.uint64(257) + plain.data[at[live]] + np.uint64(1)
    text = plain.text_of()
    present = []
    for salt, values in ((1, plain.hashes()), (2, begin)):
        slot = arrays.mix(values + np.uint64(salt << 40)) >> np.uint64(64 - BITS)
        present.append(np.unique((text.astype(np.uint64) << np.uint64(BITS)) | slot))
    present = np.concatenate(present)
    hashes, shape = raw.hashes(), _shapes(raw)
    text = raw.text_of()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    marks = np.concatenate([shape, np.full(same.sum(), 7, np.uint64)])
    owner = np.concatenate([text, text[same]])
    slot = arrays.mix(marks + np.uint64(3 << 40)) >> np.uint64(64 - BITS)
    shares, counts = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | slot, return_counts=True)
    low = np.uint64((1 << BITS) - 1)
    rows = [(x >> np.uint64(BITS)).astype(np.int64) for x in (present, shares)]
    values = [np.ones(len(present)), 4 * counts / np.maximum(raw.count[rows[1]], 1)]
    order = np.argsort(np.concatenate(rows), kind="stable")
    return tuple(np.concatenate(x)[order] for x in (rows, [(present & low).astype(np.int64), (shares & low).astype(np.int64)], values))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrays.chunks(batches):
        row, slot, value = features(batch.column("text"))
        counts = np.bincount(row, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), batch.column("grade"), arrays.lists(slot.astype(np.int32), counts, pa.int32()),
            arrays.lists(value.astype(np.float32), counts, pa.float32())], names=["doc_id", "grade", "slots", "values"])


def fit_thresholds(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray,
                   grades: int, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights by slot (dense, from 0) and the ``grades - 1`` thresholds, by Adam steps over all rows."""
    n, width = len(grade), int(slot.max(initial=0)) + 1
    weight = weight / weight.sum()
    above = (grade[:, None] > np.arange(grades - 1)).astype(np.float64)
    share = np.clip((weight[:, None] * above).sum(axis=0), 1e-6, 1 - 1e-6)
    theta = np.concatenate([np.zeros(width), np.log((1 - share) / share)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        score = np.bincount(row, theta[slot] * value, minlength=n)
        # Neighbouring thresholds cut the line; the likelihood of a grade is the difference of its two sides.
        side = sigmoid(score[:, None] - np.maximum.accumulate(theta[width:]))
        full = np.hstack([np.ones((n, 1)), side, np.zeros((n, 1))])
        at = np.arange(n)
        likely = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        slope = full * (1 - full)
        d_low, d_high = slope[at, grade] / likely, slope[at, grade + 1] / likely
        pull = -weight * (d_low - d_high)
        step = np.empty_like(theta)
        step[:width] = np.bincount(slot, pull[row] * value, minlength=width) + penalty * theta[:width]
        for t in range(grades - 1):
            step[width + t] = (weight * (d_low * (grade == t + 1) - d_high * (grade == t))).sum()
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        theta = theta - 0.05 * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
    return theta[:width], np.maximum.accumulate(theta[width:])


class QualityModel:
    """Weights by hashed feature and thresholds; small enough to be sent with every task."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> QualityModel:
        """Learn from the ``text`` of ``docs`` and the whole ``grade`` of ``ratings``, joined by ``doc_id``.

        Rows without an id, a text or a grade are left out. ``GRADES`` grades at most."""
        rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
        counts = {r.grade: r["count"] for r in rated.groupBy("grade").count().orderBy("grade").limit(GRADES + 1).collect()}
        if len(counts) > GRADES:
            raise ValueError(f"more than {GRADES} grades")
        if len(counts) < 2:
            return cls(sorted(counts) or [0], np.zeros(1 << BITS, np.float32), np.zeros(0))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        most = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, per_grade / c)])
        # About per_grade rows of at most GRADES grades: small enough for every task.
        chosen = F.broadcast(rated.where(part < F.element_at(most, F.col("grade"))))
        sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")
        rows = sample.select("doc_id", "grade", "text").mapInArrow(
            _feature_rows, "doc_id long, grade int, slots array<int>, values array<float>").toArrow()
        rows = rows.sort_by([("doc_id", "ascending"), ("grade", "ascending")])  # sums in the same order each time
        if not rows.num_rows:
            return cls(sorted(counts), np.zeros(1 << BITS, np.float32), np.zeros(len(counts) - 1))
        grades = sorted(counts)
        grade = np.searchsorted(grades, rows["grade"].to_numpy())
        sizes = rows["slots"].combine_chunks().value_lengths().to_numpy()
        row = np.repeat(np.arange(len(grade)), sizes)
        slot = rows["slots"].combine_chunks().flatten().to_numpy()
        value = rows["values"].combine_chunks().flatten().to_numpy().astype(np.float64)
        known = np.bincount(slot, minlength=1 << BITS) >= SEEN
        keep = known[slot]
        row, slot, value = row[keep], (np.cumsum(known) - 1)[slot[keep]], value[keep]
        found = np.bincount(grade, minlength=len(grades))
        weight = np.array([counts[g] for g in grades])[grade] / np.maximum(found, 1)[grade]
        small, thresholds = fit_thresholds(row, slot, value, grade, weight, len(grades))
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.flatnonzero(known)[:len(small)]] = small
        return cls(grades, weights, thresholds)

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for every threshold, a row for each text."""
        row, slot, value = features(texts)
        score = np.bincount(row, self.weights[slot] * value, minlength=len(texts))
        return sigmoid(score[:, None] - self.thresholds)

    def rate(self, text: Column) -> Column:
        """Struct of ``expected_grade``, and ``tail_probability`` of the highest grade. A null text is an empty one."""
        model = SparkSession.active().sparkContext.broadcast((self.grades, self.weights, self.thresholds))

        def run(texts: pa.Array) -> pa.Array:
            own = QualityModel(*model.value)
            tails = [own.tails(part.column(0)) for part in arrays.chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))]
            tail = np.vstack(tails) if tails else np.zeros((0, len(own.thresholds)))
            grade = own.grades[0] + tail @ np.diff(own.grades) if len(own.grades) > 1 else np.full(len(tail), float(own.grades[0]))
            top = tail[:, -1] if tail.shape[1] else np.ones(len(tail))
            return pa.StructArray.from_arrays([pa.array(grade, pa.float64()), pa.array(top, pa.float64())],
                                              names=["expected_grade", "tail_probability"])

        return F.arrow_udf(run, "struct<expected_grade: double, tail_probability: double>")(F.coalesce(text, F.lit("")))

