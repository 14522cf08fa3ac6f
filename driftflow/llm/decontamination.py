"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case; in scripts written without blanks every
character is one. Seeds are the n-grams of
the test items that are rare in the corpus: those in at most ``RARER`` times as many texts as
the middle one of their item (and a few), so an item leaked everywhere keeps its seeds. An item of
fewer words is one seed, all of it. A
shared seed places an item over a passage of a text; the passage, with room for insertions,
is aligned with the item word by word (+2 for equal words, -1 for different ones and for
gaps). The score is the best local alignment's as a share of a full copy's.

Corpus texts meet the items by equal seeds in a join. A filter of fixed size keeps n-grams
that are in no item from being shuffled, and texts without a candidate from being read again.
Equal texts are aligned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays, bloom
from driftflow.session import settle

SEED = 3
RARER = 4
THRESHOLD = 0.4
MATCH, MISS = 2, -1
# Pairs aligned at a time: at most as many, and words of items and passages.
_SCORING = 2048
_SCORING_WORDS = 1 << 20


def _words(batch: pa.RecordBatch) -> arrays.Words:
    return arrays.Words(batch.column("text"), arrays.PLAIN, unspaced=True)


def _item_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            words = _words(batch)
            hashes = words.hashes()
            # The whole of a shorter item stands where its only seed would.
            length = np.minimum(words.count, size)
            counts = np.where(length > 0, words.count - length + 1, 0)
            starts = np.flatnonzero(words.left() >= length[words.text_of()])
            seeds = arrays.ranges_hash(hashes, starts, starts + length[words.text_of()[starts]])
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), arrays.lists(arrays.signed(hashes), words.count, pa.int64()),
                arrays.lists(arrays.signed(seeds), counts, pa.int64())], names=["item_id", "words", "seeds"])
    return run


def _hits(sizes: list[int], wanted):
    """Where seeds of these sizes may stand in a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            words = _words(batch)
            hashes, left, owner = words.hashes(), words.left(), words.text_of()
            places, found = [], []
            for size in sizes:
                seeds = arrays.grams(hashes, size)
                spots = np.flatnonzero(bloom.contains(wanted.value, seeds))
                spots = spots[left[spots] >= size]
                places.append(spots)
                found.append(seeds[spots])
            at, seed = np.concatenate(places), np.concatenate(found)
            text = owner[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(c).to_numpy()[text]) for c in ("th", "size")
            ] + [pa.array((at - words.first[text]).astype(np.int32)), pa.array(arrays.signed(seed))],
                names=["th", "size", "at", "seed"])
    return run


def _word_lists(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            batch = batch.filter(pa.array(bloom.contains(wanted.value, batch.column("th").to_numpy().view(np.uint64))))
            if batch.num_rows:
                words = _words(batch)
                yield pa.RecordBatch.from_arrays([
                    batch.column("th"), batch.column("size"),
                    arrays.lists(arrays.signed(words.hashes()), words.count, pa.int64())], names=["th", "size", "text_words"])
    return run


def _padded(column: pa.Array, fill: int) -> tuple[np.ndarray, np.ndarray]:
    counts = column.value_lengths().to_numpy().astype(np.int64)
    table = np.full((len(column), max(1, counts.max(initial=0))), fill, np.int64)
    inside = np.arange(table.shape[1]) < counts[:, None]
    table[inside] = column.flatten().to_numpy()
    return table, counts


def align(items: pa.Array, passages: pa.Array) -> np.ndarray:
    """Smith-Waterman score of each item (list of word hashes) with its passage."""
    a, n = _padded(items, 1)
    b, m = _padded(passages, 2)
    inside = m[:, None] > np.arange(b.shape[1])
    slope = -MISS * np.arange(1, b.shape[1] + 1)
    best = np.zeros(len(a), np.int64)
    row = np.zeros((len(a), b.shape[1] + 1), np.int64)
    for i in range(a.shape[1]):
        same = (a[:, i:i + 1] == b) & inside & (i < n)[:, None]
        step = np.maximum(row[:, :-1] + np.where(same, MATCH, MISS), row[:, 1:] + MISS)
        step = np.maximum(step, 0)
        # Gaps along the passage: the best of all cells to the left, less their distance.
        step = np.maximum.accumulate(step + slope, axis=1) - slope
        row[:, 1:] = step
        best = np.maximum(best, np.where(i < n, step.max(axis=1), 0))
    return best


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Pairs of like length together, so that little is padded.
        length = sum(batch.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("words", "passage"))
        order = np.argsort(length, kind="stable")
        batch, length = batch.take(pa.array(order)), length[order]
        at = 0
        while at < batch.num_rows:
            longest = length[min(at + _SCORING, batch.num_rows) - 1]
            part = batch.slice(at, int(max(1, min(_SCORING, _SCORING_WORDS // max(1, longest)))))
            at += part.num_rows
            items = part.column("words")
            score = align(items, part.column("passage")) / (MATCH * items.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("th", "size", "item_id", "low")] + [pa.array(score)],
                names=["th", "size", "item_id", "low", "score"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal texts have the same ``th, size``."""
    return docs.select(F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"),
                       F.lower("text").alias("text")).where("text IS NOT NULL")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SEED) -> DataFrame:
    """``th, size, item_id, score, low`` of texts that hold (an edited copy of) a test item: the best
    alignment of each pair, and the word of the text at which its passage begins.

    Null ids are ids like others. Items of fewer than ``size`` words are found where all their words stand
    in a row; items without words are never found, and null texts are skipped.
    """
    tests = settle(items.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(
        _item_rows(size), "item_id long, words array<long>, seeds array<long>").withColumn(
        "item", F.monotonically_increasing_id()), "items")
    # Of at most ``size`` values.
    sizes = sorted(r.n for r in tests.select(F.least(F.size("words"), F.lit(size)).alias("n")).where("n > 0").distinct().collect())
    spots = tests.select("item", F.size("words").alias("length"), F.posexplode("seeds").alias("item_at", "seed"))
    wanted = bloom.build(spots, "seed")
    texts = _keyed(docs)
    hits = settle(texts.mapInArrow(_hits(sizes or [size], wanted), "th long, size int, at int, seed long").distinct(), "hits")
    # Hits that only the filter lets pass are dropped by the joins with the items' seeds.
    spread = hits.groupBy("seed").agg(F.count_distinct("th", "size").alias("texts"))
    known = spots.join(spread, "seed", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    middle = known.groupBy("item").agg((F.expr("percentile(texts, 0.5)") * RARER + RARER).alias("most"))
    rare = known.join(middle, "item").where("texts <= most").select("item", "length", "item_at", "seed")
    half = F.greatest(F.lit(8), F.expr("length div 2"))
    placed = hits.join(rare, "seed").withColumn("half", half).withColumn(
        "cell", F.floor((F.col("at") - F.col("item_at")) / F.col("half")))
    places = placed.select("th", "size", "item", "length", "half", "cell").distinct()
    low = F.greatest(F.lit(0), F.col("cell") * F.col("half") - F.col("half"))
    high = (F.col("cell") + 2) * F.col("half") + F.col("length")
    places = settle(places.select("th", "size", "item", low.cast("int").alias("low"), high.cast("int").alias("high")), "places")
    again = bloom.build(places.select("th").distinct(), "th")
    lists = texts.mapInArrow(_word_lists(again), "th long, size int, text_words array<long>").dropDuplicates(["th", "size"])
    passages = places.join(lists, ["th", "size"]).select(
        "th", "size", "item", "low", F.slice("text_words", F.col("low") + 1, F.col("high") - F.col("low")).alias("passage"))
    scored = passages.join(tests.select("item", "item_id", "words"), "item").select(
        "th", "size", "item_id", "low", "words", "passage").mapInArrow(
        _scores, "th long, size int, item_id long, low int, score double")
    best = scored.where(F.col("score") >= threshold).groupBy("th", "size", "item_id").agg(
        F.max(F.struct("score", (-F.col("low")).alias("back"))).alias("best"))
    return best.select("th", "size", "item_id", "best.score", (-F.col("best.back")).alias("low"))


def found_in(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SEED) -> DataFrame:
    """``doc_id, item_id, score, first_word`` of every row of ``docs`` that holds an item; rows alike are told once."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                        F.octet_length("text").alias("size")).distinct()
    return keyed.join(leaks(docs, items, threshold, size), ["th", "size"]).select(
        "doc_id", "item_id", "score", F.col("low").alias("first_word"))
