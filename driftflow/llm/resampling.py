"""Importance resampling towards the texts of a target table.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case.
Features of a text are its runs of 1 to ``grams`` words, joined by a space, repeats counted; a
feature falls into bucket ``crc32 mod buckets``. The log ratio of a bucket's smoothed share in
the target to that in the documents, in floored thousandths, is its gain; a text weighs the
floored mean of the gains of its features, and a text without features weighs 0. Gumbel noise
from a hash of the id makes the highest scores a draw in proportion to the weights, without
replacement.

Texts are cut by Arrow kernels (``ascii_lower``, ``split_pattern_regex``, ``list_flatten``,
``dictionary_encode``). Runs are pairs of the dictionary index of a shorter run and that of the
word after it, by shifting the indices; every distinct pair is checksummed once and its result
taken for all. What is sent to the tasks is one gain for each bucket.

Null and empty texts have no features. A null id is hashed as if it were empty, and comes last
among equal scores; rows with equal ids and scores take ranks in the order of the input.
Repeated rows are rows like others. An empty target or corpus has counts of 0. Further columns
are left aside.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.session import local_table, settle

GRAMS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
# Everything in ASCII but letters and digits, after A-Z have become a-z.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def features(column: pa.Array, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``grams`` words: the text and the bucket of every run, by text."""
    data, ends = arrays.text_bytes(column)
    # A copy of its own: the kernel for lower case goes wrong on a slice of a longer column.
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data.copy()))
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    cut = pc.list_flatten(parts)
    solid = pc.not_equal(cut, "")
    text = pc.list_parent_indices(parts).filter(solid).to_numpy().astype(np.int64)
    words = cut.filter(solid).dictionary_encode()
    index = words.indices.to_numpy().astype(np.int64)
    names = [w.encode() for w in words.dictionary.to_pylist()]
    run, sums = index, np.array([zlib.crc32(w) for w in names], np.int64)
    yield text, sums[run] % buckets
    for size in range(2, grams + 1):
        last = max(len(text) - size + 1, 0)
        inside = text[:last] == text[size - 1:]
        pairs = run[:last] * max(len(names), 1) + index[size - 1:]
        found, run = np.unique(pairs, return_inverse=True)
        before, word = np.divmod(found, max(len(names), 1))
        sums = np.array([zlib.crc32(b" " + names[w], int(c)) for c, w in zip(sums[before], word)], np.int64)
        yield text[:last][inside], sums[run[inside]] % buckets


def _tally(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in arrays.chunks(batches):
            for _, bucket in features(batch.column("text"), grams, buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; the driver sees one row for a bucket."""
    parts = texts.select("text").mapInArrow(_tally(grams, buckets), "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_s + buckets)) / float((s + 1) * (all_t + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weights(grams: int, gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.value
        for batch in arrays.chunks(batches):
            n = batch.num_rows
            sums, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            n_words = None
            for text, bucket in features(batch.column("text"), grams, len(table)):
                held = np.bincount(text, minlength=n)
                n_words = held if n_words is None else n_words
                some = np.flatnonzero(held)
                if len(some):
                    starts = np.concatenate([[0], np.cumsum(held[some])[:-1]])
                    sums[some] += np.add.reduceat(table[bucket], starts)
                counts += held
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(counts), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def weigh(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weights(grams, sent), "doc_id long, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise of the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row. Of the rows with at least ``least_words``
    words, ``percent`` in a hundred (rounded down) are drawn and ranked 1, 2, 3, ...; the others have no rank."""
    scored = with_score(weigh(docs, target, grams, buckets), seed).withColumn("row", F.monotonically_increasing_id())
    scored = settle(scored, "scored")
    fit = F.col("n_words") >= least_words
    # Scores are whole numbers in a range that the counts bound: about +-35,000 of weight and 26,000 of noise.
    levels = scored.where(fit).groupBy("score").count().toArrow().sort_by([("score", "descending")])
    through = np.cumsum(levels["count"].to_numpy())
    wanted = int(through[-1]) * percent // 100 if len(through) else 0
    if not wanted:
        return scored.drop("row").withColumn("rank", F.lit(None).cast("long"))
    cut = levels["score"][int(np.searchsorted(through, wanted))].as_py()
    high = fit & (F.col("score") >= cut)
    ranked = _ranked(scored.where(high))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~high).drop("row").withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(ranked)


def _ranked(rows: DataFrame) -> DataFrame:
    """Number rows from the highest score on: sorted by ranges, then each range counts on from those before it."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = settle(laid.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = laid.groupBy(part.alias("part")).count().toArrow().sort_by("part")  # a row for a range
    ends = np.cumsum(sizes["count"].to_numpy())
    starts = [(p, int(e - n)) for p, e, n in zip(sizes["part"].to_pylist(), ends, sizes["count"].to_pylist())]
    offsets = F.broadcast(local_table(rows.sparkSession, starts, pa.schema([("part", pa.int64()), ("before", pa.int64())])))
    number = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.withColumn("part", part).join(offsets, "part").withColumn("rank", number).drop("part", "before", "place", "row")
