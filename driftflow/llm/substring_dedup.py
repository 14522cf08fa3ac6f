"""Substring dedup by recompression of word sequences.

Rounds of recompression name the words of a text: runs of one word get a name, then
neighbouring symbols are paired and the pair gets a name, twice. Whether two neighbours pair
depends on one bit of each (first kind of bit on the left, second on the right), and a name
is a hash of what it stands for. So names are the same in every document without a
dictionary being shuffled, and equal stretches of words have equal symbols inside: only near
their ends can the surroundings change a symbol.

A window of ``length`` words is searched by one of the second-level symbols inside it that
its surroundings can't change (the one of most words, then of smallest hash) together with
the symbols beside it. Equal windows choose the same one. A window without such a symbol
(long runs of one word) is searched by all its words. Neighbouring windows that choose the
same symbol are shuffled together, by it. Where a symbol is in two documents or more, its
windows are compared by a hash of all their words, 128 bits with the symbol's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftflow.llm import arrays, bloom
from driftflow.session import settle

LENGTH = 13
LAST_ID = (1 << 63) - 1
PER_RUN = 256
_PAIR = [np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC3A5C85C97CB3127)]


def _merge(names: np.ndarray, kinds: np.ndarray, edge: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of pairing. ``kinds`` decide what pairs, ``edge`` marks the first symbol of a text.

    Returns the first symbol of each new one, its name and its kind."""
    bit = (kinds >> np.uint64(40 + level)) & np.uint64(1)
    joins = np.zeros(len(names), bool)
    joins[:-1] = (bit[:-1] == 0) & (bit[1:] == 1) & ~edge[1:]
    opens = np.ones(len(names), bool)
    opens[1:] = ~joins[:-1]
    first = np.flatnonzero(opens)
    double = joins[first]
    partner = first + double
    factor = _PAIR[level]
    one = [x[first] for x in (names, kinds)]
    two = [x[partner] for x in (names, kinds)]
    named = [np.where(double, arrays.mix(a * factor + b + np.uint64(level + 1)), a) for a, b in zip(one, two)]
    return first, named[0], named[1]


def anchors(words: arrays.Words, hashes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Every window's first word, and its mark: a hash of the chosen symbol and its neighbours, 0 for none."""
    start = np.flatnonzero(words.left() >= length)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    n = len(hashes)
    edge = np.zeros(n, bool)
    edge[words.first[:-1][words.count > 0]] = True
    # Runs: ``at0`` is the first word of each, its kind does not depend on how long it is.
    opens = edge.copy()
    opens[1:] |= hashes[1:] != hashes[:-1]
    opens[0] = True
    at0 = np.flatnonzero(opens)
    size0 = np.diff(np.append(at0, n))
    kind0 = hashes[at0]
    name0 = np.where(size0 > 1, arrays.mix(kind0 + size0.astype(np.uint64)), kind0)
    first1, name1, kind1 = _merge(name0, kind0, edge[at0], 0)
    at1 = at0[first1]
    first2, name2, _ = _merge(name1, kind1, edge[at1], 1)
    at1 = np.append(at1, n)
    name1 = np.concatenate([[np.uint64(0)], name1, [np.uint64(0)]])
    last2 = np.append(first2[1:], len(at1) - 1) - 1
    # A symbol stands for at1[first2] .. at1[last2 + 1]; the marks add the symbols beside it.
    mark = arrays.mix(arrays.mix(name1[first2] * _PAIR[0] + name2) * _PAIR[1] + name1[last2 + 2])
    span = at1[last2 + 1] - at1[first2]
    rank = (np.minimum(span, 200).astype(np.uint64) << np.uint64(56)) | (name2 >> np.uint64(8))
    # First-level symbols within the window but for its first and last word can't change; neither can
    # the second-level symbols made of them, leaving out the first and the last of those.
    low1 = np.searchsorted(at1, start + 1) + 1
    high1 = np.searchsorted(at1[1:], start + length - 1, "right") - 2
    low2 = np.searchsorted(first2, low1)
    high2 = np.searchsorted(last2, high1, "right") - 1
    best = np.zeros(len(start), np.uint64)
    chosen = np.full(len(start), -1, np.int64)
    for step in range(length):
        place = low2 + step
        live = np.flatnonzero(place <= high2)
        if not len(live):
            break
        better = live[rank[place[live]] > best[live]]
        best[better] = rank[place[better]]
        chosen[better] = place[better]
    return start, np.where(chosen >= 0, mark[chosen], np.uint64(0))


def _runs(length: int):
    """Neighbouring windows of a text that have one mark, ``PER_RUN`` at most, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            words = arrays.Words(batch.column("text"))
            hashes = words.hashes()
            start, mark = anchors(words, hashes, length)
            if not len(start):
                continue
            name = arrays.grams(hashes, length)[start]
            mark = np.where(mark == 0, name, mark)
            row = words.text_of()[start]
            at = start - words.first[row]
            fresh = at % PER_RUN == 0
            fresh[1:] |= mark[1:] != mark[:-1]
            first = np.flatnonzero(fresh)
            text = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([
                pa.array(arrays.signed(mark[first])), batch.column("ord").take(text), batch.column("th").take(text),
                pa.array(at[first].astype(np.int32)),
                arrays.lists(arrays.signed(name), np.diff(np.append(first, len(start))), pa.int64())],
                names=["mark", "ord", "th", "at", "names"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"),
                       F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``ord, th, at`` of windows whose words also start in a document with a smaller id.

    ``ord`` is the id (the largest long for null), ``th`` a hash of the text; rows of equal id are not
    earlier than each other."""
    runs = _keyed(docs).mapInArrow(_runs(length), "mark long, ord long, th long, at int, names array<long>")
    # Both windows are dealt by the mark, so the runs are shuffled once; most marks are in one document alone.
    one, same = W.partitionBy("mark"), W.partitionBy("mark", "name")
    shared = runs.withColumns({"low": F.min("ord").over(one), "high": F.max("ord").over(one)}).where("low < high")
    windows = shared.select("mark", "ord", "th", "at", F.posexplode("names").alias("step", "name"))
    later = windows.withColumn("first", F.min("ord").over(same)).where("ord > first")
    return later.select("ord", "th", (F.col("at") + F.col("step")).alias("at"))


def _kept(length: int, touched=None):
    """The words left; of texts whose hash does not pass the filter ``touched``, if there is one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            if touched is not None:
                batch = batch.filter(pa.array(~bloom.contains(touched.value, batch.column("th").to_numpy().view(np.uint64))))
                if not batch.num_rows:
                    continue
            column = batch.column("text")
            words = arrays.Words(column)
            n = len(words.start)
            at = batch.column("at").cast(pa.large_list(pa.int32()))
            counts = at.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            spots = np.repeat(words.first[:-1], counts) + at.flatten().to_numpy()
            change = np.bincount(spots, minlength=n + length + 1) - np.bincount(spots + length, minlength=n + length + 1)
            gone = np.cumsum(change)[:n] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1])
            removed = np.where(words.count > 0, removed, 0)
            data = words.data.tobytes()
            kept = []
            for i in range(batch.num_rows):
                if removed[i]:
                    part = slice(words.first[i], words.first[i + 1])
                    stay = ~gone[part]
                    spans = zip(words.start[part][stay].tolist(), words.end[part][stay].tolist())
                    kept.append(b" ".join([data[a:b] for a, b in spans]))
                else:  # bytes.split() takes the same blanks
                    kept.append(b" ".join(data[words.offsets[i]:words.offsets[i + 1]].split()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(words.count.astype(np.int64)), pa.array(removed),
                 pa.array([x.decode() for x in kept], pa.string())], names=["row", "n_words", "n_removed", "kept"])
    return run


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` with ``n_words, n_removed`` and ``kept``: the words left, one space apart.

    A word goes if a window over it also starts in a document of smaller id; windows are judged on the
    input. Null ids are the largest; a null text has no words."""
    found = repeated_windows(docs, length).groupBy("ord", "th").agg(F.collect_set("at").alias("at"))
    found = settle(found, "repeats")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"),
                       F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # Only texts that may have lost words are shuffled to meet their windows. The others are told where they
    # are cut, so that no task needs a second worker for the filter.
    touched = bloom.build(found.select("th").distinct(), "th")
    none = F.lit(None).cast("array<int>").alias("at")
    joined = rows.where(bloom.passes(touched, F.col("th"))).join(found, ["ord", "th"], "left").select("row", "text", "at")
    shape = T.StructType([joined.schema["row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    clean = rows.select("row", "text", "th", none).mapInArrow(_kept(length, touched), shape)
    return joined.mapInArrow(_kept(length), shape).unionByName(clean)
