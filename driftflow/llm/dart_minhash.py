"""Near-duplicate classes by DartMinHash signatures.

The elements of a text are its distinct shingles of ``SHINGLE`` words (a shorter text is one
shingle), each of weight one, or of as many units as it occurs. Every unit of weight is a
region at which hashed darts are thrown at random ranks, the same for every text that has it.
A text sees the darts up to a rank that makes about ``k * (ln k + 3)`` of them, however long
it is; the earliest dart at each of the ``k`` coordinates is its signature. Texts that miss a
coordinate look at twice the ranks.

Bands of the signature put texts into buckets. Equal word sequences are one node from the
start. Within a bucket nodes are compared with its first and last node; what is linked is a
component. Buckets that still hold several components are compared block by block inside
tasks, where signatures choose the pairs of different components worth a look. Every link is
verified by the exact similarity of the two shingle sets. A pair inside one component needs
no link of its own. Bands of 4 in 128 coordinates miss a pair of similarity 0.8 with
probability 5e-8; the look at signatures adds 9e-9 for pairs that only an open bucket joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays, bloom
from driftflow.llm.groups import components
from driftflow.session import settle

SHINGLE = 5
SIMILAR = 0.8
COORDINATES = 128
ROWS = 4
BLOCK = 256
# Signatures of pairs at the wanted similarity 0.8 agree in less than this below it (74 of 128 coordinates
# or fewer) with probability 9e-9, less than the bands' own miss.
SLACK = 0.215
_CHUNK = 2 << 20
_LOW48 = np.uint64((1 << 48) - 1)


def elements(words: arrays.Words, hashes: np.ndarray, size: int, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text: its number, and a 48-bit hash; distinct ones, or (``counted``) one entry per occurrence."""
    text = words.text_of()
    full = np.flatnonzero(words.left() >= size)
    gram = arrays.grams(hashes, size)[full]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    whole = arrays.ranges_hash(hashes, words.first[short], words.first[short + 1])
    key = np.concatenate([text[full], short]).astype(np.uint64) << np.uint64(48)
    key |= np.concatenate([gram, whole]) >> np.uint64(16)
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    if counted:
        at = np.flatnonzero(fresh)
        unit = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        return (key >> np.uint64(48)).astype(np.int64), arrays.mix((key & _LOW48) + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = key[fresh]
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW48


def darts(text: np.ndarray, element: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n x k, 0 for texts without elements): the earliest dart's rank and number at each coordinate."""
    weight = np.bincount(text, minlength=n)
    reach = k * (math.log(k) + 3) / np.maximum(weight, 1)
    out = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    seed = arrays.mix(element)
    todo = np.ones(n, bool)
    while todo.any():
        live = todo[text]
        who, seeds = text[live], seed[live]
        rank = np.zeros(len(who))
        throw = 0
        while len(who):
            throw += 1
            h = arrays.mix(seeds + np.uint64(throw * 0xD1342543DE82EF95 % (1 << 64)))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            inside = rank < reach[who]
            who, seeds, rank, h = who[inside], seeds[inside], rank[inside], h[inside]
            # Positive doubles sort like their bits; the lowest bits make room for the dart's number.
            packed = (rank.view(np.uint64) & ~np.uint64(0xFFFFFF)) | (arrays.mix(h) & np.uint64(0xFFFFFF))
            np.minimum.at(out, who * k + (h % np.uint64(k)).astype(np.int64), packed)
        missing = (out.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1) & (weight > 0)
        reach = np.where(missing, reach * 2, reach)
        todo = missing
    out = out.reshape(n, k)
    out[weight == 0] = 0
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    parts = arrays.mix(signature).reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for r in range(rows):
        key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _sketches(size: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches, limit=_CHUNK):
            words = arrays.Words(batch.column("text"))
            hashes = words.hashes()
            n = batch.num_rows
            names = [arrays.ranges_hash(x, words.first[:-1], words.first[1:]) for x in (hashes, arrays.mix(hashes))]
            text, element = elements(words, hashes, size, counted)
            signature = darts(text, element, n)
            keys = band_keys(signature)
            some = words.count > 0
            short = (signature & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), *[pa.array(arrays.signed(x)) for x in names],
                arrays.lists(arrays.signed(keys[some].ravel()), np.where(some, keys.shape[1], 0), pa.int64()),
                pa.array([row.tobytes() for row in short], pa.binary())],
                names=["doc_id", "th", "name1", "name2", "bands", "signature"])
    return run


def sketch(docs: DataFrame, size: int = SHINGLE, counted: bool = False) -> DataFrame:
    """``row, doc_id, th`` (hash of the text), ``name1, name2`` (of its words), ``bands, signature``; written, with numbered rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(_sketches(size, counted),
                            "doc_id long, th long, name1 long, name2 long, bands array<long>, signature binary")
    return settle(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _sets(size: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            words = arrays.Words(batch.column("text"))
            hashes = words.hashes()
            names = [arrays.ranges_hash(x, words.first[:-1], words.first[1:]) for x in (hashes, arrays.mix(hashes))]
            keep = bloom.contains(wanted.value, names[0])
            text, element = elements(words, hashes, size)
            live = keep[text]
            counts = np.bincount(text[live], minlength=batch.num_rows)
            small = (element[live] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            sets = arrays.lists(small, counts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays.signed(x)) for x in names] + [sets], names=["name1", "name2", "items"]).filter(pa.array(keep))
    return run


def _verify(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of ``a, b`` whose sets (``row, items``) are similar."""
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("items").alias("x")), "a").join(
        sets.select(F.col("row").alias("b"), F.col("items").alias("y")), "b")
    low, high = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    # Two sets of too different sizes can't be similar; the rest is compared in whole numbers of thousandths.
    scaled = round(similar * 1000)
    return both.where(low * 1000 >= high * scaled).withColumn("_n", shared).where(
        F.col("_n") * 1000 >= (low + high - F.col("_n")) * scaled).select("a", "b")


def _inside(similar: float):
    """Links between different components among the nodes of one bucket's two blocks.

    Signatures tell which pairs are worth a look; their sets are compared here, so that no pair leaves the
    task but a link."""
    scaled = round(similar * 1000)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows, roots, block = (table.column(c).to_numpy() for c in ("row", "root", "block"))
        two = table.column("two")[0].as_py()
        sig = np.stack([np.frombuffer(x, np.uint16) for x in table.column("signature").to_pylist()])
        sets = table.column("items").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        items = [np.sort(sets.flatten().to_numpy()[a:b]) for a, b in zip(ends, ends[1:])]
        size = np.diff(ends)
        found = [[], []]
        for i in np.flatnonzero(block == block.min()):
            others = np.flatnonzero((roots != roots[i]) & (block != block[i] if two else np.arange(len(rows)) > i))
            near = np.minimum(size[others], size[i]) * 1000 >= np.maximum(size[others], size[i]) * scaled
            others = others[near]
            others = others[(sig[others] == sig[i]).mean(axis=1) >= similar - SLACK]
            if not len(others):
                continue
            theirs = np.concatenate([items[j] for j in others])
            at = np.minimum(np.searchsorted(items[i], theirs), size[i] - 1)
            starts = np.concatenate([[0], np.cumsum(size[others])[:-1]])
            shared = np.add.reduceat((items[i][at] == theirs).astype(np.int64), starts)
            for j in others[shared * 1000 >= (size[others] + size[i] - shared) * scaled]:
                found[0].append(max(rows[i], rows[j]))
                found[1].append(min(rows[i], rows[j]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})
    return run


def classes(docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE, counted: bool = False) -> DataFrame:
    """``row, doc_id, th, node, root`` of every row: ``node`` stands for equal word sequences, ``root`` for a class.

    Null texts are empty ones; texts without words are equal to each other. Null ids and repeated rows
    are rows like others. Which rows stand for a class depends on the order of the input alone.
    """
    made = sketch(docs, size, counted)
    nodes = settle(made.groupBy("name1", "name2").agg(
        F.min("row").alias("row"), F.min_by("bands", "row").alias("bands"), F.min_by("signature", "row").alias("signature")), "nodes")
    buckets = settle(nodes.select("row", F.explode("bands").alias("bucket")), "buckets")
    full = settle(buckets.groupBy("bucket").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high"), "full-buckets")
    members = settle(buckets.join(full, "bucket"), "members")
    wanted = members.select("row").distinct()
    wanted = settle(nodes.join(wanted, "row").select("row", "name1", "name2", "signature"), "wanted")
    filter_ = bloom.build(wanted, "name1")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    sets = texts.mapInArrow(_sets(size, filter_), "name1 long, name2 long, items array<int>")
    sets = sets.groupBy("name1", "name2").agg(F.first("items").alias("items"))
    sets = settle(sets.join(wanted, ["name1", "name2"]).select("row", "items"), "sets")

    # First the earliest node that each node meets, then the first and last of all its buckets.
    stars = members.groupBy("row").agg(F.min("low").alias("low")).where("low < row")
    links = settle(_verify(stars.select(F.col("row").alias("a"), F.col("low").alias("b")), sets, similar), "links")
    spokes = members.select(F.col("row").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a != b")
    spokes = spokes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    roots = components(links)
    links, roots = _more(links, roots, _verify(_apart(spokes, roots), sets, similar))

    # Buckets that still hold several components.
    rooted = _rooted(members.select("row", "bucket"), roots)
    open_ = rooted.groupBy("bucket").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    ).where("r0 < r1").select("bucket", "blocks")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    known = wanted.select("row", "signature").join(sets, "row")
    dealt = rooted.join(open_, "bucket").join(known, "row").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "row", "root", "signature", "items", "block", "bucket", F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("last"), (F.col("block") != F.col("other")).alias("two"))
    inside = dealt.groupBy("bucket", "one", "last").applyInArrow(_inside(similar), "a long, b long")
    links, roots = _more(links, roots, inside.distinct())
    node = made.join(nodes.select("name1", "name2", F.col("row").alias("node")), ["name1", "name2"])
    node = node.select("row", "doc_id", "th", "node")
    return node.join(roots.withColumnRenamed("root", "_root"), "node", "left").select(
        "row", "doc_id", "th", "node", F.coalesce("_root", "node").alias("root"))


def _more(links: DataFrame, roots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and roots after further links, if there are any."""
    found = settle(found, "links")
    if found.isEmpty():
        return links, roots
    links = links.unionByName(found)
    return links, components(links)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def dedup(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, class_id, class_rows, kept`` of every row: the least id of its class, its rows, and whether this
    row is the one that stays (the least id, then the earliest row). A class of null ids has a null id."""
    found = settle(classes(docs, **settings), "classes")
    best = found.groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), "row")).alias("best"),
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return found.join(best, "root").select(
        "row", "doc_id", "th", "class_id", "class_rows", (F.col("row") == F.col("best.row")).alias("kept"))
