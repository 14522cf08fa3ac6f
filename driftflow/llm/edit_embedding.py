"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its first character on. At each step it writes down where it is and
then stays or moves on by one character; a random bit, shared by all texts, for the step and
the character decides. Walks over two texts that differ by an edit get out of step there and
meet again soon, so texts at a small edit distance write alike at most steps.

A fingerprint keeps ``SYMBOLS`` of the steps: each is the step of the least random number
among the first 2 x length steps, so texts of nearly equal length keep nearly the same steps
and those of different length fewer. A kept step is 6 bits of a hash of the ``CONTEXT``
characters read there, written as one character. The likeness of two fingerprints is the
share of equal symbols.

Banding takes sampled symbols of the fingerprint as keys; fingerprints that meet in a band
are verified by their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.session import local_table, settle

SYMBOLS = 256
CONTEXT = 4
PERIOD = 8192
BANDS = 32
BAND_SYMBOLS = 8
LAST_ID = (1 << 63) - 1
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_GROUP = 4 << 20
_FEW = 24
_shared: dict[str, object] = {}


def _bits() -> np.ndarray:
    """The shared bit of each step (modulo ``PERIOD``) and class of characters, flat."""
    if "bits" not in _shared:
        _shared["bits"] = (arrays.mix(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(63)).astype(np.uint8)
    return _shared["bits"]


def _records() -> list[np.ndarray]:
    """For each symbol the steps that are the least of all so far, in the order in which they come.

    After a least one at step t, the next comes beyond x with probability t / x."""
    if "records" not in _shared:
        found = []
        for symbol in range(SYMBOLS):
            steps, k = [0], 0
            while steps[-1] < 1 << 40:
                k += 1
                h = int(arrays.mix(np.array([symbol * 4096 + k], np.uint64))[0])
                steps.append(int((steps[-1] + 1) / ((h + 1) * 2.0 ** -64)))
            found.append(np.array(steps, np.int64))
        _shared["records"] = found
    return _shared["records"]


def kept_steps(lengths: np.ndarray) -> np.ndarray:
    """The step of every symbol for texts of these lengths (a row each)."""
    steps = np.maximum(2 * lengths, 1)
    out = np.empty((len(lengths), SYMBOLS), np.int64)
    for symbol, record in enumerate(_records()):
        out[:, symbol] = record[np.searchsorted(record, steps, "left") - 1]
    return out


def _walk(kinds: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The character (counted from the text's first) read at every kept step, ``length`` if past the end.

    ``kinds`` are the classes of all characters, ``start`` the first of each text. Texts are sorted by
    length, longest first; all walk in step, and the longest few finish one by one."""
    bits = _bits()
    n = len(start)
    steps = 2 * length
    wanted = kept_steps(length)
    read = np.broadcast_to(length[:, None], wanted.shape).copy()
    common = int(steps[_FEW]) if n > _FEW else 0
    at = start.copy()
    stop = start + length
    done = 0
    block = 1024
    kinds = np.append(kinds, 0)
    while done < common:
        live = int(np.searchsorted(-steps, -done, "left"))  # texts with steps left
        size = min(block, common - done)
        path = np.empty((size, live), np.int64)
        here, end = at[:live], stop[:live]
        for k in range(size):
            path[k] = here
            here = np.minimum(here + bits[((done + k) % PERIOD) * 256 + kinds[here]], end)
        at[:live] = here
        text, symbol = np.nonzero((wanted[:live] >= done) & (wanted[:live] < done + size))
        read[text, symbol] = path[wanted[text, symbol] - done, text] - start[text]
        done += size
    table = bits.tobytes()
    for i in range(min(n, _FEW)):
        here, end = int(at[i] - start[i]), int(length[i])
        own = kinds[start[i]:stop[i]].astype(np.uint8).tobytes()
        order = np.argsort(wanted[i], kind="stable")
        order = order[wanted[i][order] >= done]
        step = done
        for symbol in order.tolist():
            goal = int(wanted[i, symbol])
            while step < goal and here < end:
                here += table[(step % PERIOD) * 256 + own[here]]
                step += 1
            read[i, symbol] = here
    return np.minimum(read, length[:, None])


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text; equal texts have equal ones."""
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        part, size = [], 0
        while at < len(order) and (not part or size + len(texts[order[at]]) <= _GROUP):
            part.append(order[at])
            size += len(texts[order[at]])
            at += 1
        codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(texts[i]) for i in part], np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        kinds = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64)
        read = _walk(kinds, start, length)
        padded = np.append(codes.astype(np.uint64), np.uint64(0))
        name = np.zeros(read.shape, np.uint64)
        for k in range(CONTEXT):
            spot = read + k
            name = name * np.uint64(0x100000001B3) + np.where(
                spot < length[:, None], padded[np.minimum(start[:, None] + spot, len(codes))] + np.uint64(1), np.uint64(0))
        symbols = _LETTERS[(arrays.mix(name) >> np.uint64(58)).astype(np.int64)]
        for i, row in zip(part, symbols):
            out[i] = row.tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal symbols of two fingerprints."""
    return float((np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)).mean())


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; a null text is an empty one."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts.to_pylist()), pa.string())
    return F.arrow_udf(run, "string")(F.coalesce(text, F.lit("")))


def similar_pairs(docs: DataFrame, least: float = 0.8, bands: int = BANDS, symbols: int = BAND_SYMBOLS) -> DataFrame:
    """``doc_id, first_id, likeness`` of documents linked to the first document (least id) of a band.

    ``docs`` has ``doc_id, fingerprint``. Band b takes ``symbols`` sampled positions of the fingerprint. Only the
    links to a band's first document are made, so a band of equal fingerprints makes no pairs of all its rows.
    """
    spots = [[int(x) % SYMBOLS for x in arrays.mix(np.arange(symbols, dtype=np.uint64) + np.uint64(b * 1000 + 7))] for b in range(bands)]
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.substring("fingerprint", s + 1, 1) for s in row]) for b, row in enumerate(spots)])
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint", F.explode(keys).alias("band")), "bands")
    heads = rows.where("doc_id IS NOT NULL").groupBy("band").agg(
        F.min(F.struct("doc_id", "fingerprint")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(heads, "band").where("doc_id > head.doc_id").select(
        "doc_id", F.col("head.doc_id").alias("first_id"), "fingerprint", F.col("head.fingerprint").alias("other")).distinct()
    marks = F.sequence(F.lit(1), F.lit(SYMBOLS))
    equal = F.size(F.filter(marks, lambda i: F.substring("fingerprint", i, F.lit(1)) == F.substring("other", i, F.lit(1))))
    return met.withColumn("likeness", equal / SYMBOLS).where(F.col("likeness") >= least).select("doc_id", "first_id", "likeness")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and id; each row that is not a part's last (a copy of the next part's first)
    is compared with the row behind it. Texts are held for one chunk and one row."""
    def told(rows: list, following: tuple | None) -> pa.RecordBatch:
        chain = rows + ([following] if following else [])
        pairs = [(a, b[2]) for a, b in zip(chain, chain[1:]) if not a[3]]
        edited = []
        for (_, _, text, _), other in pairs:
            cut = len(text) // 2
            edited.append(text[:len(text) - cut] + other[:cut])
        marks = fingerprints([r[2] for r in chain] + edited)
        own = dict(zip(map(id, chain), marks))
        prints, edits = [own[id(a)] for a, _ in pairs], marks[len(chain):]
        nexts = [m for (a, m) in zip(chain, marks[1:len(chain)]) if not a[3]]
        return pa.RecordBatch.from_arrays([
            pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(prints, pa.string()), pa.array(edits, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, edits)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(prints, nexts)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for part in arrays.chunks(iter([batch])):
            for row in zip(*(part.column(c).to_pylist() for c in ("part", "doc_id", "text", "extra"))):
                rows.append(row)
                size += len(row[2])
                if size > 4 << 20:
                    yield told(rows[:-1], rows[-1])
                    rows, size = [rows[-1]], len(row[2])
    if rows:
        yield told(rows, None)


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the start of the next document's.

    Documents are in the order of their ids, null last, equal ids by a hash of the text; after the last
    comes the first. They are dealt out once, to ranges of ids; a range also gets the first document of
    the next one. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"), F.xxhash64("text").alias("th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = texts.agg(F.percentile_approx("place.ord", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)
    part = F.arrow_udf(lambda ids: pa.array(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32)), "int")
    ranged = texts.withColumn("part", part("place.ord"))
    # The first document of each range, of which there are ``parts``, and the range before it.
    heads = ranged.groupBy("part").agg(F.min("place").alias("place")).orderBy("part").collect()
    before = [(h.part, h.place.ord, h.place.th, heads[i - 1].part) for i, h in enumerate(heads)]
    firsts = local_table(spark, before, pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("th", pa.int64()), ("goal", pa.int32())]))
    firsts = F.broadcast(firsts.select("part", F.struct("ord", "th").alias("place"), "goal"))
    own = F.struct("part", F.lit(False).alias("extra"))
    also = F.struct(F.col("goal").alias("part"), F.lit(True).alias("extra"))
    dealt = ranged.join(firsts, ["part", "place"], "left").withColumn(
        "go", F.explode(F.when(F.col("goal").isNull(), F.array(own)).otherwise(F.array(own, also))))
    dealt = dealt.select("go.part", "go.extra", "doc_id", "text", "place")
    dealt = dealt.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "extra", "place")
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(
        _with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")
