"""Alignment of two tokenizers over a corpus: A is a byte-level BPE, B a piece model with byte fallback.

A text is cut by both tokenizers, A with a blank put before it as B does by itself; strings of
special tokens are plain text. Token ends that both share cut a text into groups, and every
pair of an A and a B token whose bytes overlap is a link. The count of a pair of ids is the
number of documents that hold it linked.

Both tokenizers cut a text at a blank after another character, whatever is around it, so a
text is a row of segments (blanks and the characters up to the next one) that can be cut and
aligned once for all the places they are at. Where that does not hold - characters whose class
regular expression engines may see differently, other white space before several blanks,
files of another make - the whole text is one segment.

The first pass cuts the distinct segments of a chunk of texts, in slices, and writes the chunk in
rows of whole texts: the tokens of their distinct segments and the segments of each text, and with
the last of them the chunk's distinct pairs with the number of documents of each. What a task holds
beside the text it was sent is bounded by these sizes, or by a text that is longer.
Distinct pairs of all chunks get a number from a minimal perfect hash: pairs are dealt to
``BLOCKS`` blocks, and in each block a cascade of bit vectors gives every pair its own slot,
with no slot left over. Pairs are counted in dense vectors indexed by that hash, one for a
block and a bounded piece of its rows; the vectors of a block are then added up, ``FAN_IN`` at
a time. Every slot carries its pair, so that a pair is verified when it is looked up. The
second pass aligns the written tokens again and looks up the count of every link: in a table
sent to all tasks while it is small (``MOST_SENT`` pairs), and beyond that by taking each
chunk's pairs to the blocks and their counts back to the chunk.

A block never holds more than its share of all pairs that two vocabularies can make, and a
common pair is one row in a chunk, so neither grows with its frequency.

Null and empty texts have no tokens, nor have texts whose tokens do not spell the text again
(such as those that hold the mark U+2581); all their numbers are 0 and the digest is empty.
Null ids and repeated rows are rows like others. Further columns are left aside. The files of
the tokenizers are read where the tasks run, so they have to be at the same path everywhere.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.session import settle

FOLDER = "/opt/tokenizers"
FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"
BLOCKS = 256
# Rows of (chunk, pair) that are counted in one task, and vectors that are added up in one.
ROWS_PER_TASK = 1_000_000
FAN_IN = 16
# Pairs up to which the counted table is sent to all tasks: 16 bytes each.
MOST_SENT = 1_000_000
# Pairs are dealt to blocks by their rest by this prime.
_PRIME = 1_000_003
# Bytes of text of a chunk, characters of segments that the libraries are given at once, and segments of the texts
# of a written row.
_CHUNK = 4 << 20
_SLICE = 1 << 17
_PIECE = 1 << 17
# Rows in a written file: what is read of a file at once is bounded whatever a file system's blocks are.
_ROWS_PER_FILE = 16
_MARK = "▁"

# --- fixed values: the published byte-level pattern, and the bytes written as the character of the same number ---
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# --- end of fixed values ---

# Characters on whose class any two regular expression engines agree.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏぁ-ゖァ-ヺ一-龥가-힣]")
# White space that goes on behind other white space than blanks.
_LOOSE = re.compile("[\t\n\r](?:  | +$)")
_SEGMENT = re.compile(" +[^ ]+| +$")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class Cutter:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            said = json.load(file)
        added = {t["content"] for t in said["added_tokens"]}
        chars = byte_of_char()
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [b""] * (max(entries) + 1)
        for i, token in entries.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(chars[c] for c in token)

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(_MARK)
        self.lengths = [np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b)]
        # No piece has a blank after another character, and blanks and marks stay as they are.
        probe = " b  a\n\tb ﬁ Ａ "
        plain = all(_MARK not in p.lstrip(_MARK) for p in pieces) and self.bytes_b[self.blank] == b" " and (
            b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == b" " + probe.encode())
        split = said["pre_tokenizer"] or {}
        self.apart = plain and said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.fast = self._ranked(said["model"], added) if self.apart else None

    def _ranked(self, model: dict, added: set):
        """The same tokenizer in a library that is faster, if ids are ranks: every merge makes the next entry."""
        import tiktoken
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        ranked = len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values()},
                                 special_tokens={}) if ranked else None

    def segments(self, text: str | None) -> list[str]:
        """Segments of the text with a blank before it; none for a text without tokens."""
        if not text or _MARK in text:
            return []
        if not self.apart or _ODD.search(text) or _LOOSE.search(text):
            return [" " + text]
        return _SEGMENT.findall(" " + text)

    def _encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _joined(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids and their number in each segment, for both sides, from all segments as one text."""
        text = "".join(segments)
        spelt, out = text.encode(), []
        ends = np.cumsum([len(s.encode()) for s in segments])
        # B is faster word by word than on a long text.
        each = self.b.encode([s[1:] for s in segments], num_threads=1)
        for table, lengths, ids in ((self.bytes_a, self.lengths[0], self._encode_a(text)),
                                    (self.bytes_b, self.lengths[1], list(chain.from_iterable(each)))):
            if b"".join(map(table.__getitem__, ids)) != spelt:
                return None
            ids = np.array(ids, np.int64)
            through = np.cumsum(lengths[ids])
            at = np.searchsorted(through, ends)
            if (through[at] != ends).any():
                return None
            out.append((ids, np.diff(np.concatenate([[-1], at]))))
        return out

    def cut(self, segments: list[str]) -> tuple[list[str], set[int], list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct segments in the order used here, those of them that either side does not spell (they have no
        ids), and for both sides the ids and their number in each segment."""
        plain = [s for s in segments if len(s) > 1 and s.rfind(" ") == 0] if self.apart else []
        if _ODD.search("".join(plain)):
            plain = [s for s in plain if not _ODD.search(s)]
        known = set(plain)
        others = [s for s in segments if s not in known]
        order, parts = [], []
        for piece in _slices(plain):
            joined = self._joined(piece)
            if joined is None:
                others += piece
            else:
                order += piece
                parts.append(joined)
        wrong = set()
        for piece in _slices(others):
            made = [[x.ids for x in self.a.encode_batch(piece, add_special_tokens=False)],
                    [[self.blank] if s == " " and self.apart else x for s, x in zip(piece, self.b.encode([s[1:] for s in piece], num_threads=1))]]
            bad = {i for i, s in enumerate(piece) if any(
                b"".join(map(table.__getitem__, ids[i])) != s.encode() for table, ids in zip((self.bytes_a, self.bytes_b), made))}
            made = [[[] if i in bad else x for i, x in enumerate(ids)] for ids in made]
            parts.append([(np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)) for ids in made])
            wrong |= {len(order) + i for i in bad}
            order += piece
        none = np.zeros(0, np.int64)
        return order, wrong, [tuple(np.concatenate([none, *[part[side][i] for part in parts]]) for i in (0, 1)) for side in (0, 1)]


def _slices(segments: list[str]) -> Iterator[list[str]]:
    """Runs of segments with about ``_SLICE`` characters; a longer segment is taken whole."""
    ends = np.cumsum([len(s) for s in segments])
    at = 0
    while at < len(segments):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
        yield segments[at:last]
        at = last


_loaded: dict[tuple[str, str], Cutter] = {}


def cutter(path_a: str, path_b: str) -> Cutter:
    """The two tokenizers, read once in a worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Cutter(path_a, path_b)
    return _loaded[path_a, path_b]


class Aligned:
    """Tokens of several segments one after the other. Both sides of a segment have equally many bytes, so one
    running sum of lengths serves all of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, lengths: list[np.ndarray]):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.size_a, self.size_b = map(len, lengths)
        self.ends_a, self.ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
        at = np.searchsorted(self.ends_b, self.ends_a)
        common = self.ends_a[self.ends_b[at] == self.ends_a]
        self.group_a = np.searchsorted(common, self.ends_a, "left")
        self.group_b = np.searchsorted(common, self.ends_b, "left")
        ends = np.concatenate([[-1], self.group_a])[np.cumsum(n_a)]
        self.n_groups = np.diff(np.concatenate([[-1], ends]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """How many links each segment has, and the pair of ids (as one number) of every link, by segment."""
        starts = np.concatenate([[0], self.ends_a[:-1]]) if len(self.a) else self.ends_a
        low = np.searchsorted(self.ends_b, starts, "right")
        n = np.searchsorted(self.ends_b, self.ends_a, "left") - low + 1
        at_a = np.repeat(np.arange(len(self.a)), n)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        through = np.concatenate([[0], np.cumsum(n)])[np.cumsum(self.n_a)]
        return np.diff(np.concatenate([[0], through])), self.a[at_a] * self.size_b + self.b[at_b]

    def spelt(self, words: np.ndarray) -> list[str]:
        """The groups of each segment as ``a1,a2|b1;a3|b2,b3``; ``words`` has the ids of A and then of B, each
        with the four marks that can follow it (:func:`marked`)."""
        order_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        order_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        code = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, group, order, shift, mark in ((self.a, self.group_a, order_a, 0, 1), (self.b, self.group_b, order_b, self.size_a, 2)):
            last = np.ones(len(group), bool)
            last[:-1] = group[1:] != group[:-1]
            code[order] = (shift + ids) * 4 + mark * last
        n = self.n_a + self.n_b
        final = np.cumsum(n)[n > 0] - 1
        code[final] += 1  # a line end in place of the mark after a segment's last group
        lines = iter("".join(words[code].tolist()).split("\n"))
        return [next(lines) if x else "" for x in (n > 0).tolist()]


def marked(sizes: list[int]) -> np.ndarray:
    return np.array([f"{i}{mark}" for n in sizes for i in range(n) for mark in (",", "|", ";", "\n")], object)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _expanded(values_of: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + n[i]`` for every i in ``values_of``."""
    n, starts = n[values_of], starts[values_of]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _unpacked(cell, size: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), _kind(size)).astype(np.int64)


class _Places(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = len(self)
        return self[key]


def _cut_chunks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(path_a, path_b)
        for batch in arrays.chunks(batches, limit=_CHUNK):
            places = _Places()
            rows = [np.fromiter(map(places.__getitem__, cut.segments(t)), np.int32) for t in batch.column("text").to_pylist()]
            order, wrong, sides = cut.cut(list(places))
            moved = np.empty(len(places), np.int64)
            moved[[places[x] for x in order]] = np.arange(len(places))
            del places, order
            n_segments = np.array([len(r) for r in rows], np.int64)
            segment = moved[np.concatenate(rows)]
            if wrong:
                doc = np.repeat(np.arange(len(rows)), n_segments)
                void = np.zeros(len(rows), bool)
                void[doc[np.isin(segment, list(wrong))]] = True
                n_segments, segment = np.where(void, 0, n_segments), segment[~void[doc]]
            del rows
            ends, firsts = np.cumsum(n_segments), [0]
            while firsts[-1] < len(ends):
                first = firsts[-1]
                firsts.append(max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PIECE, "right"))))
            starts, found = [np.cumsum(n) - n for _, n in sides], []
            for i, (first, last) in enumerate(zip(firsts, firsts[1:])):
                held = segment[ends[first] - n_segments[first]:ends[last - 1]]
                columns, pair, docs = _chunk(n_segments[first:last], held, sides, starts, cut.lengths)
                found.append((pair, docs))
                behind = len(firsts) - i - 2
                pair, docs = (np.zeros(0, np.int64),) * 2 if behind else _added(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("doc_id").slice(first, last - first).to_pylist()], pa.list_(pa.int64())), *columns,
                    arrays.lists(pair, np.array([len(pair)]), pa.int64()),
                    arrays.lists(docs.astype(np.int32), np.array([len(docs)]), pa.int32()), pa.array([behind], pa.int64())],
                    names=["doc_ids", "n_segments", "n_a", "n_b", "a", "b", "segments", "pairs", "docs", "behind"])
    return run


def _chunk(n_segments: np.ndarray, segment: np.ndarray, sides: list, starts: list[np.ndarray],
           lengths: list[np.ndarray]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Segments and tokens of some of the texts that were cut together, with segments numbered anew, and their
    distinct pairs with the number of documents of each."""
    used = _distinct(segment)
    segment = np.searchsorted(used, segment)
    (a, n_a), (b, n_b) = ((ids[_expanded(used, n, at)], n[used]) for (ids, n), at in zip(sides, starts))
    # Every segment once for each document, every pair once for each document, then counted.
    doc = np.repeat(np.arange(len(n_segments)), n_segments)
    doc, once = np.divmod(_distinct(doc * max(len(used), 1) + segment), max(len(used), 1))
    n_links, pair = Aligned(a, b, n_a, n_b, lengths).links()
    at = _expanded(once, n_links, np.cumsum(n_links) - n_links)
    held = _distinct(pair[at] * len(n_segments) + np.repeat(doc, n_links[once])) // len(n_segments)
    pair = _distinct(held)
    docs = np.diff(np.searchsorted(held, np.append(pair, np.iinfo(np.int64).max)))
    packed = [x.astype(_kind(n)).tobytes() for x, n in zip([a, b, segment], [*map(len, lengths), len(used)])]
    return [*[arrays.lists(n.astype(np.int32), np.array([len(n)]), pa.int32()) for n in (n_segments, n_a, n_b)],
            *[pa.array([x], pa.binary()) for x in packed]], pair, docs


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order with the sums of their numbers."""
    pair = _distinct(np.concatenate([p for p, _ in found]))
    docs = np.zeros(len(pair), np.int64)
    for p, n in found:
        docs[np.searchsorted(pair, p)] += n
    return pair, docs


def chunked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Whole texts with their segments and tokens, written. Those that were cut together have one ``chunk`` number,
    and the last row of them has its pairs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = texts.mapInArrow(_cut_chunks(path_a, path_b), "doc_ids array<long>, n_segments array<int>, n_a array<int>, n_b array<int>, "
                            "a binary, b binary, segments binary, pairs array<long>, docs array<int>, behind long")
    # Ids go up by one within a task, so rows that follow one another get the id of the last of them.
    return settle(made.withColumn("chunk", F.monotonically_increasing_id() + F.col("behind")).drop("behind"),
                  "token-chunks", _ROWS_PER_FILE)


class PerfectHash:
    """A minimal perfect hash of a set of numbers: at each level the numbers that are alone at their place
    stay, the others go on to the next. A number's slot is how many places are taken before its own."""

    ROOM = 2

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (arrays.mix(keys.astype(np.uint64) + seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        sizes, parts = [], []
        while len(keys):
            size = -(-cls.ROOM * len(keys) // 64) * 64
            place = cls.place(keys, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[place]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; of a number that is not in the set, some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + self.place(keys[todo], level, size)
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            taken = (word >> inside) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            out[todo[taken]] = self.before[bit[taken] >> 6] + below[taken]
            todo = todo[~taken]
        return out


def _hash_of(sizes: list[int], words: np.ndarray) -> PerfectHash:
    return PerfectHash(sizes, words.view(np.uint64))


_TABLE = "block int, sizes array<long>, words array<long>, keys array<long>"


def _build(table: pa.Table) -> pa.Table:
    keys = table.column("pair").to_numpy()
    made = PerfectHash.of(keys)
    laid = np.empty(len(keys), np.int64)
    laid[made.slots(keys)] = keys
    return pa.table({"block": table.column("block")[:1], "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
                     "words": pa.array([made.words.view(np.int64)], pa.list_(pa.int64())),
                     "keys": pa.array([laid], pa.list_(pa.int64()))}).cast(
        pa.schema([("block", pa.int32()), *[(n, pa.list_(pa.int64())) for n in ("sizes", "words", "keys")]]))


def _rows(chunks: DataFrame, blocks: int) -> DataFrame:
    """``chunk, pair, docs, block`` for every distinct pair of a chunk."""
    flat = chunks.select("chunk", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("docs").alias("docs"))))
    return flat.withColumn("block", (F.col("pair") % _PRIME % blocks).cast("int"))


def perfect_hash(rows: DataFrame) -> DataFrame:
    """The hash of each block (``block, sizes, words``) and its pairs by slot (``keys``), written."""
    return settle(rows.select("block", "pair").distinct().groupBy("block").applyInArrow(_build, _TABLE), "pair-hash")


def _one(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy()


def _check(keys: np.ndarray, slots: np.ndarray, pairs: np.ndarray) -> None:
    if (slots < 0).any() or (keys[slots] != pairs).any():
        raise ValueError("a pair is not in the table of pairs")


def _verified(table: pa.Table, pairs: np.ndarray) -> np.ndarray:
    slots = _hash_of(_one(table, "sizes").tolist(), _one(table, "words")).slots(pairs)
    _check(_one(table, "keys"), slots, pairs)
    return slots


_COUNTS = "block int, part int, counts array<long>"


def _count(key, rows: pa.Table, table: pa.Table) -> pa.Table:
    counts = np.zeros(len(_one(table, "keys")), np.int64)
    if rows.num_rows:
        np.add.at(counts, _verified(table, rows.column("pair").to_numpy()), rows.column("docs").to_numpy())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "counts": pa.array([counts], pa.list_(pa.int64()))})


def _add(table: pa.Table) -> pa.Table:
    vectors = table.column("counts").combine_chunks()
    total = vectors.flatten().to_numpy().reshape(len(vectors), -1).sum(axis=0)
    return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1],
                     "counts": pa.array([total], pa.list_(pa.int64()))}).cast(
        pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))]))


def _salted(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.hash("chunk"), F.lit(parts)).cast("int"))


def _for_parts(table: DataFrame, parts: int) -> DataFrame:
    return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def counted(rows: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """``block, counts``: the documents of each pair, by slot."""
    vectors = _salted(rows, parts).groupBy("block", "part").cogroup(
        _for_parts(table, parts).groupBy("block", "part")).applyInArrow(_count, _COUNTS)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(
            _add, _COUNTS)
    return vectors.select("block", "counts")


class OwnCounts:
    """The counts a chunk has brought with it: its pairs in ascending order."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.pairs, pairs)]


class AllCounts:
    """The counts of all pairs: by block the perfect hash, the pairs by slot and their counts."""

    def __init__(self, table: pa.Table, blocks: int):
        self.blocks = blocks
        self.by_block = {
            row["block"]: (_hash_of(row["sizes"], np.array(row["words"], np.int64)), np.array(row["keys"], np.int64),
                           np.array(row["counts"], np.int64)) for row in table.to_pylist()}

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        distinct = _distinct(pairs)
        back = np.searchsorted(distinct, pairs)
        block = distinct % _PRIME % self.blocks
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(self.blocks + 1))
        out = np.empty(len(distinct), np.int64)
        for i in np.flatnonzero(np.diff(ends)):
            at = order[ends[i]:ends[i + 1]]
            hash_, keys, counts = self.by_block[int(i)]
            slots = hash_.slots(distinct[at])
            _check(keys, slots, distinct[at])
            out[at] = counts[slots]
        return out[back]


def _results(path_a: str, path_b: str, best, found):
    """The second pass. ``found`` is the table of all counts, or None where each chunk brings its own (``counts``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, most = cutter(path_a, path_b).lengths, best.value
        words = marked(list(map(len, lengths)))
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                n_segments, n_a, n_b = (cell[k].values.to_numpy().astype(np.int64) for k in ("n_segments", "n_a", "n_b"))
                ids = [_unpacked(cell[k], len(n)) for k, n in (*zip("ab", lengths), ("segments", n_a))]
                made = Aligned(*ids[:2], n_a, n_b, lengths)
                n_links, pair = made.links()
                look = found.value if found is not None else OwnCounts(
                    cell["pairs"].values.to_numpy(), cell["counts"].values.to_numpy())
                count = look(pair)
                top = count == most[pair // len(lengths[1])]
                # Numbers of each segment, then of the documents they are in.
                columns = [n_a, n_b, made.n_groups, n_links, *[_sums(x, n_links) for x in (top.astype(np.int64), count)]]
                columns = [_sums(x[ids[2]], n_segments) for x in columns]
                said = made.spelt(words)
                ends = np.cumsum(n_segments).tolist()
                whole = ids[2].tolist()
                digests = [hashlib.sha256(";".join(map(said.__getitem__, whole[a:b])).encode()).hexdigest() if a < b else ""
                           for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [cell["doc_ids"].values, *[pa.array(c) for c in columns], pa.array(digests, pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the next ``n[0]``, ``n[1]``, ... values."""
    through = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return through[ends] - through[ends - n]


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _give(key, rows: pa.Table, table: pa.Table) -> pa.Table:
    pairs = rows.column("pair").to_numpy()
    counts = _one(table, "counts")[_verified(table, pairs)] if len(pairs) else pairs
    return pa.table({"chunk": rows.column("chunk"), "pair": rows.column("pair"), "count": pa.array(counts, pa.int64())})


def align(docs: DataFrame, path_a: str = f"{FOLDER}/{FILE_A}", path_b: str = f"{FOLDER}/{FILE_B}", blocks: int = BLOCKS,
          rows_per_task: int = ROWS_PER_TASK, most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` are links whose pair has the highest count of all pairs with its A id, ``count_sum`` adds the
    counts of all links, and the digest is of ``a1,a2|b1;a3|b2,b3``.
    """
    spark = docs.sparkSession
    chunks = chunked(docs, path_a, path_b)
    rows = _rows(chunks, blocks)
    size_a, size_b = map(len, cutter(path_a, path_b).lengths)
    table = perfect_hash(rows)
    total = chunks.agg(F.sum(F.size("pairs"))).first()[0] or 0
    parts = max(1, math.ceil(total / blocks / rows_per_task))
    full = settle(table.join(counted(rows, table, parts), "block"), "pair-counts")

    # One row for an id of A, however long the corpus is.
    flat = full.select(F.inline(F.arrays_zip(F.col("keys").alias("pair"), F.col("counts").alias("count"))))
    tops = flat.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("count").alias("count")).toArrow()
    most = np.zeros(size_a, np.int64)
    most[tops["a"].to_numpy()] = tops["count"].to_numpy()
    best = spark.sparkContext.broadcast(most)

    held = full.agg(F.sum(F.size("keys"))).first()[0] or 0
    if held <= most_sent:
        found = spark.sparkContext.broadcast(AllCounts(full.toArrow(), blocks))
        return chunks.drop("pairs", "docs", "chunk").mapInArrow(_results(path_a, path_b, best, found), _OUT)
    given = _salted(rows, parts).groupBy("block", "part").cogroup(
        _for_parts(full, parts).groupBy("block", "part")).applyInArrow(_give, "chunk long, pair long, count long")
    back = given.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "count"))).alias("found")).select(
        "chunk", F.col("found.pair").alias("pairs"), F.col("found.count").alias("counts"))
    whole = chunks.drop("pairs", "docs").join(back, "chunk", "left")
    none = F.array().cast("array<long>")
    return whole.select("doc_ids", "n_segments", "n_a", "n_b", "a", "b", "segments", F.coalesce("pairs", none).alias("pairs"),
                        F.coalesce("counts", none).alias("counts")).mapInArrow(_results(path_a, path_b, best, None), _OUT)
