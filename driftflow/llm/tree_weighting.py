"""Scoring texts by context-tree weighting over bytes.

A byte is eight binary decisions, each the inner node of a fixed tree over the 256 symbols.
Every such node has a context tree of its own, whose nodes are the last 0 to ``depth`` bytes;
each holds a Krichevsky-Trofimov estimate, and all depths are mixed by the weights that the
counts give them. A text is its bytes with A-Z in lower case, then an end symbol; before it
stand start symbols (two bytes that UTF-8 never uses).

Learning counts what follows each context, over all texts, in Spark, and keeps every context.
The runs of ``depth + 1`` symbols that are to be scored but were never learned from are added
with a count of 0, which changes no weight. Contexts that agree in their last ``depth - 2`` bytes
are mixed in one task, which holds at most 65,793 of them; the driver mixes the shorter contexts
(at most as many, with the weights summed by Spark). A second pass gives each run its log
probability, and a text is scored by adding up those of its runs: frequent runs are looked up in
a table of bounded size, the others by a join.

``TreeModel`` is the bounded form for those who ask for it by ``contexts``: the most frequent
contexts, and the others taken together as one further child of the longest kept one above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.session import settle

DEPTH = 5
CONTEXTS = 24_000  # of the bounded model
DEEPEST = 5
FREQUENT = 1 << 18
FREQUENT_RUNS = 1 << 21
START, END = 0xFE, 0xFF
_CHUNK = 1 << 20
_HELD = 1 << 21
_BLOCK = 1024
_RUNS = 1 << 16
_SORTED = 1 << 16
GRAM, TOKEN = 0, 1


def _symbols(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols with the start ones before each text, the places to be predicted, and each text's first of them."""
    data, ends = arrays.text_bytes(column)
    n = len(ends) - 1
    size = np.diff(ends)
    first = np.arange(n) * (depth + 1) + depth + ends[:-1]
    out = np.full(len(data) + n * (depth + 1), START, np.uint8)
    place = np.arange(len(data)) + np.repeat(first - ends[:-1], size)
    out[place] = arrays.LOWER[data]
    out[first + size] = END
    predicted = np.ones(len(out), bool)
    for k in range(1, depth + 1):
        predicted[first - k] = False
    return out, np.flatnonzero(predicted), np.concatenate([[0], np.cumsum(size + 1)])


def _codes(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of ``depth + 1`` symbols at each place to be predicted, as a number, and each text's first place."""
    symbols, at, first = _symbols(column, depth)
    code = symbols.astype(np.uint64)
    for k in range(1, depth + 1):
        code[k:] |= symbols[:-k].astype(np.uint64) << np.uint64(8 * k)
    return code[at], first


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Several pairs of keys and their counts as one, each key once."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _count(depth: int):
    """Counts of chunks are merged here while at most ``_HELD`` keys are held, which costs less than to hand them over."""
    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(keys), _RUNS):
            key, times = keys[low:low + _RUNS], n[low:low + _RUNS]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(key), kind, np.int8)), pa.array(arrays.signed(key)),
                pa.array(times.astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {GRAM: [], TOKEN: []}
        for batch in arrays.chunks(batches, limit=_CHUNK):
            column = batch.column("text")
            for kind, parts in held.items():
                keys = _codes(column, depth)[0] if kind == GRAM else arrays.Words(column, arrays.LOWER).hashes()
                parts.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in parts) > _HELD:
                    merged = _merged(parts)
                    parts.clear()
                    if len(merged[0]) > _HELD // 2:
                        yield from rows(kind, *merged)
                    else:
                        parts.append(merged)
        for kind, parts in held.items():
            if parts:
                yield from rows(kind, *_merged(parts))
    return run


def count(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind, key, n``: how often every run of ``depth + 1`` symbols and every word (lower case) occurs."""
    found = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(depth), "kind byte, key long, n long")
    return settle(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series beyond 8, the recurrence below."""
    low = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] *= y[small]
        y[small] += 1
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives to these counts in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 255 binary nodes, from the counts of 256 symbols (rows)."""
    n = len(counts)
    parts = [counts.reshape(n, 1 << level, 2, 128 >> level).sum(axis=3) for level in range(8)]
    return (np.concatenate([p[:, :, bit] for p in parts], axis=1) for bit in (0, 1))


def _symbol_logs(one: np.ndarray) -> np.ndarray:
    """Log10 probability of the 256 symbols, from the probability of a 1 at each binary node (rows)."""
    out = np.zeros((len(one), 1))
    for level in range(8):
        p = one[:, (1 << level) - 1:(2 << level) - 1]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], axis=2).reshape(len(one), 2 << level)
    return out.astype(np.float32)


class TreeModel:
    """The finished mixture: the way from context to context, and log10 probabilities of the next symbol."""

    def __init__(self, depth: int, ways: np.ndarray, logs: np.ndarray):
        self.depth, self.ways, self.logs = depth, ways, logs

    @classmethod
    def fit(cls, grams: DataFrame, depth: int = DEPTH, contexts: int = CONTEXTS) -> TreeModel:
        """``grams``: ``key, n`` of runs of ``depth + 1`` symbols."""
        masks = F.array(*[F.lit((1 << 8 * (d + 1)) - 1) for d in range(depth + 1)])
        parts = grams.select("n", "key", F.posexplode(masks).alias("d", "mask")).groupBy(
            "d", F.col("key").bitwiseAND(F.col("mask")).alias("code")).agg(F.sum("n").alias("n"))
        parts = settle(parts.withColumn("context", F.shiftright("code", 8)), "context-symbols")
        # A context is as frequent as those that end in it, or more, and comes before them here.
        kept = parts.groupBy("d", "context").agg(F.sum("n").alias("all")).orderBy(
            F.desc("all"), "d", "context").limit(contexts)
        # At most 256 symbols for each of them.
        rows = parts.join(kept.select("d", "context"), ["d", "context"]).select("d", "context", "code", "n").toArrow()
        rows = rows.sort_by([("d", "ascending"), ("code", "ascending")])
        return cls.of_counts(*(rows[c].to_numpy() for c in ("d", "context", "code", "n")), depth)

    @classmethod
    def of_counts(cls, d: np.ndarray, context: np.ndarray, code: np.ndarray, n: np.ndarray, depth: int) -> TreeModel:
        """``n`` of every symbol (the last byte of ``code``) after every kept context of ``d`` bytes."""
        names, tables = [], []
        for level in range(depth + 1):
            rows = d == level
            name, place = np.unique(context[rows], return_inverse=True)
            names.append(name if len(name) or level else np.zeros(1, np.int64))
            tables.append((place, code[rows] & 255, n[rows].astype(np.float64)))

        def dense(level: int, low: int, high: int) -> np.ndarray:
            """Counts of the 256 symbols for some contexts of a level; their rows are in order."""
            place, symbol, count = tables[level]
            a, b = np.searchsorted(place, (low, high))
            out = np.zeros((high - low, 256))
            out[place[a:b] - low, symbol[a:b]] = count[a:b]
            return out

        def blocks(level: int):
            return ((low, min(low + _BLOCK, len(names[level]))) for low in range(0, len(names[level]), _BLOCK))

        base = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        ways = np.full((base[depth], 256), -1, np.int32)  # the longest contexts lead nowhere
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        for level in range(1, depth + 1):
            # The oldest byte of a context leads to it from the context without that byte.
            parent = np.searchsorted(names[level - 1], names[level] & ((1 << 8 * (level - 1)) - 1))
            ways[base[level - 1] + parent, names[level] >> 8 * (level - 1)] = base[level] + np.arange(len(names[level]))
            parents.append(parent)
        # From the longest contexts to none: the weight of stopping at a context, of its own against its children's.
        # ``stop`` and ``on`` add up to 1; ``rest`` is what the children that were not kept predict together.
        weighted, stop, on, rest = None, [None] * depth, [None] * depth, [None] * depth
        for level in range(depth, -1, -1):
            size = len(names[level])
            now = np.empty((size, 255))
            if level < depth:
                below, other = np.zeros((size, 255)), np.zeros((size, 256))
                for low, high in blocks(level + 1):
                    np.add.at(below, parents[level + 1][low:high], weighted[low:high])
                    np.add.at(other, parents[level + 1][low:high], -dense(level + 1, low, high))
                stop[level], on[level], rest[level] = (np.empty((size, 255), np.float32) for _ in range(3))
            for low, high in blocks(level):
                counts = dense(level, low, high)
                own = _log_kt(*_decisions(counts))
                if level == depth:
                    now[low:high] = own
                    continue
                zeros, ones = _decisions(np.maximum(counts + other[low:high], 0))
                split = below[low:high] + _log_kt(zeros, ones)
                now[low:high] = np.logaddexp(own, split) - np.log(2)
                stop[level][low:high] = np.exp(own - np.log(2) - now[low:high])
                on[level][low:high] = np.exp(split - np.log(2) - now[low:high])
                rest[level][low:high] = (ones + 0.5) / (zeros + ones + 1)
            weighted = now
        del weighted, now
        # And back: what a context predicts is mixed from all those above it.
        logs = np.empty((base[-1], 256), np.float32)
        mixed, share = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
        for level in range(depth + 1):
            if level:
                mixed, share = mixed[parents[level]], share[parents[level]]
            for low, high in blocks(level):
                zeros, ones = _decisions(dense(level, low, high))
                own = (ones + 0.5) / (zeros + ones + 1)
                part = slice(low, high)
                if level == depth:
                    final = mixed[part] + share[part] * own
                else:
                    mixed[part] += share[part] * stop[level][part] * own
                    share[part] *= on[level][part]
                    final = mixed[part] + share[part] * rest[level][part].astype(np.float64)
                logs[base[level] + low:base[level] + high] = _symbol_logs(np.clip(final, 1e-12, 1 - 1e-12))
        return cls(depth, ways.ravel(), logs.ravel())

    def score(self, texts: pa.Array) -> np.ndarray:
        """Log10 probability of each text and its end."""
        symbols, at, first = _symbols(texts, self.depth)
        out = np.zeros(len(at))
        for low in range(0, len(at), 1 << 19):
            spots = at[low:low + (1 << 19)]
            state = np.zeros(len(spots), np.int64)
            live = np.ones(len(spots), bool)
            for k in range(1, self.depth + 1):
                # Those that have stopped are at a context of any length; where they look does not matter.
                goal = self.ways[np.where(live, state, 0) * 256 + symbols[spots - k]]
                live &= goal >= 0
                state = np.where(live, goal, state)
            out[low:low + len(spots)] = self.logs[state * 256 + symbols[spots]]
        return np.add.reduceat(out, first[:-1]) if len(first) > 1 else np.zeros(0)


def _decided(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight binary nodes that each run decides, each as ``context * 256 + node``, and the decisions (rows)."""
    level, symbol = np.arange(8), (code & 255)[:, None]
    return (code >> 8 << 8)[:, None] | (1 << level) + (symbol >> 8 - level), symbol >> 7 - level & 1


def _rise(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, high: int, low: int):
    """Mix nodes of contexts of ``high`` bytes, and of those above them down to ``low`` bytes.

    ``below``: sum of the children's log weights, None for the longest contexts. Returns for each length
    the place of the node above, the estimate, and the weights of stopping and going on; and what is known
    of the nodes of contexts of ``low - 1`` bytes: their names, counts, and ``below``."""
    levels = []
    for size in range(high, low - 1, -1):
        own = _log_kt(zeros, ones)
        one = (ones + 0.5) / (zeros + ones + 1)
        if below is None:
            weight, stop, on = own, None, None
        else:
            weight = np.logaddexp(own, below) - np.log(2)
            stop, on = (np.exp(x - np.log(2) - weight) for x in (own, below))
        # The oldest byte is the highest one; above no context there is one place for all.
        node, up = np.unique(node & ((1 << 8 * size) - 1) if size else np.zeros_like(node), return_inverse=True)
        zeros, ones, below = (np.bincount(up, x, len(node)) for x in (zeros, ones, weight))
        levels.append((up, one, stop, on))
    return levels, (node, zeros, ones, below)


def _fall(levels: list, mixed: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """And back: the mixture down to the nodes that ``_rise`` began with, and the share left to their children."""
    for up, one, stop, on in reversed(levels):
        mixed, share = mixed[up], share[up]
        if stop is None:
            return mixed + share * one, np.zeros_like(share)
        mixed, share = mixed + share * stop * one, share * on
    return mixed, share


def _families(batches: Iterator[pa.RecordBatch], mask: int) -> Iterator[pa.Table]:
    """Rows, sorted by the last bytes of the context, in pieces that don't part contexts which agree in them."""
    held, rows, limit = [], 0, _RUNS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        table = pa.Table.from_batches(held)
        family = table["key"].to_numpy() >> 8 & mask
        cut = int(np.searchsorted(family, family[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows -= cut
        limit = max(_RUNS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _mix(depth: int, least: int, above=None):
    """Without ``above``: the nodes of contexts of ``least - 1`` bytes. With it (their mixtures): the runs' log10 probabilities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _families(batches, (1 << 8 * least) - 1):
            code, n = table["key"].to_numpy(), table["n"].to_numpy()
            nodes, bit = _decided(code)
            node, place = np.unique(nodes.ravel(), return_inverse=True)
            n = np.repeat(n, 8)
            ones = np.bincount(place, n * bit.ravel(), len(node))
            zeros = np.bincount(place, n, len(node)) - ones
            levels, over = _rise(node, zeros, ones, None, depth, least)
            if above is None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in over], names=["node", "zeros", "ones", "below"])
                continue
            names, mixed, share = above.value
            at = np.searchsorted(names, over[0])
            one = np.clip(_fall(levels, mixed[at], share[at])[0], 1e-12, 1 - 1e-12)[place].reshape(-1, 8)
            logs = np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                pa.array(code), table["seen"].combine_chunks(), pa.array(logs.astype(np.float32))], names=["key", "seen", "log"])
    return run


def run_logs(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, seen, log``: log10 probability of the last symbol of every run after the others, all contexts kept.

    ``runs``: ``key, n, seen``, each key once; ``n`` is how often it was learned from, 0 for those only to be scored."""
    if depth > DEEPEST:
        raise ValueError(f"a depth over {DEEPEST} needs a bounded model: give contexts")
    least = max(0, depth - 2)
    family = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * least) - 1))
    dealt = runs.select("key", "n", "seen", family.alias("family")).repartition("family").sortWithinPartitions("family")
    if least:
        over = dealt.mapInArrow(_mix(depth, least), "node long, zeros double, ones double, below double")
        top = over.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().sort_by("node")
        node, *rest = (top[c].to_numpy() for c in ("node", "zeros", "ones", "below"))
        above = (node, *_fall(_rise(node, *rest, least - 1, 0)[0], np.zeros(1), np.ones(1)))
    else:
        above = (np.zeros(1, np.int64), np.zeros(1), np.ones(1))
    return settle(dealt.mapInArrow(_mix(depth, least, runs.sparkSession.sparkContext.broadcast(above)),
                                   "key long, seen long, log float"), "run-logs")


def _least_seen(runs: DataFrame, most: int) -> int:
    """The least power of 2 that at most ``most`` runs have been seen as often as."""
    bits = runs.groupBy(F.length(F.bin("seen")).alias("bits")).count().collect()
    least, total = 1 << 62, 0
    for row in sorted(bits, reverse=True):
        total += row["count"]
        if total > most:
            break
        least = 1 << row["bits"] - 1
    return least


def _places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def _looked_up(code: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of each run, 0 for those not in the table, and whether it is there.

    A block of runs is sorted with their places in one number (a run has six bytes at most), so that equal
    runs are searched once and in the table's order."""
    each, hit = np.zeros(len(code)), np.zeros(len(code), bool)
    for low in range(0, len(code), _SORTED):
        part = code[low:low + _SORTED]
        both = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
        key, place = both >> np.uint64(16), low + (both & np.uint64(_SORTED - 1)).astype(np.int64)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        at, there = _places(arrays.signed(key[fresh]), known)
        found = np.where(there, logs[at].astype(np.float64), 0.0) if len(known) else np.zeros(len(at))
        which = np.cumsum(fresh) - 1
        each[place], hit[place] = found[which], there[which]
    return each, hit


def _added(column: pa.Array, depth: int, known: np.ndarray, logs: np.ndarray):
    """Per text the sum over the runs in the table; the others, each once for a text, how often, and how many a text has."""
    code, first = _codes(column, depth)
    each, hit = _looked_up(code, known, logs)
    spots = np.flatnonzero(~hit)
    found, place = np.unique(code[spots], return_inverse=True)
    size = max(1, len(found))
    pair, times = np.unique((np.searchsorted(first, spots, "right") - 1) * size + place, return_counts=True)
    n = np.bincount(pair // size, minlength=len(first) - 1)
    return np.add.reduceat(each, first[:-1]), arrays.signed(found)[pair % size], times, n


def _score(depth, model, words, whole):
    """Per text: its score, its words, and what the frequent words and runs add; the others are listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None if whole else TreeModel(*model.value)
        known, logs = words.value
        for batch in arrays.chunks(batches):
            column = batch.column("text")
            found = arrays.Words(column, arrays.LOWER)
            keys = arrays.signed(found.hashes())
            at, hit = _places(keys, known)
            text, n = found.text_of(), batch.num_rows
            rare = keys[~hit]
            if whole:
                score, runs, times, each = _added(column, depth, *model.value)
            else:
                score, runs, times, each = tree.score(column), keys[:0], keys[:0], np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(found.count.astype(np.int64)),
                pa.array(np.bincount(text[hit], minlength=n)),
                pa.array(np.bincount(text[hit], logs[at[hit]], minlength=n), pa.float64()), pa.array(score),
                arrays.lists(rare, np.bincount(text[~hit], minlength=n), pa.int64()),
                arrays.lists(runs, each, pa.int64()), arrays.lists(times, each, pa.int64())],
                names=["doc_id", "held_out", "words", "known", "logs", "score", "rare", "runs", "times"])
    return run


def score(docs: DataFrame, depth: int = DEPTH, contexts: int | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` (``doc_id, text, held_out``) that are not held out, and score all.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is an
    empty one: its one token is the end. ``base_score`` counts words over all rows learned from: those
    that make up one part in ``FREQUENT`` or more are looked up in a table of that size at most, the
    others by a join; so are the runs of ``score``, ``FREQUENT_RUNS`` in the table at most. Every context is kept, or the
    ``contexts`` most frequent ones if that is given.
    """
    spark = docs.sparkSession
    train = docs.where("NOT held_out")
    counts = count(train, depth)
    tokens = counts.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), "n")
    ends = train.count()
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, distinct = totals[0] + ends, totals[1] + (ends > 0)
    top = tokens.where(F.col("n") * FREQUENT >= n).toArrow().sort_by("token")
    table = (top["token"].to_numpy(), np.log10(top["n"].to_numpy() + 1.0))
    learned = counts.where(F.col("kind") == GRAM).select("key", "n")
    send = spark.sparkContext.broadcast
    whole = contexts is None
    if whole:
        others = count(docs.where(F.coalesce("held_out", F.lit(True))), depth).where(F.col("kind") == GRAM)
        runs = learned.withColumn("seen", F.col("n")).unionByName(
            others.select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("seen")))
        runs = settle(runs.groupBy("key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "runs")
        logs_of = run_logs(runs, depth)
        often = F.col("seen") >= _least_seen(logs_of, FREQUENT_RUNS)
        seen = logs_of.where(often).select("key", "log").toArrow().sort_by("key")
        model = send((seen["key"].to_numpy(), seen["log"].to_numpy()))
    else:
        tree = TreeModel.fit(learned, depth, contexts)
        model = send((tree.depth, tree.ways, tree.logs))
    made = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _score(depth, model, send(table), whole),
        "doc_id long, held_out boolean, words long, known long, logs double, score double, rare array<long>, "
        "runs array<long>, times array<long>")
    made = settle(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = made.select("row", F.explode("rare").alias("token")).groupBy("row", "token").count()
    met = rare.join(tokens, "token").groupBy("row").agg(
        F.sum("count").alias("more"), F.sum(F.col("count") * F.log10(F.col("n") + 1)).alias("more_logs"))
    joined = made.drop("rare", "runs", "times").join(met, "row", "left")
    if whole:
        told = made.select("row", F.explode(F.arrays_zip("runs", "times")).alias("r")).select(
            "row", F.col("r.runs").alias("key"), "r.times")
        added = told.join(logs_of.where(~often), "key").groupBy("row").agg(
            F.sum(F.col("times") * F.col("log").cast("double")).alias("more_score"))
        joined = joined.join(added, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    size = F.col("words") + 1
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.log10(F.lit(ends + 1.0))
    return joined.select(
        "doc_id", "held_out", size.alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - size * F.log10(F.lit(n + distinct + 1.0))).alias("base_score"), "score")
