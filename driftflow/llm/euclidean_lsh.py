"""Embedding near-duplicates: p-stable hashing of normalised vectors, exact cosines after it.

On the unit sphere a cosine is a Euclidean distance. A table hashes a vector by ``depth``
quantised random projections (Gaussian, so the width of a projected difference follows the
distance); vectors with the same whole numbers share a bucket. The number of projections
follows the number of vectors, so that two unrelated ones share a bucket of one table with
probability ``STRAY / vectors``, and the number of tables follows from that: a pair at just the
wanted cosine shares none with probability ``MISS``, a closer one far less.

Equal vectors are one node with a weight. What a bucket holds is never paired off. First, each
node is compared with the least node of every bucket it shares. A node that no smaller one is
within half the wanted angle of leads a ball; the others join the least such leader. Any two
in a ball are within the wanted angle, so a large group of near copies costs a row for each
member and nothing for its pairs. Balls that meet in a bucket are then compared by their
leaders: with the radii of both, the angle says that all members are linked, that none are,
or neither. Only for the last do members look at the other ball's leader, and those whose
links are still open are compared in blocks of ``BLOCK``, inside tasks. Every link is either
verified by the cosine in double precision, or follows from angles with a margin far above
their rounding.

Null vectors, those without components, with null or not finite ones, and zero vectors link
with nothing, nor do vectors of different lengths. Null ids and repeated rows are vectors like
others; a null id is never the least of its component, a component without ids has none.
Labels and further columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.llm import arrays
from driftflow.llm.groups import components
from driftflow.session import settle

SIMILAR = 0.95
WIDTH = 2.0
MISS = 1e-3
STRAY = 0.05
SEED = 11
BLOCK = 1024
# Angles closer to a bound than this are not decided by it.
MARGIN = 1e-6
_BATCH = 4096


def meets(distance: float, width: float) -> float:
    """Probability that one quantised projection is equal for two points at a distance (Datar et al., 2004)."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """How many projections a table has, and how many tables there are."""

    depth: int
    count: int
    width: float = WIDTH
    seed: int = SEED

    @classmethod
    def of(cls, vectors: int, similar: float = SIMILAR, miss: float = MISS, width: float = WIDTH, seed: int = SEED) -> Tables:
        unrelated, near = meets(math.sqrt(2), width), meets(math.sqrt(2 - 2 * similar), width)
        depth = max(1, math.ceil(math.log(max(vectors, 1) / STRAY) / -math.log(unrelated)))
        return cls(depth, math.ceil(math.log(miss) / math.log1p(-near ** depth)), width, seed)

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dim])
        return rng.standard_normal((dim, self.depth * self.count)), rng.random(self.depth * self.count) * self.width

    def keys(self, units: np.ndarray, lines: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Bucket of each unit vector in each table."""
        cells = np.floor((units @ lines + shifts) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(units), self.count, self.depth)
        key = np.broadcast_to(np.arange(1, self.count + 1, dtype=np.uint64) + np.uint64(units.shape[1] << 32), cells.shape[:2])
        for i in range(self.depth):
            key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors (doubles) of a column of vectors, for each length there is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _bucket_keys(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {}
        for whole in batches:
            step = max(1, min(_BATCH, (2 << 20) // (tables.count * tables.depth)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                for rows, unit in units(batch.column("vector")):
                    if unit.shape[1] not in drawn:
                        drawn[unit.shape[1]] = tables.projections(unit.shape[1])
                    keys = tables.keys(unit, *drawn[unit.shape[1]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(pa.array(rows)),
                         arrays.lists(arrays.signed(np.ascontiguousarray(keys)).ravel(), np.full(len(rows), tables.count), pa.int64())],
                        names=["node", "buckets"])
    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``x, y`` to ``cos``; vectors of different lengths have none."""
    for batch in batches:
        n = batch.num_rows
        cos = np.full(n, -2.0)
        sides = [batch.column(c) for c in "xy"]
        same = np.flatnonzero(sides[0].value_lengths().to_numpy() == sides[1].value_lengths().to_numpy())
        pick = pa.array(same)
        for (rows, a), (_, b) in zip(units(sides[0].take(pick)), units(sides[1].take(pick))):
            cos[same[rows]] = np.einsum("ij,ij->i", a, b)
        kept = [i for i, c in enumerate(batch.schema.names) if c not in "xy"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(cos)],
                                         names=[*[batch.schema.names[i] for i in kept], "cos"])


def _with_cosine(rows: DataFrame) -> DataFrame:
    """``cos`` of the vectors ``x`` and ``y`` in their place."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in "xy"]
    return rows.mapInArrow(_cosines, ", ".join([*kept, "cos double"]))


def _angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


class _Reach:
    """Whether members of two balls may be linked, and whether they all are, by the angle of their leaders."""

    def __init__(self, similar: float):
        self.similar, self.limit = similar, math.acos(similar)

    def __call__(self, cos: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = np.arccos(np.clip(cos, -1, 1))
        near = np.where(radii == 0, cos >= self.similar, angle - radii <= self.limit + MARGIN)
        return near, near & ((radii == 0) | (angle + radii <= self.limit - MARGIN))


_PAIRS = "p long, q long, sure boolean"


def _pair_batch(one: np.ndarray, other: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other), pa.int64()), pa.array(np.maximum(one, other), pa.int64()),
                                       pa.array(sure, pa.bool_())], names=["p", "q", "sure"])


def _near_in_small(similar: float):
    """Pairs of balls of the same bucket that may be linked; rows come bucket by bucket, whole buckets are looked
    at together by comparing each row with the 1st, 2nd, ... after it."""
    reach = _Reach(similar)

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, ball, radius = (table.column(c).to_numpy() for c in ("bucket", "ball", "radius"))
        for rows, unit in units(table.column("vector")):
            first = np.arange(len(rows) - 1)
            step = 0
            while len(first):
                step += 1
                first = first[first + step < len(rows)]
                first = first[bucket[rows[first]] == bucket[rows[first + step]]]
                a, b = rows[first], rows[first + step]
                near, sure = reach(np.einsum("ij,ij->i", unit[first], unit[first + step]), radius[a] + radius[b])
                if near.any():
                    yield _pair_batch(ball[a[near]], ball[b[near]], sure[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if table.num_rows:
                bucket = table.column("bucket").to_numpy()
                whole = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
                yield from pairs(table.slice(0, whole).combine_chunks())
                rest = table.slice(whole)
        if rest is not None:
            yield from pairs(rest.combine_chunks())
    return run


def _near_balls(similar: float):
    """Pairs of balls in two blocks of one bucket that may be linked. ``sure``: all their members are."""
    reach = _Reach(similar)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ball, radius, block = (table.column(c).to_numpy() for c in ("ball", "radius", "block"))
        two = table.column("two")[0].as_py()
        found = []
        for rows, unit in units(table.column("vector")):
            first = np.flatnonzero(block[rows] == block.min())
            other = np.flatnonzero(block[rows] != block.min()) if two else first
            for at in range(0, len(first), 256):
                mine = first[at:at + 256]
                near, sure = reach(unit[mine] @ unit[other].T, radius[rows[mine]][:, None] + radius[rows[other]][None, :])
                if not two:
                    near &= ball[rows[mine]][:, None] < ball[rows[other]][None, :]
                i, j = np.nonzero(near)
                found.append(_pair_batch(ball[rows[mine[i]]], ball[rows[other[j]]], sure[i, j]))
        return pa.Table.from_batches(found, schema=_pair_batch(*[np.zeros(0, np.int64)] * 2, np.zeros(0, bool)).schema)
    return run


def _open_links(similar: float):
    """Links of open members of two balls, in one block of either: how many rows each is linked with."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, weight, first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "first"))
        out = np.zeros(len(node), np.int64)
        for rows, unit in units(table.column("vector")):
            a, b = rows[first[rows]], rows[~first[rows]]
            ua, ub = unit[first[rows]], unit[~first[rows]]
            for at in range(0, len(a), 256):
                linked = ua[at:at + 256] @ ub.T >= similar
                out[a[at:at + 256]] += linked @ weight[b]
                out[b] += linked.T @ weight[a[at:at + 256]]
        some = out > 0
        return pa.table({"p": table.column("p"), "q": table.column("q"), "node": pa.array(node), "links": pa.array(out)}).filter(pa.array(some))
    return run


def _blocks(table: DataFrame, size: Column, key: Column, block: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(size / block).cast("int"))
    return table.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (``row, vec_id, h1, h2``: the vector's hash, null if it links with nothing), and the distinct
    vectors (``node, h1, h2, weight, vector``); both written."""
    if vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usable = _usable(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").select(
        "vec_id", *[F.when(usable, F.xxhash64(F.lit(i), "embedding")).alias(f"h{i}") for i in (1, 2)],
        F.when(usable, F.col("embedding")).alias("vector"))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    return rows.drop("vector"), settle(nodes, "vector-nodes")


def link(vectors: DataFrame, similar: float = SIMILAR, miss: float = MISS, width: float = WIDTH, seed: int = SEED,
         block: int = BLOCK) -> DataFrame:
    """``row, vec_id, n_links, component_id, kept`` of every row: how many other rows it is linked with, the least
    id it reaches by links, and whether that is its own."""
    limit = math.acos(similar)
    rows, nodes = nodes_of(vectors)
    tables = Tables.of(nodes.count(), similar, miss, width, seed)
    buckets = settle(nodes.select("node", "vector").mapInArrow(_bucket_keys(tables), "node long, buckets array<long>"), "vector-buckets")
    members = buckets.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail")
    members = settle(members.join(shared.drop("tail"), "bucket"), "shared-buckets")

    # Balls: a node joins the least leader within half the angle.
    x, y = (nodes.select(F.col("node").alias(n), F.col("vector").alias(v)) for n, v in (("node", "x"), ("head", "y")))
    met = members.where("node != head").select("node", "head").distinct().join(x, "node").join(y, "head")
    close = settle(_with_cosine(met).where(_angle(F.col("cos")) <= limit / 2 - MARGIN), "close-heads")
    led = close.select(F.col("node").alias("head")).distinct()
    joined = close.join(led, "head", "left_anti").groupBy("node").agg(F.min(F.struct("head", "cos")).alias("best"))
    ball_of = settle(nodes.select("node", "weight").join(joined, "node", "left").select(
        "node", "weight", F.coalesce("best.head", "node").alias("ball"),
        F.when(F.col("best").isNull(), 0.0).otherwise(_angle(F.col("best.cos")) + MARGIN).alias("angle")), "ball-members")
    balls = ball_of.groupBy("ball").agg(F.sum("weight").alias("rows"), F.max("angle").alias("radius"))
    balls = settle(balls.join(nodes.select(F.col("node").alias("ball"), "vector"), "ball"), "balls")

    # Balls that meet.
    at = members.select("bucket", "node").join(ball_of.select("node", "ball"), "node").select("bucket", "ball").distinct()
    several = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = _blocks(at.join(several, "bucket"), F.col("n"), F.col("ball"), block).join(balls.drop("rows"), "ball")
    small = dealt.where("blocks = 1").select("bucket", "ball", "radius", "vector").repartition("bucket").sortWithinPartitions("bucket")
    large = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "ball", "radius", "vector", "block", F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("last"), (F.col("block") != F.col("other")).alias("two"))
    met = small.mapInArrow(_near_in_small(similar), _PAIRS).unionByName(
        large.groupBy("bucket", "one", "last").applyInArrow(_near_balls(similar), _PAIRS))
    met = settle(met.distinct(), "ball-pairs")
    both = met.unionByName(met.select(F.col("q").alias("p"), F.col("p").alias("q"), "sure"))
    held = balls.select(F.col("ball").alias("q"), "rows", "radius", F.col("vector").alias("y"))
    sure = both.where("sure").join(held.select("q", "rows"), "q").groupBy(F.col("p").alias("ball")).agg(F.sum("rows").alias("links"))

    # Members of balls that may be linked in part look at the other leader.
    asked = both.where("NOT sure").join(held, "q").join(
        ball_of.select(F.col("ball").alias("p"), "node", "weight"), "p").join(x, "node")
    angle = _angle(F.col("cos"))
    looked = settle(_with_cosine(asked).select(
        "p", "q", "node", "weight", F.col("rows").alias("theirs"),
        F.when(angle + F.col("radius") <= limit - MARGIN, "all").when(angle - F.col("radius") > limit + MARGIN, "none")
        .otherwise("open").alias("state")), "members-asked")
    # An open member is linked with those of the other ball that are linked with all of its own.
    given = looked.where("state = 'all'").groupBy(F.col("p").alias("q"), F.col("q").alias("p")).agg(F.sum("weight").alias("given"))
    open_ = looked.where("state = 'open'")
    sizes = open_.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))
    ours = open_.join(sizes, ["p", "q"]).join(sizes.select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("n").alias("others")), ["p", "q"])
    ours = _blocks(ours, F.col("n"), F.col("node"), block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("others") / block).cast("int")) - 1)))
    first = F.col("p") < F.col("q")
    faced = ours.select(
        F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), first.alias("first"), "node", "weight",
        F.when(first, F.col("block")).otherwise(F.col("other")).alias("b0"),
        F.when(first, F.col("other")).otherwise(F.col("block")).alias("b1")).join(
        x.withColumnRenamed("x", "vector"), "node")
    faced = settle(faced.groupBy("p", "q", "b0", "b1").applyInArrow(_open_links(similar), "p long, q long, node long, links long"), "open-links")
    partly = looked.where("state = 'all'").select("node", F.col("theirs").alias("links")).unionByName(
        open_.join(given, ["p", "q"]).select("node", F.col("given").alias("links"))).unionByName(faced.select("node", "links"))
    partly = partly.groupBy("node").agg(F.sum("links").alias("partly"))

    # Components of balls.
    edges = met.where("sure").select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(
        looked.where("state = 'all'").select(F.col("p").alias("a"), F.col("q").alias("b"))).unionByName(
        faced.select(F.col("p").alias("a"), F.col("q").alias("b")))
    roots = components(edges).select(F.col("node").alias("ball"), "root")
    known = ball_of.join(balls.select("ball", "rows"), "ball").join(sure, "ball", "left").join(partly, "node", "left").join(
        roots, "ball", "left").select(
        "node", (F.col("rows") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("partly", F.lit(0))).alias("n_links"),
        F.coalesce("root", "ball").alias("root"))
    known = known.join(nodes.select("node", "h1", "h2"), "node")
    told = settle(rows.join(known, ["h1", "h2"], "left").select("row", "vec_id", "n_links", "root"), "linked-vectors")
    least = told.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return told.join(least, "root", "left").select(
        "row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.equal_null("vec_id", component).alias("kept"))
