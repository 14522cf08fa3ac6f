"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``k`` of the mix has the van der Corput point of ``k`` (its binary digits mirrored
behind the point). The points are mapped through the cumulative weights of the sources, so
that every stretch of the mix holds each source in nearly its share. The slots of a source
are ranked, its shuffled documents are cut into as many blocks of equal size, and block
``j`` is played in the slot of rank ``j``.

A source is played up to ``epochs`` times, shuffled anew each time. Source tables are as
long as there are sources and are never collected; documents are carried as three numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.session import settle

WORD = r"[^\x20\x09-\x0D]+"
# Rows of one prefix sum, slots of one ranking, and cells the unit interval is cut into.
BUCKET_ROWS = 256
CHUNK_SLOTS = 4096
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source, source_size, rows`` of documents that have a ``size``."""
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))


def weighted(sources: DataFrame, weights: list[int]) -> DataFrame:
    """Weights in a repeating pattern over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pattern = F.array(*[F.lit(w) for w in weights])
    return sources.withColumn("weight", F.element_at(pattern, (rank % len(weights) + 1).cast("int")))


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``target``: the weight's part of ``share`` times all sizes, ``most`` times the source's size at
    most. What a source can't take is dealt out again by weight: that ends at one level, at which the
    sources with a smaller cap per weight are full and the others get level x weight."""
    before = W.orderBy("_cap_of", F.col("source").asc_nulls_last())
    caps = sources.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    caps = caps.withColumn("_cap_of", F.col("_cap") / F.col("weight"))
    everything = W.partitionBy()
    levels = caps.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("weight").over(before.rowsBetween(0, W.unboundedFollowing)),
        "_all": F.sum("source_size").over(everything).cast("double") * F.lit(share),
    }).withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    # Behind the first source that its level does not fill, the levels only fall.
    level = F.max(F.when(F.col("_level") <= F.col("_cap_of"), F.col("_level"))).over(everything)
    return levels.withColumn("_found", level).withColumn(
        "target", F.when(F.col("_found").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("weight")))
    ).select("source", "source_size", "rows", "weight", "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def streams(docs: DataFrame, sources: DataFrame, epochs: int) -> DataFrame:
    """Where each document stands in the shuffled words of its source: ``start`` and ``stop``.

    The order is that of ``md5(epoch:doc_id)``. Leading hash digits spread a source over buckets of
    about ``BUCKET_ROWS`` rows; sums within a bucket and over the buckets before it make the start.
    """
    d, s = docs.alias("d"), sources.alias("s")
    rows = d.join(s, _same(F.col("d.source"), F.col("s.source"))).select(
        "d.row", "d.doc_id", "d.size", "s.*").where("size > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.where(F.col("epoch") * F.col("source_size") < F.col("target"))
    rows = rows.withColumn("hash", F.md5(F.concat_ws(":", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    place = F.conv(F.substring("hash", 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = rows.withColumn("bucket", F.floor(place * F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long"))
    inside = W.partitionBy("source", "epoch", "bucket").orderBy("hash", "doc_id", "size", "row")
    rows = rows.withColumn("_before", F.sum("size").over(inside) - F.col("size"))
    totals = rows.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("_sum"))
    offsets = totals.withColumn(
        "_offset", F.sum("_sum").over(W.partitionBy("source", "epoch").orderBy("bucket")) - F.col("_sum")).drop("_sum")
    r, o = rows.alias("r"), offsets.alias("o")
    placed = r.join(o, _same(F.col("r.source"), F.col("o.source")) & (F.col("r.epoch") == F.col("o.epoch"))
                    & (F.col("r.bucket") == F.col("o.bucket")))
    start = F.col("epoch") * F.col("source_size") + F.col("_offset") + F.col("_before")
    return placed.select("r.*", "o._offset").withColumn("start", start).withColumn(
        "stop", F.least(F.col("start") + F.col("size"), F.floor("target"))
    ).where("stop > start").select("row", "doc_id", "source", "target", "epoch", "start", "stop")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``slot, source, rank`` of ``slots`` slots; a source that no point hits gets one slot at the end."""
    spark = sources.sparkSession
    upto = F.sum("target").over(W.orderBy(F.col("source").asc_nulls_last()))
    total = F.sum("target").over(W.partitionBy())
    parts = sources.where("target >= 1").withColumns({"high": upto / total, "low": (upto - F.col("target")) / total})
    top = F.floor(F.least(F.col("high"), F.lit(1 - 2.0 ** -40)) * CELLS)
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), top))).select(
        "source", "low", "high", "cell")
    digits = F.bin("slot")
    point = F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point)
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    hits = points.join(cells, "cell").where("low <= point AND point < high").select("slot", "source")
    missed = parts.alias("p").join(
        hits.groupBy("source").count().alias("h"), _same(F.col("p.source"), F.col("h.source")), "left_anti"
    ).select((F.lit(slots) + F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("slot"), "source")
    hits = hits.unionByName(missed).withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    counts = hits.groupBy("source", "chunk").count().withColumn(
        "_offset", F.sum("count").over(W.partitionBy("source").orderBy("chunk")) - F.col("count"))
    h, c = hits.withColumn("_rank", inside).alias("h"), counts.alias("c")
    ranked = h.join(c, _same(F.col("h.source"), F.col("c.source")) & (F.col("h.chunk") == F.col("c.chunk")))
    return ranked.select("h.slot", "h.source", (F.col("h._rank") + F.col("c._offset")).alias("rank"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2,
        block_words: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Mix documents (``row, doc_id, source, size``) to weighted targets.

    Returns the sources with their targets, and the pieces of the mix: ``slot, at`` (the order within
    the slot), ``row, doc_id, source, epoch, piece_from, piece_words`` (words of the document, from 0).
    No document is played more than ``most`` times. Null sources are one source; documents without
    words and sources without targets make no pieces.
    """
    sources = settle(with_targets(weighted(source_sizes(docs), weights), share, most), "mix-sources")
    goal = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = max(1, round(goal / block_words))
    spots = settle(schedule(sources, slots), "mix-slots")
    counts = spots.groupBy("source").count().withColumnRenamed("count", "slots")
    parts = streams(docs, sources, most).alias("p").join(
        counts.alias("n"), _same(F.col("p.source"), F.col("n.source"))).select("p.*", "n.slots")
    # Blocks of a source are as long as fills all its slots; the last one may be shorter.
    parts = parts.withColumn("block", F.greatest(F.lit(1), F.ceil(F.floor("target") / F.col("slots"))))
    pieces = parts.withColumn("rank", F.explode(F.sequence(F.expr("start div block"), F.expr("(stop - 1) div block"))))
    pieces = pieces.withColumns({
        "_low": F.greatest(F.col("start"), F.col("rank") * F.col("block")),
        "_high": F.least(F.col("stop"), (F.col("rank") + 1) * F.col("block")),
    })
    a, b = pieces.alias("a"), spots.alias("b")
    played = a.join(b, _same(F.col("a.source"), F.col("b.source")) & (F.col("a.rank") == F.col("b.rank")))
    return sources, played.select(
        "b.slot", F.col("a._low").alias("at"), "a.row", "a.doc_id", "a.source", "a.epoch",
        (F.col("a._low") - F.col("a.start")).alias("piece_from"),
        (F.col("a._high") - F.col("a._low")).alias("piece_words"))


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size`` of documents; written once, since the row numbers are used again."""
    return settle(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        word_count(F.col("text")).alias("size")), "mix-documents")


def taken(docs: DataFrame, sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per document what the mix takes of it: ``row, doc_id, size, source_size, target, taken``."""
    used = pieces.groupBy("row").agg(F.sum("piece_words").alias("taken"))
    d, s, u = docs.alias("d"), sources.alias("s"), used.alias("u")
    joined = d.join(s, _same(F.col("d.source"), F.col("s.source"))).join(u, F.col("d.row") == F.col("u.row"), "left")
    return joined.select(
        "d.row", "d.doc_id", "d.size", "s.source_size", "s.target", F.coalesce("u.taken", F.lit(0)).cast("long").alias("taken"))
