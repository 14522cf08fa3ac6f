"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are compared without blanks at their ends; blank lines are neither compared nor
removed. A run is ``run`` consecutive lines (blank ones left out). A line goes if it is in a
run that also starts earlier: in a document of smaller id (null counts as the largest; among
equal ids by hash of the text), or higher up in the same document. Equal rows count as one
document. Runs are judged on the input, not on what is left of it.

The smallest line hash of every run is its fingerprint, so equal runs share one. Only runs
whose fingerprint is at two places or more are compared; each is matched with the first place
it has, and matches that continue each other up and down are joined to one repeat.

A line of more than ``long_line`` words is a run by itself as well: it goes if it stood earlier,
whatever is around it, also where it is a document's only line. None leaves such lines to the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.llm.mixing import WORD
from driftflow.session import settle

BLANKS = " \t\r"
LAST_ID = (1 << 63) - 1
LONG_LINE = 50


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(docs: DataFrame) -> DataFrame:
    """``ord, th, text``: what a document is known by."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"),
                       F.xxhash64("text").alias("th"), "text")


def runs(docs: DataFrame, run: int = 2) -> DataFrame:
    """Every run of lines: ``ord, th, at`` (place among the lines that are not blank), ``mark`` (fingerprint), ``name``."""
    bare = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    lines = _key(docs).dropDuplicates(["ord", "th"]).select(
        "ord", "th", F.transform(bare, lambda x: F.xxhash64(x)).alias("lines")).where(F.size("lines") >= run)

    def window(at: Column) -> Column:
        part = F.slice("lines", at + 1, run)
        return F.struct(at.alias("at"), F.array_min(part).alias("mark"), F.xxhash64(part).alias("name"))

    starts = F.sequence(F.lit(0), F.size("lines") - run)
    return lines.select("ord", "th", F.inline(F.transform(starts, window)))


def repeats(docs: DataFrame, run: int = 2) -> DataFrame:
    """Repeated stretches of lines: ``ord, th, low, high`` (both within), and where they were first: ``ord0, th0, low0``."""
    windows = settle(runs(docs, run), "line-runs")
    place = F.struct("ord", "th", "at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a < _b").select("mark")
    shared = windows.join(marks, "mark", "left_semi")
    first = shared.groupBy("mark", "name").agg(F.min(place).alias("first"))
    later = shared.join(first, ["mark", "name"]).where(place > F.col("first")).select(
        "ord", "th", "at", F.col("first.ord").alias("ord0"), F.col("first.th").alias("th0"),
        (F.col("at") - F.col("first.at")).alias("shift"))
    line_up = W.partitionBy("ord", "th", "ord0", "th0", "shift").orderBy("at")
    opens = F.when(F.col("at") - F.lag("at").over(line_up) == 1, 0).otherwise(1)
    stretch = later.withColumn("_open", opens).withColumn("_n", F.sum("_open").over(line_up))
    return stretch.groupBy("ord", "th", "ord0", "th0", "shift", "_n").agg(
        F.min("at").alias("low"), (F.max("at") + run - 1).alias("high")
    ).select("ord", "th", "low", "high", "ord0", "th0", (F.col("low") - F.col("shift")).alias("low0"))


def long_repeats(docs: DataFrame, long_line: int) -> DataFrame:
    """Lines of more than ``long_line`` words that stood earlier: ``ord, th, at``."""
    bare = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != "")
    named = F.transform(bare, lambda x, i: F.struct(
        i.alias("at"), F.when(F.regexp_count(x, F.lit(WORD)) > long_line, F.xxhash64(x)).alias("name")))
    lines = _key(docs).dropDuplicates(["ord", "th"]).select(
        "ord", "th", F.inline(F.filter(named, lambda x: x["name"].isNotNull())))
    lines = settle(lines, "long-lines")
    place = F.struct("ord", "th", "at")
    first = lines.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("_last")).where("first < _last")
    return lines.join(first, "name").where(place > F.col("first")).select("ord", "th", "at")


def dedup(docs: DataFrame, run: int = 2, long_line: int | None = LONG_LINE) -> DataFrame:
    """All rows and columns of ``docs`` as a struct ``row``, with ``n_lines`` (not blank), ``n_removed``, ``kept`` (the text left)."""
    gone = F.flatten(F.collect_list(F.sequence("low", "high")))
    spans = repeats(docs, run).select("ord", "th", "low", "high")
    if long_line is not None:
        spans = spans.union(long_repeats(docs, long_line).select("ord", "th", "at", "at"))
    gone = spans.groupBy("ord", "th").agg(F.array_distinct(gone).alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    keys = whole.select("row", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"),
                        F.xxhash64("text").alias("th"))
    joined = keys.join(gone, ["ord", "th"], "left").withColumn("lines", F.split("text", "\n"))
    numbers = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _bare(F.get("lines", i)) != "")
    joined = joined.withColumn("solid", F.coalesce(numbers, F.array().cast("array<int>")))
    dropped = F.transform("gone", lambda i: F.get("solid", i))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select("row", F.size("solid").cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
