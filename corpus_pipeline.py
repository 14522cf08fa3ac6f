"""From raw documents to a training mix: language, repeated lines, near copies, benchmark leaks, sources.

Every stage takes the documents its predecessor kept and is written before the next one reads
it. All but the last return the columns of their input. Nulls, empty texts, repeated rows and
further columns of any name pass through as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftflow.llm import dart_minhash, decontamination, line_dedup, mixing
from driftflow.llm.language import UNKNOWN, LanguageId
from driftflow.session import settle

# Texts with a smaller share of known runs of characters are in none of the languages learned. The least
# of 10,000 documents has 0.67 (one word), that of two words or more 0.79; foreign texts have 0.2 to 0.6.
LEAST_FAMILIAR = 0.65
WEIGHTS = [3, 1, 2]
LAST_ID = (1 << 63) - 1


def _rows(docs: DataFrame):
    """All columns as one, so that the names a stage works with can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Those without a text or letters go, and those of
    which less than ``LEAST_FAMILIAR`` is known from texts in their language. Learned from the documents' own ``lang``; without
    any, nothing can be told and every document with letters stays."""
    model = LanguageId.fit(docs)
    told = docs.select(_rows(docs).alias("row"), "text").withColumn("told", model.predict(F.col("text")))
    if not model.languages:
        return docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    return told.where((F.col("told.lang") != UNKNOWN) & (F.col("told.familiar") >= LEAST_FAMILIAR)).select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines, and the lines of more than ``line_dedup.LONG_LINE`` words, that were there before; ``n_chars``, if there, is counted anew.
    A document of which nothing is left goes; a null, empty or blank text stays as it is."""
    out = line_dedup.dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least id (null last)."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord")
    kept = dart_minhash.dedup(docs).where("kept").select(order, "th")
    rows = docs.select(_rows(docs).alias("row"), order, F.xxhash64("text").alias("th")).join(kept, ["ord", "th"])
    same = W.partitionBy("ord", "th").orderBy(F.xxhash64("row"))
    return rows.withColumn("copy", F.row_number().over(same)).where("copy = 1").select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no (edited) copy of a benchmark item."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("th", "size").distinct()
    rows = docs.select(_rows(docs).alias("row"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))
    return rows.join(found, ["th", "size"], "left_anti").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with a struct column ``mix`` (named ``mix_`` and so on
    where that is taken): ``size, source_size, target, taken, first_slot``."""
    numbered = settle(docs.select(_rows(docs).alias("row_"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    small = settle(numbered.select("row", F.col("row_.doc_id").cast("long").alias("doc_id"), "row_.source",
                                   mixing.word_count(F.col("row_.text")).alias("size")), "mix-documents")
    sources, pieces = mixing.mix(small, WEIGHTS)
    pieces = settle(pieces, "mix-pieces")
    first = pieces.groupBy("row").agg(F.min("slot").alias("first_slot"))
    told = mixing.taken(small, sources, pieces).where("taken > 0").join(first, "row").select(
        "row", F.struct("size", "source_size", "target", "taken", "first_slot").alias("mix"))
    name = "mix"
    while name in docs.columns:
        name += "_"
    return numbered.join(told, "row").select("row_.*", F.col("mix").alias(name))


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

# The first stage learns its model, which SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
