"""The named queries of the text operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.llm import (
    alignment, chat, dart_minhash, decontamination, edit_embedding, euclidean_lsh, language, line_dedup, mixing, ordinal,
    resampling, substring_dedup, tree_weighting,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.found_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.col("kept").alias("text"))


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edited_likeness(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(table(spark, sf_dir, "documents"))
    sources, pieces = mixing.mix(docs, weights=[3, 1, 2])
    return mixing.taken(docs, sources, pieces).drop("row")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.examples(turns))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows", "kept")


def op8_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", language.held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return tree_weighting.score(docs)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", language.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = language.LanguageId.fit(docs.where("NOT held_out"))
    return docs.select("doc_id", "held_out", model.predict(F.col("text")).alias("told")).select(
        "doc_id", "held_out", F.col("told.lang").alias("lang_pred"), "told.score")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for toxic, 1 for low quality, 2 for neither. Selected: more likely than not of the highest grade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal.QualityModel.fit(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))
    rated = docs.select("doc_id", model.rate(F.col("text")).alias("rate"))
    return rated.select("doc_id", "rate.expected_grade", "rate.tail_probability",
                        (F.col("rate.tail_probability") >= 0.5).alias("selected"))


def op11_euclidean_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclidean_lsh.link(table(spark, sf_dir, "embeddings")).drop("row")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_edit_embedding": op3_edit_embedding,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_tree_weighting": op8_tree_weighting,
    "op9_language_id": op9_language_id,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_euclidean_lsh": op11_euclidean_lsh,
    "op12_resampling": op12_resampling,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op2_line_dedup": r"""
WITH keyed AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id, 9223372036854775807) AS ord FROM documents),
lines AS (
  SELECT r, ord, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT r, ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM keyed)),
solid AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS pos FROM lines WHERE bare <> ''),
pairs AS (SELECT r, ord, pos, bare || chr(10) || lead(bare) OVER (PARTITION BY r ORDER BY pos) AS name FROM solid),
later AS (
  SELECT r, pos FROM (
    SELECT r, pos, row_number() OVER (PARTITION BY name ORDER BY ord, r, pos) AS n FROM pairs WHERE name IS NOT NULL)
  WHERE n > 1),
long_later AS (
  SELECT r, pos FROM (
    SELECT r, pos, row_number() OVER (PARTITION BY bare ORDER BY ord, r, pos) AS n FROM solid
    WHERE len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) > 50)
  WHERE n > 1),
gone AS (SELECT DISTINCT r, a AS pos FROM (SELECT r, unnest([pos, pos + 1]) AS a FROM later UNION ALL FROM long_later)),
marked AS (
  SELECT l.r, l.i, l.line, s.pos, g.pos AS dropped
  FROM lines l LEFT JOIN solid s ON s.r = l.r AND s.i = l.i LEFT JOIN gone g ON g.r = l.r AND g.pos = s.pos),
kept AS (
  SELECT r, count(pos) AS n_lines, count(dropped) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE dropped IS NULL), '') AS text
  FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM keyed d LEFT JOIN kept k USING (r)
""",
    "op4_mixing": r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, (source_size * 2)::DOUBLE AS cap, (source_size * 2)::DOUBLE / weight AS cap_of FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap_of, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap_of, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM caps),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE level <= cap_of) * weight) AS target FROM levels),
played AS (
  SELECT d.*, t.source_size, t.target, e.epoch, md5(e.epoch::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')) AS hash
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)),
placed AS (
  SELECT *, epoch * source_size + sum(size) OVER (PARTITION BY source, epoch ORDER BY hash, doc_id, size, r) AS stop FROM played)
SELECT doc_id, size, source_size, target,
       sum(greatest(0, least(stop, floor(target)::BIGINT) - (stop - size)))::BIGINT AS taken
FROM placed GROUP BY r, doc_id, size, source_size, target
""",
    "op5_substring_dedup": r"""
WITH keyed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS ord,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
windows AS (
  SELECT r, ord, p, array_to_string(words[p:p + 12], ' ') AS name
  FROM (SELECT *, unnest(range(1, len(words) - 11)) AS p FROM keyed)),
later AS (SELECT r, p FROM (SELECT *, min(ord) OVER (PARTITION BY name) AS first FROM windows) WHERE ord > first),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM later),
words AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM keyed),
kept AS (
  SELECT r, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g USING (r, i) GROUP BY r)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM keyed d LEFT JOIN kept k USING (r)
""",
    "op6_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
formatted AS (
  SELECT *, length(regexp_replace(text, '[\\<\[]', '__', 'g'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
           ELSE 18 + length(regexp_replace(role, '[\\<\[]', '__', 'g')) END AS chars
  FROM turns),
upto AS (
  SELECT *, sum(chars) OVER w AS prefix, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM formatted WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(prefix) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id
""",
    "op11_euclidean_lsh": r"""
WITH RECURSIVE
v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(list_filter(embedding, lambda x: x <> 0)) > 0
                  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding), false) AS usable
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.r AS i, b.r AS j FROM v a JOIN v b ON a.r <> b.r AND a.usable AND b.usable AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(i, j) AS (SELECT r, r FROM v UNION SELECT reach.i, links.j FROM reach JOIN links ON reach.j = links.i),
least AS (SELECT i, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.j GROUP BY i),
counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id IS NOT DISTINCT FROM l.component_id AS kept
FROM v JOIN least l ON l.i = v.r LEFT JOIN counts c ON c.i = v.r
""",
    "op12_resampling": r"""
WITH tables AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
cut AS (
  SELECT side, r, id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM texts),
words AS (SELECT side, r, unnest(words) AS word FROM cut),
bytes AS (
  SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM words)),
buckets AS (
  SELECT word, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM bytes, tables),
counts AS (
  SELECT b.bucket, count(*) FILTER (WHERE w.side = 0) AS s, count(*) FILTER (WHERE w.side = 1) AS t
  FROM words w JOIN buckets b USING (word) GROUP BY b.bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE
                                 / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts),
sums AS (
  SELECT w.r, sum(g.gain)::BIGINT AS total FROM words w JOIN buckets b USING (word) JOIN gains g USING (bucket)
  WHERE w.side = 0 GROUP BY w.r),
scored AS (
  SELECT c.r, c.id AS doc_id, len(c.words) AS n_features,
         CASE WHEN len(c.words) = 0 THEN 0 ELSE (total - ((total % len(c.words)) + len(c.words)) % len(c.words)) // len(c.words) END AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(c.id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM cut c LEFT JOIN sums USING (r) WHERE c.side = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight::BIGINT AS weight, (s.weight + s.noise)::BIGINT AS score,
       CASE WHEN k.rank <= 10 * k.n // 100 THEN k.rank END AS rank
FROM scored s LEFT JOIN ranked k USING (r)
""",
}
