"""The pN_ queries and their SQL, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemesh.llm import cutoff, encodings, mixing, neighbours, pairs, sentences, split, subjects, tokens, topn
from passagemesh.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.found(table(spark, sf, "goldens"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.found(table(spark, sf, "articles"))


def _split_inputs(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("articles", "chunks", "split_limits")]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.found(*_split_inputs(spark, sf))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.oversized(*_split_inputs(spark, sf))


P3_SQL = r"""
WITH items AS (
  SELECT 'article' AS item_kind, url AS item_key, cleaned_text AS text, lower(split_part(replace(metadata.language, '_', '-'), '-', 1)) AS lang FROM articles
  UNION ALL SELECT 'chunk', chunk_id, text, NULL FROM chunks),
limited AS (
  SELECT i.item_kind, i.item_key, i.text, coalesce(own.max_chars, def.max_chars) AS max_chars
  FROM items i LEFT JOIN split_limits own ON own.item_kind = i.item_kind AND own.lang = i.lang
  JOIN split_limits def ON def.item_kind = i.item_kind AND def.lang = '*'
  WHERE i.item_key IS NOT NULL AND i.text IS NOT NULL)
SELECT DISTINCT item_kind, item_key,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？؟।…｡]'), lambda x: length(x))) > max_chars THEN 'hard' ELSE 'natural' END AS cut_kind
FROM limited WHERE length(text) > max_chars
"""


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.found(table(spark, sf, "goldens"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.report(table(spark, sf, "goldens"))


def _subject_inputs(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("document_nodes", "theme_results", "subject_examples", "subjects")]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.found(*_subject_inputs(spark, sf))


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.shares(*_subject_inputs(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_clamped_mix(spark: SparkSession, sf: str) -> DataFrame:
    """A mix as large as the corpus: small sources are clamped at max_repeats, the others share the excess."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), mixing.CORPUS)


def p9_clamped_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), mixing.CORPUS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.best_targets(table(spark, sf, "connections")).select("source_chunk_id", "target_chunk_id")


P5_SQL = """
WITH pairs AS (
  SELECT source_chunk_id, target_chunk_id, max(similarity_score) AS s, min(target_document) AS d
  FROM connections
  WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND source_chunk_id <> target_chunk_id
  GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_chunk_id ORDER BY s DESC, d ASC NULLS LAST, target_chunk_id ASC) AS r FROM pairs)
SELECT source_chunk_id, target_chunk_id FROM ranked WHERE r <= 5
"""


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    chunk, sentence = (table(spark, sf, f"{k}_embeddings").select(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id"), "embedding") for k in ("chunk", "sentence"))
    return neighbours.similar_pairs(chunk.unionByName(sentence)).withColumnRenamed("kind", "granularity")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Per document whether decoding its ids gives its text back."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("was"))
    back = tokens.decode(tokens.encode(docs))
    return back.select("doc_id", (F.coalesce("was", F.lit("")) == F.col("text")).alias("same"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.found(table(spark, sf, "documents"))


def p10_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.repaired(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_report": p4_report,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_shares": p6_shares,
        "p7_found": p7_found,
        "p8_ids": p8_ids,
        "p8_roundtrip": p8_roundtrip,
        "p9_mix": p9_mix,
        "p9_report": p9_report,
        "p9_clamped_mix": p9_clamped_mix,
        "p9_clamped_report": p9_clamped_report,
        "p10_found": p10_found,
        "p10_repaired": p10_repaired,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL.replace("\\\\", "\\"),
        "p5_found": P5_SQL,
        "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
    }
