"""Articles to clean text, sentences, windows and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.functions import text as T


def cleaned(articles: DataFrame, least: int = 0, most: int = 5_000_000) -> DataFrame:
    """(url, cleaned) of articles whose raw_text has ``least`` to ``most`` characters."""
    return articles.filter(F.length("raw_text").between(least, most)).select("url", T.clean_text(F.col("raw_text")).alias("cleaned"))


def sentences(articles: DataFrame) -> DataFrame:
    """(url, title, idx, sentence): entries of the stored lists, by position from 0; null lists and entries give none."""
    return articles.select("url", "title", F.posexplode("sentences").alias("idx", "sentence")).filter("sentence IS NOT NULL")


def valid_sentences(articles: DataFrame) -> DataFrame:
    return sentences(articles).filter(T.valid_sentence(F.col("sentence")))


def text_counts(articles: DataFrame) -> DataFrame:
    """Words, characters, stored sentences and the hash of the raw text, by article."""
    n_words = F.size(F.filter(F.split(F.trim("cleaned_text"), f"{T.WS}+"), lambda w: w != ""))
    return articles.select(
        "url",
        F.when(F.col("cleaned_text").isNull(), 0).otherwise(n_words).alias("word_count"),
        F.coalesce(F.length("cleaned_text"), F.lit(0)).alias("char_count"),
        F.when(F.col("sentences").isNull(), 0).otherwise(F.size("sentences")).alias("sentence_count"),
        F.md5("raw_text").alias("source_hash"),
    )


def corpus_statistics(articles: DataFrame) -> DataFrame:
    c = text_counts(articles)
    return c.agg(
        F.count(F.lit(1)).alias("articles"), F.sum("sentence_count").alias("sentences"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"),
        F.round(F.avg("sentence_count"), 6).alias("avg_sentences"), F.round(F.avg("word_count"), 6).alias("avg_words"),
    )


def chunk_id(title: Column, start: Column, end: Column) -> Column:
    """{safe title, 50 characters}_window_{start}_{end}_{8 hex digits}; ``end`` is exclusive."""
    safe = F.substring(F.translate(title, " /", "__"), 1, 50)
    mark = F.substring(F.md5(F.concat_ws("_", title, start.cast("string"), end.cast("string"))), 1, 8)
    return F.concat_ws("_", safe, F.lit("window"), start.cast("string"), end.cast("string"), mark)


def windows(articles: DataFrame, size: int = 3, overlap: int = 2) -> DataFrame:
    """Windows of ``size`` stored sentences, each starting ``size - overlap`` after the last; articles with fewer sentences have none.

    The last window may be short when the step is greater than 1.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is required")
    step = size - overlap
    a = articles.select("title", "sentences", F.size("sentences").alias("n")).filter(f"sentences IS NOT NULL AND n >= {size}")
    last = F.ceil((F.col("n") - size) / F.lit(step)).cast("int") * step
    # each window's text is cut out before the rows are multiplied, so that no row carries the whole list
    texts = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("sentences", s + 1, F.lit(size)), " ").alias("text")))
    w = a.select("title", "n", F.posexplode(texts).alias("window_position", "w")).select("title", "n", "window_position", F.col("w.start").alias("start_sentence_idx"), F.col("w.text").alias("text"))
    end = F.least(F.col("start_sentence_idx") + size, F.col("n"))
    return w.select(
        chunk_id(F.col("title"), F.col("start_sentence_idx"), end).alias("chunk_id"),
        "text",
        F.col("title").alias("source_article"),
        F.sequence(F.col("start_sentence_idx"), end - 1).alias("source_sentences"),
        "window_position",
        (F.floor((F.col("n") - size + step - 1) / F.lit(step)) + 1).cast("int").alias("total_windows"),
        "start_sentence_idx",
        (end - 1).alias("end_sentence_idx"),
    )


def window_statistics(chunks: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim("text"), f"{T.WS}+"), lambda w: w != ""))
    c = chunks.select("source_article", n.alias("w"), F.size("source_sentences").alias("s"))
    return c.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_article").alias("articles"), F.round(F.count(F.lit(1)) / F.countDistinct("source_article"), 6).alias("per_article"),
        F.round(F.avg("w"), 6).alias("avg_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.min("s").alias("min_sentences"), F.max("s").alias("max_sentences"),
    )


def summaries(articles: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, title, summary): the first ``most`` stored sentences joined; blank ones are left out."""
    s = F.array_join(F.slice("sentences", 1, most), " ")
    doc = F.concat(F.lit("doc_"), F.substring(F.md5("title"), 1, 8))
    return articles.filter("title IS NOT NULL").select(doc.alias("doc_id"), "title", s.alias("summary")).filter("trim(summary) <> ''").distinct()


def containing_chunks(chunks: DataFrame) -> DataFrame:
    """(source_article, idx, chunk_ids): which windows hold a sentence, in window order."""
    e = chunks.filter("chunk_id IS NOT NULL AND source_sentences IS NOT NULL").select("source_article", "chunk_id", "start_sentence_idx", F.explode("source_sentences").alias("idx")).distinct()
    return e.groupBy("source_article", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sentence_idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))


def sequential_neighbours(chunks: DataFrame) -> DataFrame:
    """(chunk_id, previous_id, next_id) within the article by start of the window."""
    one = chunks.filter("chunk_id IS NOT NULL").select("chunk_id", "source_article", "start_sentence_idx").distinct()
    w = Window.partitionBy("source_article").orderBy("start_sentence_idx", "chunk_id")
    return one.select("chunk_id", F.lag("chunk_id").over(w).alias("previous_id"), F.lead("chunk_id").over(w).alias("next_id"))
