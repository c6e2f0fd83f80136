"""Themes of documents: keyword fallback, parsing of model replies, edges between documents and what passages inherit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.models import answered
from passagemesh.operators.similarity import top_similar

# Themes and the substrings that call for them, in order.
THEMES = {
    "Artificial Intelligence": ("artificial intelligence", "ai", "machine intelligence"),
    "Machine Learning": ("machine learning", "ml", "learning algorithms"),
    "Neural Networks": ("neural networks", "neural nets", "artificial neural"),
    "Deep Learning": ("deep learning", "deep neural", "convolutional"),
    "Natural Language Processing": ("natural language", "nlp", "text processing"),
    "Computer Vision": ("computer vision", "image recognition", "visual"),
    "Data Science": ("data science", "data analysis", "big data"),
    "Robotics": ("robotics", "robots", "autonomous"),
    "Psychology": ("psychology", "psychological", "behavior", "cognitive"),
    "Neuroscience": ("neuroscience", "brain", "neural", "cognitive science"),
    "History": ("history", "historical", "past", "century"),
    "Technology": ("technology", "technological", "computing", "computer"),
    "Research": ("research", "study", "studies", "investigation"),
    "Education": ("education", "learning", "teaching", "academic"),
}

def fallback_themes(title: Column, summary: Column, most: int = 5) -> Column:
    """Up to ``most`` themes one of whose substrings is in title and summary, in table order; where there is none, the summary's first capitalised phrases."""
    low = F.lower(F.concat_ws(" ", title, summary))
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[low.contains(k) for k in keys]), F.lit(name)) for name, keys in THEMES.items()]))
    return F.when(F.size(hits) > 0, F.slice(hits, 1, most)).otherwise(T.capitalised(summary, most))


def parse_themes(reply: Column, most: int = 5) -> Column:
    """Themes of a model's reply: its first bracketed list read as JSON, or the list ``themes`` of an object, without blanks and quotes around them; anything else gives an empty list."""
    named = F.from_json(F.regexp_extract(reply, "(?s)\\{.*\\}", 0), "themes array<string>")["themes"]
    listed = F.coalesce(F.from_json(F.regexp_extract(reply, "(?s)\\[.*?\\]", 0), "array<string>"), named)
    kept = F.filter(F.transform(listed, lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")), lambda x: F.trim(x) != "")
    return F.coalesce(F.slice(kept, 1, most), F.array().cast("array<string>"))


def document_themes(results: DataFrame) -> DataFrame:
    """(doc_id, theme): distinct lower-case themes of a document over all of its rows."""
    return results.filter("doc_id IS NOT NULL").select("doc_id", F.explode("themes").alias("t")).filter("trim(t) <> ''").select("doc_id", F.lower(F.trim("t")).alias("theme")).distinct()


def theme_statistics(results: DataFrame) -> DataFrame:
    t = document_themes(results)
    per = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("n"), 6).alias("avg_themes"), F.min("n").alias("min_themes"), F.max("n").alias("max_themes")).crossJoin(t.agg(F.countDistinct("theme").alias("distinct_themes")))  # one row each


def theme_edges(nodes: DataFrame, least: float = 0.2, best: int = 1) -> DataFrame:
    """(doc_id, similar_id, score, rank): the stored theme similarities of a document, its ``best`` of at least ``least``."""
    e = nodes.filter("doc_id IS NOT NULL").select("doc_id", F.explode("theme_similarity_scores").alias("similar_id", "score")).filter((F.col("score") >= least) & (F.col("similar_id") != F.col("doc_id")))
    one = e.groupBy("doc_id", "similar_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "similar_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= best)


def inherited(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, theme): what a chunk takes over from the document of its title; chunks of no such document have no rows."""
    d = nodes.filter("title IS NOT NULL").select("title", F.explode("doc_themes").alias("theme")).filter("theme IS NOT NULL").distinct()
    c = chunks.filter("chunk_id IS NOT NULL").select("chunk_id", F.col("source_article").alias("title")).distinct()
    return c.join(d, "title").select("chunk_id", "theme").distinct()


def theme_similarities(vectors: DataFrame, queries: DataFrame, least: float = 0.2, best: int = 1) -> DataFrame:
    """(doc_id, similar_id, score, rank): of each query document the ``best`` others by cosine of theme vectors (id, vec), at ``least``; with fewer than two documents none."""
    v = vectors.select("id", F.col("id").alias("doc"), "vec")
    q = queries.select("id", F.col("id").alias("doc"), "vec")
    got = top_similar(q, v, best, least, same_doc=False)
    return got.select(F.col("src").alias("doc_id"), F.col("dst").alias("similar_id"), F.round("sim", 9).alias("score"), "rank")


def propagated(edges: DataFrame, chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """(kind, id, similar_id, score): what chunks (id, title) and sentences (id, title) take over of their document's theme edges (title, similar_id, score)."""
    to = lambda d, kind: d.filter("id IS NOT NULL").select("id", "title").distinct().join(edges, "title").select(F.lit(kind).alias("kind"), "id", "similar_id", "score")
    return to(chunks, "chunk").unionByName(to(sentences, "sentence"))


def theme_score(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, score) of document pairs (a, b): the stored theme similarity, 0 where there is none."""
    m = nodes.filter("doc_id IS NOT NULL AND theme_similarity_scores IS NOT NULL").groupBy(F.col("doc_id").alias("a")).agg(F.max_by("theme_similarity_scores", F.size("theme_similarity_scores")).alias("m"))
    return pairs.join(m, "a", "left").select("a", "b", F.coalesce(F.try_element_at("m", "b"), F.lit(0.0)).alias("score"))


def prompt(title: Column, summary: Column, themes: int = 5) -> Column:
    """What a model is asked for a document's themes."""
    return F.concat(F.lit(f"Name the {themes} main themes of this text as a JSON array of strings, nothing else.\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nText: "), F.coalesce(summary, F.lit("")))


def extracted(docs: DataFrame, model: Callable[[list[str]], list[str | None]] | None = None, most: int = 5) -> DataFrame:
    """(doc_id, themes, method) of documents (doc_id, title, summary): by ``model``, where it gives any, else by keywords ('fallback'; 'model_fallback' where a model gave none).

    ``model`` answers a list of prompts, one batch at a time in the workers; a batch it fails on is answered by keywords.
    """
    own = fallback_themes(F.col("title"), F.col("summary"), most)
    if model is None:
        return docs.select("doc_id", own.alias("themes"), F.lit("fallback").alias("method"))
    asked = answered(docs.withColumn("prompt", prompt(F.col("title"), F.col("summary"), most)), "prompt", "reply", model)
    got = parse_themes(F.col("reply"), most)
    return asked.select("doc_id", F.when(F.size(got) > 0, got).otherwise(own).alias("themes"), F.when(F.size(got) > 0, "model").otherwise("model_fallback").alias("method"))
