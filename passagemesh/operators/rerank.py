"""Reranking of sentences for a query by TF-IDF, length and overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.models import answered

# Words left out before n-grams are made.
STOP = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in", "into", "is", "it", "its", "more", "most", "no", "not", "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you")


#: Terms of a query's corpus that count, the commonest ones.
MOST_TERMS = 5000


def _terms(texts: DataFrame) -> DataFrame:
    """(query_id, pos, term, tf): words of two or more characters and pairs of neighbours, stop words left out first."""
    stop = F.array(*map(F.lit, STOP))
    kept = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    t = texts.select("query_id", "pos", kept.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    both = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    return t.select("query_id", "pos", F.explode(both).alias("term")).groupBy("query_id", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(candidates: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, pos, similarity, score, rank) of ``candidates`` (query_id, pos from 0, text) for ``queries`` (query_id, text).

    The corpus of a query is itself and its candidates; idf = ln((1+n)/(1+df)) + 1, rows at unit length; the score is the cosine over
    1 + 0.1 pos. Equal scores by position.
    """
    every = candidates.select("query_id", "pos", "text").unionByName(queries.select("query_id", F.lit(-1).alias("pos"), "text"))
    t = _terms(every)
    # of a query's corpus the commonest terms count
    total = t.groupBy("query_id", "term").agg(F.sum("tf").alias("n"))
    common = total.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "term"))).filter(F.col("r") <= MOST_TERMS)
    t = t.join(common.select("query_id", "term"), ["query_id", "term"])
    n = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "query_id").select("query_id", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = t.join(df, ["query_id", "term"]).select("query_id", "pos", "term", (F.col("tf") * F.col("idf")).alias("w"))
    size = w.groupBy("query_id", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    q = w.filter("pos = -1").select("query_id", "term", F.col("w").alias("qw"))
    dots = w.filter("pos >= 0").join(q, ["query_id", "term"]).groupBy("query_id", "pos").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    ql = size.filter("pos = -1").select("query_id", F.col("len").alias("ql"))
    j = candidates.select("query_id", "pos", "text").join(dots, ["query_id", "pos"], "left").join(size, ["query_id", "pos"], "left").join(ql, "query_id", "left")
    sim = F.round(F.coalesce(F.col("dot") / (F.col("len") * F.col("ql")), F.lit(0.0)), 9)
    s = j.select("query_id", "pos", "text", sim.alias("similarity"), F.round(sim / (1.0 + 0.1 * F.col("pos")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hybrid(candidates: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank, pos, score, is_padding): the padded list of :func:`tfidf`, by 0.6 of the similarity, 0.2 length score and 0.2 word overlap with the query.

    Copies that pad a list keep a tenth of their score. Equal scores in the order of the list.
    """
    base = tfidf(candidates, queries, most)
    texts = base.select("query_id", "pos", "text", "similarity").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    score = 0.6 * F.col("similarity") + 0.2 * T.length_score(F.col("text")) + 0.2 * T.overlap_score(F.col("text"), F.col("q"))
    own = texts.select("query_id", "pos", score.alias("own"))
    p = padded(base, most).withColumnRenamed("rank", "was").drop("score").join(own, ["query_id", "pos"])
    s = p.withColumn("score", F.round(F.when(F.col("is_padding"), F.col("own") * 0.1).otherwise(F.col("own")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "was")
    return s.select("query_id", F.row_number().over(order).alias("rank"), "pos", "score", "is_padding")


def unranked(candidates: DataFrame) -> DataFrame:
    """(query_id, pos, text, similarity, score, rank): candidates as they come, scored 1 less 0.1 a place, 0 at least: what stands in where no similarity can be had."""
    s = candidates.select("query_id", "pos", "text", F.lit(0.0).alias("similarity"), F.round(F.greatest(F.lit(0.0), 1.0 - 0.1 * F.col("pos")), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def by_model(candidates: DataFrame, queries: DataFrame, model: Callable[[list[str]], list[str | None]] | None, most: int = 10) -> DataFrame:
    """As :func:`tfidf`, the similarity being what ``model`` says of each pair of query and text, as a number in text; without a model, or where it fails for a query, by TF-IDF."""
    fallback = tfidf(candidates, queries, most)
    if model is None:
        return fallback
    pairs = candidates.select("query_id", "pos", "text").join(queries.select("query_id", F.col("text").alias("q")), "query_id").withColumn("pair", F.concat("q", F.lit("\t"), "text"))
    got = answered(pairs, "pair", "reply", model).withColumn("similarity", F.expr("try_cast(reply AS double)"))
    bad = got.filter("similarity IS NULL").select("query_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "pos")
    good = got.join(bad, "query_id", "left_anti").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    cols = ["query_id", "pos", "text", "similarity", "score", "rank"]
    return good.withColumn("score", F.col("similarity")).select(*cols).unionByName(fallback.join(bad, "query_id", "left_semi").select(*cols))


def reranked(strategy: str, candidates: DataFrame, queries: DataFrame, most: int = 10, model: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """(query_id, rank, pos, score, is_padding) by 'tfidf', 'semantic' (by ``model``) or 'hybrid'; other names mean 'tfidf'. Candidates of ten characters or fewer, blanks aside, stay out."""
    c = candidates.filter(F.length(F.trim("text")) > 10)
    if strategy == "hybrid":
        return hybrid(c, queries, most)
    return padded(by_model(c, queries, model, most) if strategy == "semantic" else tfidf(c, queries, most), most)


def padded(ranked: DataFrame, count: int = 10) -> DataFrame:
    """Exactly ``count`` rows a query: the first ones, or copies of the last at a tenth of its score, marked is_padding."""
    last = ranked.groupBy("query_id").agg(F.max(F.struct("rank", "pos", "score")).alias("l")).filter(F.col("l.rank") < count)
    pad = last.select("query_id", F.explode(F.sequence(F.col("l.rank") + 1, F.lit(count))).alias("rank"), F.col("l.pos").alias("pos"), F.round(F.col("l.score") * 0.1, 9).alias("score"), F.lit(True).alias("is_padding"))
    return ranked.filter(F.col("rank") <= count).select("query_id", "rank", "pos", "score", F.lit(False).alias("is_padding")).unionByName(pad)
