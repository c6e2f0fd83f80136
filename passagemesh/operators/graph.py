"""The graph's node and edge tables: assembly, counts, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemesh.models import answered


def document_nodes(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(title, chunk_ids, summary): chunks by document in window order, with the document's summary."""
    c = chunks.filter("chunk_id IS NOT NULL AND source_article IS NOT NULL").select("source_article", "start_sentence_idx", "chunk_id").distinct()
    g = c.groupBy(F.col("source_article").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sentence_idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return g.join(summaries.groupBy("title").agg(F.max("summary").alias("summary")), "title", "left")


def chunk_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, doc, intra, inter): chunks that have a vector, with their neighbours of either kind, best first."""
    order = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("rank", "dst")))), lambda x: x["dst"])
    adjacent = edges.groupBy("src").agg(order("intra_document").alias("intra"), order("inter_document").alias("inter"))
    empty = F.array().cast("array<string>")
    return nodes.select("id", "doc").join(adjacent, nodes.id == adjacent.src, "left").select(F.col("id").alias("chunk_id"), "doc", F.coalesce("intra", empty).alias("intra"), F.coalesce("inter", empty).alias("inter"))


def sentence_nodes(embeddings: DataFrame) -> DataFrame:
    """(sentence_id, doc, source_chunk): source_chunk is the first containing chunk, or ''."""
    one = embeddings.filter("sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.max(F.struct(F.col("source_article").alias("doc"), F.coalesce(F.get("containing_chunks", F.lit(0)), F.lit("")).alias("source_chunk"))).alias("s"))
    return one.select("sentence_id", "s.doc", "s.source_chunk")


def bridge(embeddings: DataFrame) -> DataFrame:
    """(chunk_id, sentence_id): which sentences a chunk holds."""
    return embeddings.filter("sentence_id IS NOT NULL").select(F.explode("containing_chunks").alias("chunk_id"), "sentence_id").filter("chunk_id IS NOT NULL").distinct()


def tier(score: Column, high: float = 0.7) -> Column:
    return F.when(score >= high, "high").when(score >= 0.7 * high, "medium").when(score.isNotNull(), "low").otherwise("unscored")


def quality_statistics(scores: DataFrame, high: float = 0.7) -> DataFrame:
    """(tier, n, avg_score) of rows with a column ``score``."""
    return scores.select(tier(F.col("score"), high).alias("tier"), "score").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


def quality_summary(scores: DataFrame, high: float = 0.7) -> DataFrame:
    """(scored, unscored, high, medium, low, avg_score, min_score, max_score) of rows with a column ``score``."""
    t = scores.select(tier(F.col("score"), high).alias("t"), "score")
    return t.agg(
        F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("unscored"), *[F.count_if(F.col("t") == k).alias(k) for k in ("high", "medium", "low")],
        F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def above_quality(chunks: DataFrame, least: float) -> DataFrame:
    """Chunks with a score of at least ``least``; unscored ones are left out."""
    return chunks.filter(F.col("score") >= least)


#: What a model rates a chunk by, each from 0 to 1.
QUALITIES = ("clarity", "depth", "structure", "relevance")


def quality_of(reply: Column) -> Column:
    """The mean of the four ratings of a model's reply, from its first object of JSON; null unless all four are there and from 0 to 1."""
    o = F.from_json(F.regexp_extract(reply, "\\{[^}]*\\}", 0), ", ".join(f"{q} double" for q in QUALITIES))
    ok = F.lit(True)
    for q in QUALITIES:
        ok = ok & o[q].between(0, 1)
    return F.when(ok, (o[QUALITIES[0]] + o[QUALITIES[1]] + o[QUALITIES[2]] + o[QUALITIES[3]]) / 4.0)


def scored(chunks: DataFrame, known: DataFrame, model: Callable[[list[str]], list[str | None]], attempts: int = 3) -> DataFrame:
    """(chunk_id, score): chunks (chunk_id, text) without a score in ``known`` (chunk_id, score) rated by ``model``; the known ones stay. A reply that cannot be read gives null."""
    new = chunks.join(known.filter("score IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")
    ask = new.withColumn("prompt", F.concat(F.lit("Rate this text from 0 to 1 by clarity, depth, structure and relevance, as a JSON object.\n"), "text"))
    got = answered(ask, "prompt", "reply", model, attempts).select("chunk_id", quality_of(F.col("reply")).alias("score"))
    return known.filter("score IS NOT NULL").select("chunk_id", "score").unionByName(got)


def pruned(documents: DataFrame, chunks: DataFrame, bridge_: DataFrame, scores: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, bridge) without the chunks scored under ``least``: they leave their documents' lists, and all of their sentences go, also those a kept chunk shares."""
    low = scores.filter(F.col("score") < least).select("chunk_id").distinct()
    gone = bridge_.join(low, "chunk_id", "left_semi").select("sentence_id").distinct()
    kept = bridge_.join(gone, "sentence_id", "left_anti").join(low, "chunk_id", "left_anti")
    listed = documents.select("title", F.posexplode_outer("chunk_ids").alias("p", "chunk_id")).join(low, "chunk_id", "left_anti")
    lists = listed.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("p", "chunk_id")))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    docs = documents.drop("chunk_ids").join(lists, "title", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return docs, chunks.join(low, "chunk_id", "left_anti"), kept


def neighbours(edges: DataFrame) -> DataFrame:
    """(chunk_id, connections, scores): all neighbours of a chunk, those inside its document first, and the map of their scores."""
    o = F.when(F.col("type") == "intra_document", 0).otherwise(1)
    one = edges.groupBy("src", "dst").agg(F.min(F.struct(o.alias("o"), "rank")).alias("k"), F.max("sim").alias("sim"))
    l = one.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("k", "dst", "sim"))).alias("l"))  # noqa: E741
    return l.select(F.col("src").alias("chunk_id"), F.transform("l", lambda x: x["dst"]).alias("connections"), F.map_from_entries(F.transform("l", lambda x: F.struct(x["dst"], x["sim"]))).alias("scores"))


def counts(documents: DataFrame, chunks: DataFrame, sentences: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of the graph's sizes."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    out = n(documents, "documents")
    for d, name in ((chunks, "chunks"), (sentences, "sentences"), (edges.filter("type = 'intra_document'"), "intra_edges"), (edges.filter("type <> 'intra_document'"), "inter_edges")):
        out = out.crossJoin(n(d, name))  # one row each
    return out


def without_low_quality(chunks: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """Chunks but those scored under ``least``; unscored ones stay."""
    low = scores.filter(F.col("score") < least).select("chunk_id").distinct()
    return chunks.join(low, "chunk_id", "left_anti")
