"""The data behind pictures of answers: steps, documents, windows, matrices and nodes. Drawing is not part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.functions import vector as V


def steps(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, step, id, document, idx, last) of answers (query_id, path): the chunks of a path in order, with their document and window number (-1 without one)."""
    e = answers.select("query_id", F.posexplode("path").alias("step", "id"), (F.size("path") - 1).alias("end"))
    known = e.join(nodes.select("id", F.col("doc").alias("document")), "id", "left")
    return known.select("query_id", "step", "id", F.coalesce("document", T.document_name(F.col("id"))).alias("document"), F.coalesce(T.start_index(F.col("id")), F.lit(-1)).alias("idx"), (F.col("step") == F.col("end")).alias("last"))


def involved(path_steps: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, document, first_step, place): the documents of a path by first appearance, at most ``most``, which a picture has room for."""
    first = path_steps.groupBy("query_id", "document").agg(F.min("step").alias("first_step"))
    w = Window.partitionBy("query_id").orderBy("first_step", "document")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def reading_windows(path_steps: DataFrame, chunks: DataFrame, buffer: int = 3, default: int = 15) -> DataFrame:
    """(query_id, document, id, idx, visited): a document's chunks (id, document, idx) from ``buffer`` windows before the first to ``buffer`` after the last that the path visits;
    where no visited chunk has a number, the document's first ``default``."""
    span = path_steps.groupBy("query_id", "document").agg(F.min(F.when(F.col("idx") >= 0, F.col("idx"))).alias("lo"), F.max(F.when(F.col("idx") >= 0, F.col("idx"))).alias("hi"))
    numbered = chunks.withColumn("n", F.row_number().over(Window.partitionBy("document").orderBy("idx", "id")))
    j = span.join(numbered, "document").filter(F.when(F.col("lo").isNotNull(), F.col("idx").between(F.col("lo") - buffer, F.col("hi") + buffer)).otherwise(F.col("n") <= default))
    seen = path_steps.select("query_id", "id").distinct().withColumn("visited", F.lit(True))
    return j.join(seen, ["query_id", "id"], "left").select("query_id", "document", "id", "idx", F.coalesce("visited", F.lit(False)).alias("visited"))


def in_order(chunks: DataFrame) -> DataFrame:
    """(document, place, id): all chunks of each document in window order."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("document").orderBy("idx", "id"))).select("document", "place", "id")


def matrix(rows: DataFrame, key: str) -> DataFrame:
    """(key, a, b, sim): the full similarity matrix of the rows (key, id, vec) of each picture; the pairs are what is asked for, and a picture's rows are few."""
    a, b = rows.select(key, F.col("id").alias("a"), F.col("vec").alias("va")), rows.select(key, F.col("id").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, key).select(key, "a", "b", F.round(V.dot(F.col("va"), F.col("vb")), V.DECIMALS).alias("sim"))


def strong_pairs(pairs: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs of a :func:`matrix` above ``least``, each once, the smaller id first."""
    return pairs.filter((F.col("a") < F.col("b")) & (F.col("sim") > least))


def session_titles(sessions: DataFrame, short: int = 12, long: int = 25) -> DataFrame:
    """Reading sessions with ``title``: the document's name, cut at ``short`` characters where a path has several sessions, else at ``long``, and the range of steps."""
    n = F.count(F.lit(1)).over(Window.partitionBy("path_id"))
    name = F.when(F.col("n_sessions") > 1, T.preview(F.col("document"), short)).otherwise(T.preview(F.col("document"), long))
    span = F.when(F.col("first_step") == F.col("last_step"), F.concat(F.lit("step "), F.col("first_step").cast("string"))).otherwise(F.concat(F.lit("steps "), F.col("first_step").cast("string"), F.lit("-"), F.col("last_step").cast("string")))
    return sessions.withColumn("n_sessions", n).withColumn("title", F.concat(name, F.lit(" ("), span, F.lit(")")))


def relevance(nodes: DataFrame, similarities: DataFrame, sentences: DataFrame) -> DataFrame:
    """(query_id, id, relevance) of nodes (query_id, id): a node's similarity to the query, else the highest of its sentences' (chunk_id, sentence_id), else 0.5. ``similarities`` has (query_id, id, sim)."""
    own = nodes.join(similarities, ["query_id", "id"], "left")
    inside = nodes.join(sentences.select(F.col("chunk_id").alias("id"), "sentence_id"), "id").join(similarities.select("query_id", F.col("id").alias("sentence_id"), F.col("sim").alias("s")), ["query_id", "sentence_id"])
    best = inside.groupBy("query_id", "id").agg(F.max("s").alias("s"))
    return own.join(best, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("sim", "s", F.lit(0.5)).alias("relevance"))


def shown_nodes(answers: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, id, kind, is_final, place) of answers (query_id, path, sources): the query, the chunks that gave sentences, then the rest of the path, at most ``most`` in a picture."""
    q = answers.select("query_id", F.col("query_id").alias("id"), F.lit("query").alias("kind"), F.lit(False).alias("is_final"), F.lit(0).alias("first"), F.lit(0).alias("step"))
    p = answers.select("query_id", F.posexplode("path").alias("step", "id"), "sources").groupBy("query_id", "id").agg(F.min("step").alias("step"), F.bool_or(F.array_contains("sources", F.col("id"))).alias("is_final"))
    p = p.select("query_id", "id", F.lit("chunk").alias("kind"), F.coalesce("is_final", F.lit(False)).alias("is_final"), F.when(F.col("is_final"), 1).otherwise(2).alias("first"), "step")
    w = Window.partitionBy("query_id").orderBy("first", "step", "id")
    return q.unionByName(p).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("first", "step")


def common_dimension(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows whose vector has the commonest number of dimensions, the larger one where two are equally common."""
    sizes = rows.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    return rows.join(F.broadcast(sizes), F.size(vec) == F.col("d")).drop("d")  # one row


def grouped(shown: DataFrame) -> DataFrame:
    """Nodes with ``group``, ``colour`` and ``size`` of their marks."""
    kind: Column = F.when(F.col("kind") == "query", "query").when(F.col("is_final"), "final").otherwise("visited")
    g = shown.withColumn("group", kind)
    pick = lambda q, f, v: F.when(F.col("group") == "query", q).when(F.col("group") == "final", f).otherwise(v)
    return g.withColumn("colour", pick("red", "green", "grey")).withColumn("size", pick(14, 10, 6))


def square(matrix_shape: tuple[int, ...], labels: list[str] | None = None) -> None:
    """Raises ValueError unless the matrix is two-dimensional and square and has as many labels as rows, where it has any."""
    if len(matrix_shape) != 2 or matrix_shape[0] != matrix_shape[1]:
        raise ValueError(f"a square matrix is needed, not one of shape {matrix_shape}")
    if labels is not None and len(labels) != matrix_shape[0]:
        raise ValueError(f"{len(labels)} labels for {matrix_shape[0]} rows")
