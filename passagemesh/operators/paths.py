"""Rules that a traversal path must keep, as predicates over exploded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Granularities a connection allows, and the least and most hops of a traversal pattern.
ALLOWED = {
    "raw_similarity": ("CHUNK",),
    "theme_bridge": ("DOCUMENT", "CHUNK"),
    "hierarchical": ("DOCUMENT", "CHUNK", "SENTENCE"),
    "sequential": ("DOCUMENT", "CHUNK", "SENTENCE"),
    "entity_overlap": ("DOCUMENT", "CHUNK", "SENTENCE"),
}
HOPS = {"raw_similarity": (None, 1), "hierarchical": (None, 2), "sequential_flow": (5, 10), "theme_bridge": (None, 3), "multi_dimensional": (3, 3)}
LEVELS = {"DOCUMENT": 0, "CHUNK": 1, "SENTENCE": 2}


def hop_errors(paths: DataFrame) -> DataFrame:
    """(path_id, step, error) for each broken rule of ``paths`` (path_id, step, granularity, document, connection): connection leads to the next step."""
    w = Window.partitionBy("path_id").orderBy("step")
    hop = paths.select("path_id", "step", "granularity", "document", "connection", F.lead("granularity").over(w).alias("g2"), F.lead("document").over(w).alias("d2")).filter("g2 IS NOT NULL")
    allowed = lambda g: F.coalesce(F.greatest(*[(F.col("connection") == c) & F.col(g).isin(*gs) for c, gs in ALLOWED.items()]), F.lit(False))
    level = lambda c: F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])[F.col(c)]
    rules = [
        (~allowed("granularity"), "granularity"),
        (~allowed("g2"), "granularity"),
        ((F.col("connection") == "sequential") & (F.col("granularity") == "SENTENCE") & (F.col("document") != F.col("d2")), "document_only"),
        ((F.col("connection") == "sequential") & (F.col("granularity") == "DOCUMENT") & (F.col("document") == F.col("d2")), "always_inter"),
        ((F.col("connection") == "theme_bridge") & F.col("granularity").isin("DOCUMENT", "CHUNK") & (F.col("document") == F.col("d2")), "always_inter"),
        ((F.col("connection") == "hierarchical") & (level("g2") - level("granularity") != 1), "one_level_down"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    return hop.select("path_id", "step", F.explode(errors).alias("error"))


def pattern_errors(pattern: str | None) -> Column:
    """How many rules of a traversal pattern a path of ``hops`` with ``kinds`` of connections breaks; a pattern that is not listed has none.

    A wrong number of hops of the multi-dimensional pattern counts twice: as the path's and as the pattern's own rule.
    """
    least, most = HOPS.get(pattern, (None, None))
    hops, kinds = F.col("hops"), F.col("kinds")
    broken = [hops > most] if most is not None else []
    broken += [hops < least] if least is not None else []
    broken += [hops != most, kinds < hops] if pattern == "multi_dimensional" else []
    return sum((b.cast("int") for b in broken), F.lit(0))


def validated(paths: DataFrame, pattern: str | None = None) -> DataFrame:
    """(path_id, hops, n_errors, is_valid) by the rules of each hop and of the traversal ``pattern``: a path without a hop is not valid."""
    w = Window.partitionBy("path_id").orderBy("step")
    kind = F.when(F.col("next").isNotNull(), F.col("connection"))
    n = paths.withColumn("next", F.lead("step").over(w)).groupBy("path_id").agg((F.count(F.lit(1)) - 1).cast("int").alias("hops"), F.count_distinct(kind).alias("kinds"))
    e = hop_errors(paths).groupBy("path_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    j = n.join(e, "path_id", "left").withColumn("n_errors", F.coalesce("n", F.lit(0)) + pattern_errors(pattern))
    return j.select("path_id", "hops", "n_errors", ((F.col("n_errors") == 0) & (F.col("hops") > 0)).alias("is_valid"))


def sessions(steps: DataFrame, gap: int = 8) -> DataFrame:
    """(path_id, session, document, first_step, last_step, n): a new reading session starts where the document changes or the index jumps by more than ``gap``."""
    w = Window.partitionBy("path_id").orderBy("step")
    new = (F.lag("document").over(w).isNull()) | (F.col("document") != F.lag("document").over(w)) | (F.abs(F.col("idx") - F.lag("idx").over(w)) > gap)
    s = steps.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return s.groupBy("path_id", "session", "document").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"))


# What a connection may reach at a granularity; how a path lands, by connection and granularity; templates of valid paths.
SCOPES = {
    ("sequential", "SENTENCE"): "document_only",
    ("sequential", "CHUNK"): "inter_document_allowed",
    ("sequential", "DOCUMENT"): "always_inter_document",
    ("raw_similarity", "CHUNK"): "intra_and_inter_document",
    ("theme_bridge", "DOCUMENT"): "always_inter_document",
    ("theme_bridge", "CHUNK"): "always_inter_document",
    ("hierarchical", "DOCUMENT"): "intra_document_only",
    ("hierarchical", "CHUNK"): "intra_document_only",
    ("hierarchical", "SENTENCE"): "intra_document_only",
}
LANDINGS = {
    ("theme_bridge", "DOCUMENT"): "document_to_document_theme_matching",
    ("theme_bridge", "CHUNK"): "chunk_to_most_relevant_chunk_in_target_document",
    ("raw_similarity", "DOCUMENT"): "direct_similarity_matching",
    ("raw_similarity", "CHUNK"): "direct_similarity_matching",
    ("raw_similarity", "SENTENCE"): "direct_similarity_matching",
    ("hierarchical", "DOCUMENT"): "document_to_child_chunk",
    ("hierarchical", "CHUNK"): "chunk_to_child_sentence",
    ("sequential", "DOCUMENT"): "narrative_flow_continuation",
    ("sequential", "CHUNK"): "narrative_flow_continuation",
    ("sequential", "SENTENCE"): "narrative_flow_continuation",
}
TEMPLATES = (
    ("raw_similarity", ("CHUNK", "CHUNK"), ("raw_similarity",), True),
    ("hierarchical", ("DOCUMENT", "CHUNK", "SENTENCE"), ("hierarchical", "hierarchical"), False),
    ("theme_bridge", ("CHUNK", "CHUNK"), ("theme_bridge", "hierarchical"), True),
    ("multi_dimensional", ("DOCUMENT", "CHUNK", "CHUNK", "SENTENCE"), ("hierarchical", "theme_bridge", "sequential"), True),
    ("sequential_flow", ("SENTENCE",) * 6, ("sequential",) * 5, False),
    ("sequential_flow", ("CHUNK",) * 4, ("sequential",) * 3, True),
)


def _looked_up(table: dict[tuple[str, str], str], connection: Column, granularity: Column, otherwise: str) -> Column:
    pairs = [x for (c, g), v in table.items() for x in (F.lit(f"{c}/{g}"), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("/", connection, granularity)], F.lit(otherwise))


def scope(connection: Column, granularity: Column) -> Column:
    """What a connection may reach from a granularity, 'unknown' where no rule says."""
    return _looked_up(SCOPES, connection, granularity, "unknown")


def landing(connection: Column, granularity: Column) -> Column:
    """How a path lands in its target document."""
    return _looked_up(LANDINGS, connection, granularity, "default_similarity_based")


def constraints(spark: SparkSession) -> DataFrame:
    """(pattern, min_hops, max_hops): the traversal patterns' hop limits, null where there is none."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in HOPS.items()], "pattern string, min_hops int, max_hops int")


def templates(spark: SparkSession) -> DataFrame:
    """(pattern, hops, granularities, connections, cross_document): shapes of valid paths."""
    rows = [(p, len(c), list(g), list(c), x) for p, g, c, x in TEMPLATES]
    return spark.createDataFrame(rows, "pattern string, hops int, granularities array<string>, connections array<string>, cross_document boolean")


def checked(paths: DataFrame, pattern: str | None = None) -> DataFrame:
    """(path_id, total_hops, errors, is_valid) of paths as lists (path_id, nodes, connections, granularities, documents), each row by itself.

    Lists whose lengths do not fit give one error and no more of the hops; then each hop's granularities, scope and level are checked, then the hops of the
    ``pattern``. A path whose nodes are not one more than its connections is never valid. Null lists count as empty.
    """
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("nodes", "connections", "granularities", "documents")}
    p = paths.select("path_id", *[v.alias(c) for c, v in lists.items()])
    n, hops = F.size("nodes"), F.size("connections")
    level = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    allowed = F.create_map(*[x for c, gs in ALLOWED.items() for x in (F.lit(c), F.array(*map(F.lit, gs)))])

    def hop(i: Column) -> Column:
        at = lambda c, k: F.get(F.col(c), k)
        c, g, g2, d, d2 = at("connections", i), at("granularities", i), at("granularities", i + 1), at("documents", i), at("documents", i + 1)
        can = lambda x: F.coalesce(F.array_contains(allowed[c], x), F.lit(False))
        name = lambda t: F.concat(F.lit("hop "), i.cast("string"), F.lit(t))
        found = F.array(
            F.when(~can(g), name(": source granularity")),
            F.when(~can(g2), name(": target granularity")),
            F.when((scope(c, g) == "document_only") & ~d.eqNullSafe(d2), name(": crosses documents")),
            F.when((scope(c, g) == "always_inter_document") & d.eqNullSafe(d2), name(": stays in its document")),
            F.when((c == "hierarchical") & F.coalesce(level[g2] != level[g] + 1, F.lit(True)), name(": not one level down")),
        )
        return F.filter(found, lambda e: e.isNotNull())

    none = F.array().cast("array<string>")
    per_hop = F.when(hops > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(hops - 1, F.lit(0))), hop))).otherwise(none)
    shape = F.when(n != hops + 1, "nodes").when(n != F.size("granularities"), "granularities").when(n != F.size("documents"), "documents")
    least, most = HOPS.get(pattern, (None, None))
    rules = []
    if most is not None:
        rules.append(F.when(hops > most, "too many hops"))
    if least is not None:
        rules.append(F.when(hops < least, "too few hops"))
    if pattern == "multi_dimensional":
        rules = [F.when(hops != most, "wrong number of hops"), F.when(F.size(F.array_distinct("connections")) != hops, "repeated connection"), F.when(hops != most, "wrong number of hops for dimensions")]
    own = F.filter(F.array(*rules), lambda e: e.isNotNull()) if rules else none
    errors = F.concat(F.when(shape.isNotNull(), F.array(shape)).otherwise(per_hop), own)
    c = p.select("path_id", hops.alias("total_hops"), errors.alias("errors"), (n == hops + 1).alias("whole"))
    return c.select("path_id", "total_hops", "errors", ((F.size("errors") == 0) & F.col("whole")).alias("is_valid"))
