"""Context groups: passages that belong together, gathered from anchors by several strategies, for all groups at once.

A group's state is one row, as a walk's is; a step joins all states with the stored edges of where they stand. Choices that would be random are
made by a seeded hash, so that the same seed gives the same groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from passagemesh.operators.evaluate import allocation
from passagemesh.runtime import BROADCAST_ROWS, materialize

STRATEGIES = ("intra_document", "inter_document", "similarity", "theme_based", "sequential_multi_hop", "native")


@dataclass(frozen=True)
class Passages:
    """chunks (id, doc, pos, quality), links (src, dst, sim) as stored, held (id, texts) and themes (doc, other, rank): the documents like a document, by title."""

    chunks: DataFrame
    links: DataFrame
    held: DataFrame
    themes: DataFrame

    def kept(self) -> Passages:
        return Passages(*(materialize(d, "passages") for d in (self.chunks, self.links, self.held, self.themes)))


def seeded(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys that depends on the seed alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def anchor_chunks(chunks: DataFrame, count: int, seed: int = 0, least: float = 0.8) -> DataFrame:
    """(group_id, id): ``count`` chunks in seeded order, those of quality ``least`` or more where there are any, else all."""
    good = chunks.filter(F.col("quality") >= least)
    pool = chunks if good.isEmpty() else good
    return pool.select("id", seeded(F.col("id"), seed).alias("h")).orderBy("h", "id").limit(count).select(F.col("id").alias("group_id"), "id")


def passing(chunks: DataFrame, least: float = 0.7) -> DataFrame:
    """Chunks of quality ``least`` or more; unscored ones pass."""
    return chunks.filter(F.col("quality").isNull() | (F.col("quality") >= least))


def stored_similarity(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, sim) of pairs (src, dst): the stored score of the edge, 0 where there is none."""
    return pairs.select("src", "dst").join(links.select("src", "dst", "sim"), ["src", "dst"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def _fresh(texts: Column, have: Column) -> Column:
    return F.filter(texts, lambda t: ~F.array_contains(have, t))


def grown(strategy: str, anchors: DataFrame, g: Passages, most: int = 10, hops: int = 50) -> DataFrame:
    """(group_id, strategy, chunk_ids, sentences, reason) of groups that grow from their anchors (group_id, id) along stored edges.

    A step goes from the last chunk to its best unvisited neighbour that shares no sentence with the group: of the anchor's document (intra_document), of
    another than the last chunk's (inter_document), of any (similarity), or of the documents like the last chunk's, in order of their theme similarity, else of any other
    (theme_based). Its sentences are added up to ``most``. Equal scores go by id. reason is 'sentence_limit' or 'no_more_chunks'.
    """
    g = g.kept()
    doc = g.chunks.select("id", "doc")
    empty = F.array().cast("array<string>")
    cut = lambda have, more: F.slice(F.concat(have, more), 1, F.greatest(F.size(have), F.lit(most)))
    state = anchors.join(doc, "id").join(g.held, "id", "left").select("group_id", F.col("id").alias("cur"), "doc", F.col("doc").alias("home"), F.array("id").alias("path"), F.coalesce("texts", empty).alias("have"), F.lit(False).alias("done"))
    state = materialize(state, "groups")
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # checked once: the live states only get fewer
    links = g.links.select(F.col("src").alias("cur"), "dst", "sim")
    target = doc.select(F.col("id").alias("dst"), F.col("doc").alias("to")).join(g.held.select(F.col("id").alias("dst"), "texts"), "dst", "left")
    target = materialize(target, "targets")
    parts = []
    for _ in range(hops):
        live = F.broadcast(state) if few else state
        step = live.filter(F.size("have") < most).join(links, "cur").join(target, "dst")
        step = step.filter(~F.array_contains("path", F.col("dst")) & ~F.coalesce(F.arrays_overlap("have", "texts"), F.lit(False)))
        rank = F.lit(0)
        if strategy == "intra_document":
            step = step.filter(F.col("to") == F.col("home"))
        elif strategy in ("inter_document", "theme_based"):
            step = step.filter(F.col("to") != F.col("doc"))
        if strategy == "theme_based":
            step = step.join(g.themes.select("doc", F.col("other").alias("to"), F.col("rank").alias("like")), ["doc", "to"], "left")
            rank = F.coalesce(F.when(F.col("sim") > 0, F.col("like")), F.lit(1_000_000_000))
        best = step.groupBy("group_id").agg(F.min(F.struct(rank.alias("r"), (-F.col("sim")).alias("n"), "dst", "to", F.coalesce("texts", empty).alias("texts"))).alias("b"))
        seen = Observation()
        moved = live.join(best, "group_id", "left").select(
            "group_id", F.coalesce("b.dst", "cur").alias("cur"), F.coalesce("b.to", "doc").alias("doc"), "home", F.when(F.col("b").isNotNull(), F.concat("path", F.array("b.dst"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("b").isNotNull(), cut(F.col("have"), _fresh(F.col("b.texts"), F.col("have")))).otherwise(F.col("have")).alias("have"), F.col("b").isNull().alias("done"),
        ).observe(seen, F.count_if(~F.col("done")).alias("live"))
        moved = materialize(moved, "groups")
        parts.append(moved.filter("done"))
        state = moved.filter("NOT done")
        if not seen.get["live"]:
            break
    else:
        parts.append(state)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    reason = F.when(F.size("have") >= most, "sentence_limit").otherwise("no_more_chunks")
    return every.select("group_id", F.lit(strategy).alias("strategy"), F.col("path").alias("chunk_ids"), F.slice("have", 1, most).alias("sentences"), reason.alias("reason"))


def flow(g: Passages) -> DataFrame:
    """(cur, before, before_sim, after, after_sim): the windows before and after each in its document, with the stored similarity, 0 where there is none."""
    w = Window.partitionBy("doc").orderBy("pos", "id")
    n = g.chunks.select(F.col("id").alias("cur"), F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))
    for side in ("before", "after"):
        n = n.join(g.links.select(F.col("src").alias("cur"), F.col("dst").alias(side), F.col("sim").alias(f"{side}_sim")), ["cur", side], "left")
    return n.select("cur", "before", F.coalesce("before_sim", F.lit(0.0)).alias("before_sim"), "after", F.coalesce("after_sim", F.lit(0.0)).alias("after_sim"))


def sequential(anchors: DataFrame, g: Passages, most: int = 10, crossings: int = 3, readings: int = 3, paragraph: int = 5) -> DataFrame:
    """(group_id, strategy, chunk_ids, sentences, reason) of groups of ``crossings`` paragraphs, each read in a document of its own where the edges allow.

    A paragraph reads up to ``readings`` windows, or until it has ``paragraph`` sentences, each time going to the more similar of the windows before and after that it has not
    read, the one before where both are equal. Between paragraphs a group crosses to the best unvisited neighbour in the documents like its own, in order of theme similarity,
    else in any other; where there is none it reads on from the same chunk. Sentences are not told apart across paragraphs; ``most`` are kept, chunks all.
    """
    g = g.kept()
    near, doc = materialize(flow(g), "flow"), g.chunks.select("id", "doc")
    empty = F.array().cast("array<string>")
    state = anchors.select("group_id", F.col("id").alias("cur")).join(doc.select(F.col("id").alias("cur")), "cur").withColumn("path", F.array("cur")).withColumn("have", empty)
    links = g.links.select(F.col("src").alias("cur"), "dst", "sim")
    home, to = doc.toDF("cur", "doc"), doc.toDF("dst", "to")
    for crossing in range(crossings):
        if crossing:
            step = state.select("group_id", "cur", "path").join(links, "cur").join(home, "cur").join(to, "dst").filter((F.col("to") != F.col("doc")) & ~F.array_contains("path", F.col("dst")))
            step = step.join(g.themes.select("doc", F.col("other").alias("to"), F.col("rank").alias("like")), ["doc", "to"], "left")
            rank = F.coalesce(F.when(F.col("sim") > 0, F.col("like")), F.lit(1_000_000_000))
            best = step.groupBy("group_id").agg(F.min(F.struct(rank.alias("r"), (-F.col("sim")).alias("n"), "dst")).alias("b")).select("group_id", F.col("b.dst").alias("dst"))
            state = state.join(best, "group_id", "left").select("group_id", F.coalesce("dst", "cur").alias("cur"), F.when(F.col("dst").isNotNull(), F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"), "have")
        state = state.withColumn("start", F.col("cur")).withColumn("said", empty).withColumn("ids", empty)
        for reading in range(readings):
            state = materialize(state, "reading")
            x = state.join(g.held.select(F.col("id").alias("cur"), "texts"), "cur", "left").join(near, "cur", "left")
            x = x.withColumn("on", F.size("said") < paragraph)  # a paragraph that has enough neither reads nor moves
            x = x.withColumn("said", F.when(F.col("on"), F.concat("said", _fresh(F.coalesce("texts", empty), F.col("said")))).otherwise(F.col("said")))
            x = x.withColumn("ids", F.when(F.col("on") & ~F.array_contains("ids", F.col("cur")), F.concat("ids", F.array("cur"))).otherwise(F.col("ids")))
            unread = lambda c: F.col(c).isNotNull() & ~F.array_contains("ids", F.col(c))
            back = unread("before") & (~unread("after") | (F.col("before_sim") >= F.col("after_sim")))
            to_go = F.when(back, F.col("before")).when(unread("after"), F.col("after"))
            move = F.when(F.col("on") & F.lit(reading < readings - 1), F.coalesce(to_go, "cur")).otherwise(F.col("cur"))
            state = x.select("group_id", move.alias("cur"), "path", "have", "start", "said", "ids")
        state = state.select("group_id", F.element_at("ids", -1).alias("cur"), F.concat("path", F.filter("ids", lambda i: i != F.col("start"))).alias("path"), F.concat("have", "said").alias("have"))
        state = materialize(state, "paragraphs")
    return state.select("group_id", F.lit("sequential_multi_hop").alias("strategy"), F.col("path").alias("chunk_ids"), F.slice("have", 1, most).alias("sentences"), F.lit("read").alias("reason"))


def native(chunks: DataFrame, count: int, seed: int = 0, size: int = 3, least: float = 0.7) -> DataFrame:
    """(group_id, strategy, chunk_ids) of ``count`` groups of ``size`` chunks, drawn without traversal: no chunk is used twice, and a group's chunks are of different documents.

    The chunks of a document are put in seeded order; those of the same place, one a document, are drawn from together, in seeded order. Only chunks of quality ``least`` or
    more take part, unscored ones too; where there are none, all. A remainder smaller than ``size`` makes no group.
    """
    good = passing(chunks, least)
    pool = (chunks if good.isEmpty() else good).select("id", "doc", seeded(F.col("id"), seed).alias("h"))
    place = pool.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("h", "id")))
    # one chunk a document in a place: in seeded order, cut into groups
    n = place.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("h", "id")))
    n = n.filter(F.col("r") <= count * size).withColumn("n", F.col("r") - 1)  # no more can be needed of one place
    g = n.groupBy("place", F.floor(F.col("n") / size).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("chunk_ids")).filter(F.size("chunk_ids") == size)
    first = g.orderBy("place", "part").limit(count)
    return first.select(F.concat_ws(":", F.lit("native"), "place", "part").alias("group_id"), F.lit("native").alias("strategy"), "chunk_ids")


def groups(g: Passages, weights: dict[str, float], total: int, seed: int = 0, most: int = 10) -> DataFrame:
    """(group_id, strategy, chunk_ids, sentences, reason): ``total`` groups of several strategies by weight, each strategy from its own anchors, in seeded order."""
    unknown = set(weights) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    g, out = g.kept(), None
    for k, (name, count) in enumerate(sorted(allocation(weights, total).items())):
        if name == "native":
            got = native(g.chunks, count, seed + k)
            said = got.select("group_id", F.posexplode("chunk_ids").alias("p", "id")).join(g.held, "id", "left").groupBy("group_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("texts", F.array().cast("array<string>")).alias("t")))), lambda x: x["t"])).alias("sentences"))
            got = got.join(said, "group_id", "left").withColumn("sentences", F.slice("sentences", 1, most)).withColumn("reason", F.lit("drawn"))
        else:
            anchors = anchor_chunks(g.chunks, count, seed + k)
            got = sequential(anchors, g, most) if name == "sequential_multi_hop" else grown(name, anchors, g, most)
        got = got.select(F.concat_ws(":", F.lit(name), "group_id").alias("group_id"), "strategy", "chunk_ids", "sentences", "reason")
        out = got if out is None else out.unionByName(got)
    return out


def strategy_counts(made: DataFrame) -> DataFrame:
    """(strategy, n_groups, avg_chunks, avg_sentences) of groups."""
    return made.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg(F.size("chunk_ids")), 6).alias("avg_chunks"), F.round(F.avg(F.size("sentences")), 6).alias("avg_sentences"))
