"""Retrieval: queries against all nodes, and walks over the graph for all queries at once.

A walk's state is one row a query. A hop joins the states, which are few and broadcast when counted small, with the sentences and
neighbours of where they stand, takes each query's move by the algorithm's rule, and writes the new states, so a hop is a job for all
queries and the lineage never grows. The graph's tables are computed once a walk and only read afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from passagemesh.functions import vector as V
from passagemesh.operators.similarity import top_similar
from passagemesh.runtime import BROADCAST_ROWS, bounded, materialize

ALGORITHMS = ("basic_retrieval", "query_traversal", "ssg_traversal", "triangulation_average", "triangulation_geometric_3d", "triangulation_geometric_fulldim", "llm_guided_traversal")


@dataclass(frozen=True)
class Limits:
    """A walk stops with ``sentences`` gathered or after ``hops``; ``early`` turns the early stops on; ``candidates`` are what a guided walk chooses from."""

    sentences: int = 10
    hops: int = 20
    early: bool = True
    candidates: int = 5


@dataclass(frozen=True)
class Graph:
    """nodes (id, doc, raw, vec): chunks with their vectors, as they are and at unit length; edges (src, dst, ord): neighbours in order; held (id, l): a
    chunk's sentences in order, each with text, its own vector ``v``, the one ``c`` of the first sentence of that text (null where
    unusable), the first chunk ``src`` that holds the text and that chunk's vector ``sv``."""

    nodes: DataFrame
    edges: DataFrame
    held: DataFrame

    def kept(self) -> Graph:
        """Computed once, in the shared folder."""
        return Graph(materialize(self.nodes, "nodes"), materialize(self.edges.select("src", "dst", "ord"), "edges"), materialize(self.held, "held"))


def graph(nodes: DataFrame, edges: DataFrame, sentences: DataFrame) -> Graph:
    """The graph of ``nodes`` (id, doc, raw, vec), ``edges`` (src, dst, type, rank) and ``sentences`` (sentence_id, sentence_text, sentence_index, embedding,
    containing_chunks).

    Neighbours inside the document come first, then those of other documents, each by rank. Sentences without an id or text are left out; an id
    that is repeated counts once. Sentences are the same when their texts are; the one of the smallest id stands for a text.
    """
    inside = F.when(F.col("type") == "intra_document", 0).otherwise(1)
    order = Window.partitionBy("src", "dst").orderBy("o", "rank")
    e = edges.withColumn("o", inside).withColumn("r", F.row_number().over(order)).filter("r = 1").select("src", "dst", (F.col("o") * 1_000_000 + F.col("rank")).cast("int").alias("ord"))
    s = sentences.filter("sentence_id IS NOT NULL AND sentence_text IS NOT NULL").groupBy(F.col("sentence_id").alias("sid")).agg(
        F.min(F.struct(F.col("sentence_text").alias("text"), F.coalesce("sentence_index", F.lit(0)).alias("idx"), F.col("containing_chunks").alias("chunks"), F.when(V.usable(F.col("embedding")), F.col("embedding").cast("array<double>")).alias("e"))).alias("s")
    )
    s = materialize(s.select("sid", "s.text", "s.idx", "s.chunks", F.col("s.e").alias("raw"), F.when(F.col("s.e").isNotNull(), V.unit(F.col("s.e"))).alias("v")), "sentences")
    first = s.groupBy("text").agg(F.min(F.struct("sid", "v")).alias("f")).select("text", F.col("f.v").alias("c"))
    bridge = s.select("sid", "text", "idx", "raw", "v", F.explode(F.array_distinct("chunks")).alias("id")).filter("id IS NOT NULL")
    src = bridge.groupBy("text").agg(F.min("id").alias("src"))
    src = src.join(nodes.select(F.col("id").alias("src"), F.col("vec").alias("sv")), "src", "left")
    every = bridge.join(first, "text").join(src, "text")
    held = every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "sid", "text", "raw", "v", "c", "src", "sv"))).alias("l"))
    return Graph(nodes, e, held)


def is_query(key: Column) -> Column:
    """The stated query set: every row whose hashed id is divisible by 20."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") % 20 == 0


def anchors(queries: DataFrame, nodes: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, id, sim, rank): the ``k`` nodes most similar to each query, over all nodes, in blocks."""
    q = queries.select(F.concat(F.lit("q:"), F.col("id")).alias("id"), F.lit(None).cast("string").alias("doc"), "vec")
    got = top_similar(q, nodes.select("id", F.coalesce("doc", F.lit("")).alias("doc"), "vec"), k, -1.0, same_doc=False)
    return got.select(F.expr("substring(src, 3)").alias("query_id"), F.col("dst").alias("id"), "sim", "rank")


_near = lambda a, b: F.round(V.dot(a, b), V.DECIMALS)
_away = lambda q, cur, cand: F.round(V.centroid_distance(q, cur, cand), V.DECIMALS)
_mean = lambda a, b, c: F.round((a + b + c) / 3.0, V.DECIMALS)


@dataclass(frozen=True)
class Rule:
    """How an algorithm weighs a neighbour and a sentence of the current chunk: a pair of columns (order, smaller first; measure, that the score is the mean of).

    The arguments are the query, the current chunk and the candidate, each with ``u``, at unit length, and ``r``, as it is. A rule without ``sentence`` weighs no sentences.
    """

    chunk: Callable[..., tuple[Column, Column]]
    sentence: Callable[..., tuple[Column, Column]] | None = None


def _average(m: Column) -> tuple[Column, Column]:
    return F.round(F.abs(m - 1.0), V.DECIMALS), m


_TRI = Rule(lambda q, h, c: _average(_mean(_near(q["u"], h["u"]), _near(q["u"], c["u"]), _near(h["u"], c["u"]))), lambda q, h, c: _average(_mean(_near(q["u"], h["u"]), _near(q["u"], c["u"]), _near(q["u"], c["u"]))))
_GEO = Rule(*[lambda q, h, c: (_away(q["r"], h["r"], c["r"]),) * 2] * 2)
_BY_QUERY = Rule(lambda q, h, c: (-_near(q["u"], c["u"]), _near(q["u"], c["u"])))
RULES = {
    "query_traversal": _BY_QUERY,
    "ssg_traversal": Rule(lambda q, h, c: (-_near(h["u"], c["u"]), _near(h["u"], c["u"]))),
    "triangulation_average": _TRI,
    "triangulation_geometric_3d": _GEO,
    "triangulation_geometric_fulldim": _GEO,
    "llm_guided_traversal": _BY_QUERY,
}


def walk(algorithm: str, queries: DataFrame, g: Graph, limits: Limits = Limits(), chooser: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, path, gathered, confidence, sources, score, hops) of each query's walk from its anchor, the chunk most similar to it.

    ``queries`` has id, raw and vec. While fewer than ``sentences`` are gathered and hops are left, a hop gathers the sentences of the current chunk that are not
    yet gathered (at the anchor all of them), and moves:

    * query_traversal: to the unvisited neighbour most similar to the query; stops early when eight are gathered and one of them is more similar to it than all neighbours;
    * ssg_traversal: to the neighbour most similar to the current chunk of those that share no gathered sentence; visited ones are not left out for being visited; stops
      early when that similarity is not above the last move's. It gathers right after moving;
    * triangulation_average: by how near the mean of the three similarities of query, current chunk and candidate is to 1, candidates being neighbours and the chunk's own
      sentences; ends when a sentence is best; stops early when eight are gathered and the mean of one of them with its first chunk is above the best neighbour's;
    * triangulation_geometric_fulldim, _3d: by the distance of the query to the centroid of the triangle, of raw vectors; ends when a sentence is best;
    * llm_guided_traversal: as ``chooser`` says, given the ids of the best unvisited neighbours and the number of gathered sentences: their number from 1, 0 to stop; anything else is the first.

    Equal candidates go by similarity to the query, then neighbours before sentences, in stored order. score is the mean confidence of what is gathered (its similarity to the
    query, 0.5 where it has no vector), for the triangulations the mean measure of each hop's best candidate. hops counts moves. A query without nodes has no row.
    """
    rule = RULES[algorithm]
    semantic, average, guided, geometric = (algorithm == a for a in ("ssg_traversal", "triangulation_average", "llm_guided_traversal", "triangulation_geometric_fulldim"))
    geometric = geometric or algorithm == "triangulation_geometric_3d"
    # only what the algorithm looks at is kept: vectors are most of a row
    weighs = rule.sentence is not None
    none_ = F.lit(None).cast("array<double>")
    fields = {"text": True, "raw": geometric, "v": weighs, "c": True, "src": True, "sv": average}
    slim = F.transform("l", lambda s: F.struct(*[(s[f] if on else none_).alias(f) for f, on in fields.items()]))
    pair = F.struct(F.col("vec").alias("u"), (F.col("raw") if geometric else none_).alias("r"))
    g = Graph(g.nodes.select("id", "doc", pair.alias("p"), "vec"), g.edges, g.held.select("id", slim.alias("l"))).kept()
    queries = materialize(queries.select(F.col("id").alias("query_id"), pair.alias("q")), "queries")
    first = anchors(queries.select(F.col("query_id").alias("id"), F.col("q.u").alias("vec")), g.nodes).select("query_id", F.col("id").alias("cur"))
    none = F.expr("cast(array() as array<struct<text:string,conf:double,src:string,sv:array<double>,has:boolean>>)")
    state = queries.join(first, "query_id").select(
        "query_id", "q", "cur", F.array("cur").alias("path"), none.alias("ext"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0.0).alias("last"), F.lit(False).alias("done")
    )
    state = materialize(state, "walk")
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # checked once: the live states only get fewer
    here = g.nodes.select(F.col("id").alias("cur"), F.col("p").alias("h"))
    held = g.held.select(F.col("id").alias("cur"), "l")
    cand = g.nodes.select(F.col("id").alias("dst"), F.col("p").alias("c"))
    texts = g.held.select(F.col("id").alias("dst"), F.transform("l", lambda s: s["text"]).alias("texts"))
    links = g.edges.select(F.col("src").alias("cur"), "dst", "ord")
    over = []
    for hop in range(1, limits.hops + 1):
        live = F.broadcast(state) if few else state
        step = live.select("query_id", "q", "cur", "path").join(links, "cur").join(here, "cur").join(cand, "dst")
        step = step.join(texts, "dst", "left") if semantic else step.withColumn("texts", F.lit(None).cast("array<string>"))
        k, m = rule.chunk(F.col("q"), F.col("h"), F.col("c"))
        e = F.struct(k.alias("k"), (-_near(F.col("q.u"), F.col("c.u"))).alias("nq"), "ord", "dst", m.alias("m"), F.array_contains("path", F.col("dst")).alias("seen"), "texts")
        cands = step.select("query_id", e.alias("e")).groupBy("query_id").agg(F.array_sort(F.collect_list("e")).alias("cands"))
        x = _gathered(live.join(held, "cur", "left"), hop > 1 and not semantic, limits).join(here, "cur", "left").join(cands, "query_id", "left")
        ended = F.col("full") | (F.size("ext") >= limits.sentences) if semantic or hop == 1 else F.col("full")
        x = x.withColumn("ended", ended)
        c = F.coalesce("cands", F.array().cast("array<struct<k:double,nq:double,ord:int,dst:string,m:double,seen:boolean,texts:array<string>>>"))
        if semantic:
            have = F.transform("ext", lambda e: e["text"])
            c = F.filter(c, lambda e: ~F.coalesce(F.arrays_overlap(have, e["texts"]), F.lit(False)))
        best = F.get(c, F.lit(0))
        move = best["dst"] if semantic else F.get(F.filter(c, lambda e: ~e["seen"]), F.lit(0))["dst"]
        if guided:
            ids = F.slice(F.transform(F.filter(c, lambda e: ~e["seen"]), lambda e: e["dst"]), 1, limits.candidates)
            choice = F.coalesce((chooser(ids, F.size("ext")) if chooser else F.lit(1)).cast("int"), F.lit(1))
            move = F.when(choice == 0, F.lit(None)).otherwise(F.coalesce(F.get(ids, F.when(choice.between(1, limits.candidates), choice - 1).otherwise(0)), F.get(ids, F.lit(0))))
        stop, measured = F.lit(False), F.lit(None).cast("double")
        if rule.sentence:  # sentences that have a vector are candidates too

            def weigh(s: Column) -> Column:
                k, m = rule.sentence(F.col("q"), F.col("h"), F.struct(s["v"].alias("u"), s["raw"].alias("r")))
                return F.struct(k.alias("k"), (-_near(F.col("q.u"), s["v"])).alias("nq"), m.alias("m"))

            s1 = F.get(F.array_sort(F.transform(F.filter("l", lambda s: s["v"].isNotNull()), weigh)), F.lit(0))
            wins = s1.isNotNull() & F.coalesce(best.isNull() | (s1["k"] < best["k"]) | ((s1["k"] == best["k"]) & (s1["nq"] < best["nq"])), F.lit(False))
            measured = F.when(wins, s1["m"]).otherwise(best["m"])
            stop = stop | wins
        if limits.early and algorithm == "query_traversal":
            most = F.array_max(F.transform(c, lambda e: -e["nq"]))
            top = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(F.filter("ext", lambda e: e["has"]), lambda e: e["conf"])), F.lit(0.0)))
            stop = stop | F.coalesce((F.size("ext") >= 8) & (top > most), F.lit(False))
        if limits.early and semantic and hop > 1:
            stop = stop | F.coalesce(best["m"] <= F.col("last"), F.lit(False))
        if limits.early and average:
            of = lambda e: _mean(_near(F.col("q.u"), F.col("h.u")), e["conf"], F.coalesce(_near(F.col("h.u"), e["sv"]), F.lit(0.0)))
            top = F.array_max(F.transform(F.filter("ext", lambda e: e["has"]), of))
            stop = stop | F.coalesce((F.size("ext") >= 8) & (top > best["m"]), F.lit(False))
        moved = x.withColumn("to", F.when(~F.col("ended") & ~stop, move)).withColumn("measured", F.when(~F.col("ended"), measured)).withColumn("m", best["m"])
        seen = Observation()
        moved = moved.select(
            "query_id", "q", F.coalesce("to", "cur").alias("cur"), F.when(F.col("to").isNotNull(), F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"), "ext",
            (F.col("total") + F.coalesce("measured", F.lit(0.0))).alias("total"), (F.col("n") + F.col("measured").isNotNull().cast("int")).alias("n"),
            F.when(F.col("to").isNotNull() & F.lit(semantic), F.col("m")).otherwise(F.col("last")).alias("last"), F.col("to").isNull().alias("done"),
        ).observe(seen, F.count_if(~F.col("done")).alias("live"))
        moved = materialize(moved, "walk")
        over.append(moved.filter("done"))
        state = moved.filter("NOT done")
        if not seen.get["live"]:
            break
    else:
        if semantic and limits.hops:  # what the last move reached
            state = _gathered(state.join(held, "cur", "left"), False, limits).select(*state.columns)
        over.append(state)
    every = over[0]
    for part in over[1:]:
        every = every.unionByName(part)
    got = F.slice("ext", 1, limits.sentences)
    of = lambda f: F.transform(got, lambda e: e[f])
    mean = F.when(F.size("ext") > 0, F.aggregate(got, F.lit(0.0), lambda a, e: a + e["conf"]) / F.size(got)).otherwise(F.lit(0.0))
    if average or geometric:
        mean = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0))
    return every.select("query_id", "path", of("text").alias("gathered"), of("conf").alias("confidence"), of("src").alias("sources"), F.round(mean, 6).alias("score"), (F.size("path") - 1).alias("hops"))


def _gathered(x: DataFrame, guarded: bool, limits: Limits) -> DataFrame:
    """States with the sentences ``l`` of the current chunk, those that are new among the gathered; ``full`` are those that, ``guarded``, gather no more."""
    x = x.withColumn("l", F.coalesce("l", F.array().cast(dict(x.dtypes)["l"]))).withColumn("full", (F.size("ext") >= limits.sentences) if guarded else F.lit(False))
    new = F.transform("l", lambda s: F.struct(s["text"].alias("text"), F.coalesce(_near(F.col("q.u"), s["c"]), F.lit(0.5)).alias("conf"), s["src"].alias("src"), s["sv"].alias("sv"), s["c"].isNotNull().alias("has")))
    fresh = F.filter(new, lambda s: ~F.exists("ext", lambda e: e["text"] == s["text"]))
    return x.withColumn("ext", F.when(F.col("full"), F.col("ext")).otherwise(F.concat("ext", fresh)))


def basic(queries: DataFrame, g: Graph, limits: Limits = Limits()) -> DataFrame:
    """(query_id, path, gathered, confidence, sources, score, hops): chunks by similarity to the query until enough sentences are gathered; chunks that add none are left out.

    Stops early when five are gathered and the next chunk is less similar to the query than one of them. The nearest chunks come first; queries that they leave short
    are asked again for twice as many, until they are done or have seen every chunk. score is the mean similarity of the chunks used; hops is 0.
    """
    g = g.kept()
    queries = materialize(queries.select("id", "raw", "vec"), "queries")
    k, rest, full, every = 2 * limits.sentences, queries, None, None
    while True:
        near = anchors(rest, g.nodes, k).join(g.held, "id", "left").join(bounded(rest.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))), "query_id")
        got = materialize(_filled(near, limits), "basic")
        short = got.filter("NOT ended")
        every = g.nodes.count() if every is None else every
        if k >= every or short.isEmpty():
            return (full.unionByName(got) if full is not None else got).drop("ended")
        more = got.filter("ended")
        full = full.unionByName(more) if full is not None else more
        rest, k = queries.join(bounded(short.select(F.col("query_id").alias("id"))), "id", "left_semi"), 2 * k


def _filled(near: DataFrame, limits: Limits) -> DataFrame:
    """The answers of :func:`basic` from the chunks ``near`` (query_id, q, id, sim, rank, l), and whether more chunks could not change them."""
    said = F.transform("l", lambda s: F.struct(s["text"].alias("text"), F.coalesce(_near(F.col("q"), s["c"]), F.lit(0.5)).alias("conf"), s["src"].alias("src"), s["c"].isNotNull().alias("has")))
    ext = "array<struct<text:string,conf:double,src:string,has:boolean>>"
    one = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "sim", F.coalesce(said, F.array().cast(ext)).alias("s")))).alias("c"))
    zero = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(ext).alias("ext"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(False).alias("ended"))

    def step(acc: Column, x: Column) -> Column:
        new = F.filter(x["s"], lambda s: ~F.exists(acc["ext"], lambda e: e["text"] == s["text"]))
        early = F.lit(limits.early) & (F.size(acc["ext"]) >= 5) & (x["sim"] < acc["best"])
        ended = acc["ended"] | early | (F.size(acc["ext"]) >= limits.sentences)
        use = ~ended & (F.size(new) > 0)
        best = F.greatest(acc["best"], F.coalesce(F.array_max(F.transform(F.filter(new, lambda s: s["has"]), lambda s: s["conf"])), F.lit(0.0)))
        keep = F.struct(acc["path"].alias("path"), acc["ext"].alias("ext"), acc["total"].alias("total"), acc["best"].alias("best"), ended.alias("ended"))
        return F.when(use, F.struct(F.concat(acc["path"], F.array(x["id"])).alias("path"), F.concat(acc["ext"], new).alias("ext"), (acc["total"] + x["sim"]).alias("total"), best.alias("best"), F.lit(False).alias("ended"))).otherwise(keep)

    r = one.select("query_id", F.aggregate("c", zero, step).alias("r"))
    n, got = F.size("r.path"), F.slice("r.ext", 1, limits.sentences)
    part = lambda f: F.transform(got, lambda e: e[f])
    return r.select("query_id", F.col("r.path").alias("path"), part("text").alias("gathered"), part("conf").alias("confidence"), part("src").alias("sources"), F.round(F.when(n > 0, F.col("r.total") / n).otherwise(F.lit(0.0)), 6).alias("score"), F.lit(0).alias("hops"), (F.col("r.ended") | (F.size("r.ext") >= limits.sentences)).alias("ended"))


def reduced(queries: DataFrame, g: Graph, k: int = 3) -> tuple[DataFrame, Graph]:
    """Queries and graph with ``raw`` projected on the ``k`` leading principal directions of all queries, chunks and sentences; ``vec`` stays."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    said = g.held.select(F.explode("l").alias("s")).select(F.col("s.sid").alias("sid"), F.col("s.raw").alias("raw")).filter("raw IS NOT NULL").distinct()
    rows = g.nodes.select("raw").unionByName(queries.select("raw")).unionByName(said.select("raw")).select(array_to_vector("raw").alias("v"))
    main = PCA(k=k, inputCol="v", outputCol="p").fit(rows).pc.toArray().T.tolist()  # k rows of 64
    project = lambda v: F.array(*[V.dot(v, F.array(*map(F.lit, row))) for row in main])
    fields = ("idx", "sid", "text", "raw", "v", "c", "src", "sv")
    held = g.held.select("id", F.transform("l", lambda s: F.struct(*[(F.when(s["raw"].isNotNull(), project(s["raw"])) if f == "raw" else s[f]).alias(f) for f in fields])).alias("l"))
    return queries.withColumn("raw", project(F.col("raw"))), replace(g, nodes=g.nodes.withColumn("raw", project(F.col("raw"))), held=held)


def retrieve(algorithm: str, queries: DataFrame, g: Graph, limits: Limits = Limits(), chooser: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The answers of one of ALGORITHMS, with its name in ``algorithm`` and in ``error`` why a query has none; an unknown name raises ValueError."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known are {', '.join(ALGORITHMS)}")
    if algorithm == "basic_retrieval":
        got = basic(queries, g, limits)
    elif algorithm == "triangulation_geometric_3d":
        got = walk(algorithm, *reduced(queries, g), limits)
    else:
        got = walk(algorithm, queries, g, limits, chooser)
    empty = F.array().cast("array<string>")
    every = queries.select(F.col("id").alias("query_id")).join(got, "query_id", "left")
    error = F.when(F.col("path").isNull(), "no anchor")
    return every.select(
        "query_id", F.lit(algorithm).alias("algorithm"), F.coalesce("path", empty).alias("path"), F.coalesce("gathered", empty).alias("gathered"), F.coalesce("confidence", empty.cast("array<double>")).alias("confidence"),
        F.coalesce("sources", empty).alias("sources"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("hops", F.lit(0)).alias("hops"), error.alias("error"),
    )


def retrieve_all(queries: DataFrame, g: Graph, algorithms: tuple[str, ...] = ALGORITHMS, limits: Limits = Limits(), chooser: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The answers of several algorithms over one graph, computed once; one that fails gives an empty answer with the error for every query."""
    g, out = g.kept(), None
    for a in algorithms:
        try:
            got = materialize(retrieve(a, queries, g, limits, chooser), "answers")
        except ValueError:
            raise
        except Exception as e:  # noqa: BLE001 - one algorithm's failure is a row of the result
            none = F.array().cast("array<string>")
            got = queries.select(F.col("id").alias("query_id"), F.lit(a).alias("algorithm"), none.alias("path"), none.alias("gathered"), none.cast("array<double>").alias("confidence"), none.alias("sources"), F.lit(0.0).alias("score"), F.lit(0).alias("hops"), F.lit(str(e)[:500]).alias("error"))
        out = got if out is None else out.unionByName(got)
    return out


def query_similarities(queries: DataFrame, nodes: DataFrame, sentences: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, id, sim, rank): of each query the ``k`` most similar chunks and, apart, sentences; both tables have id and vec."""
    with_doc = lambda d: d.select("id", F.lit("").alias("doc"), "vec")
    c, s = anchors(queries, with_doc(nodes), k), anchors(queries, with_doc(sentences), k)
    return c.withColumn("kind", F.lit("chunk")).unionByName(s.withColumn("kind", F.lit("sentence"))).select("query_id", "kind", "id", "sim", "rank")


def hybrid(standing: DataFrame, g: Graph) -> DataFrame:
    """(query_id, id, kind, sim, rank): the neighbours and the sentences with a vector of where each query stands (query_id, cur, q), by similarity to the query; equal ones neighbours first, in stored order."""
    at = standing.select("query_id", "cur", "q")
    chunks = at.join(g.edges.select(F.col("src").alias("cur"), F.col("dst").alias("id"), "ord"), "cur").join(g.nodes.select("id", "vec"), "id").select("query_id", "id", F.lit("chunk").alias("kind"), "ord", _near(F.col("q"), F.col("vec")).alias("sim"))
    said = at.join(g.held.select(F.col("id").alias("cur"), F.explode("l").alias("s")), "cur").filter("s.v IS NOT NULL").select("query_id", F.col("s.sid").alias("id"), F.lit("sentence").alias("kind"), F.lit(2_000_000_000).alias("ord"), _near(F.col("q"), F.col("s.v")).alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "ord", "id")
    return chunks.unionByName(said).withColumn("rank", F.row_number().over(w)).drop("ord")
