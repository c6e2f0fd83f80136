"""Cosine top-k joins in blocks of matrix products, and statistics of the edges they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.functions import vector as V

#: Rows of a block; a pair of blocks is what one product holds.
BLOCK = 4000


def nodes(embeddings: DataFrame, key: str, group: str = "source_article") -> DataFrame:
    """(id, doc, raw, vec) with usable vectors, as they are and at unit length; an id that is repeated counts once."""
    v = embeddings.filter(F.col(key).isNotNull() & V.usable(F.col("embedding")))
    one = v.groupBy(F.col(key).alias("id")).agg(F.min(F.struct(F.col(group).alias("doc"), F.col("embedding").cast("array<double>").alias("e"))).alias("v"))
    return one.select("id", F.col("v.doc").alias("doc"), F.col("v.e").alias("raw"), V.unit(F.col("v.e")).alias("vec"))


def _best(k: int, least: float, other_doc: bool, left: list[pa.RecordBatch], right: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    if not left or not right:
        return None
    a, b = (pa.Table.from_batches(t).combine_chunks() for t in (left, right))
    x, y = (t.column("vec").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (a, b))
    ids_a, ids_b = (np.asarray(t.column("id").to_pylist(), dtype=object) for t in (a, b))
    order = np.argsort(ids_b)  # equal ones by smaller id
    sims = np.round(x @ y[order].T, V.DECIMALS)
    place = {i: p for p, i in enumerate(ids_b[order])}
    own = np.array([place.get(i, -1) for i in ids_a])
    sims[np.flatnonzero(own >= 0), own[own >= 0]] = -2
    if other_doc:
        da, db = (np.asarray(t.column("doc").to_pylist(), dtype=object) for t in (a, b))
        names = {d: n for n, d in enumerate(sorted({*da, *db} - {None}))}
        sims[np.array([names.get(d, -1) for d in da])[:, None] == np.array([names.get(d, -2) for d in db[order]])[None, :]] = -2
    if sims.shape[1] > 4 * k:  # what the k-th best reaches, with all that equal it
        floor = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
    else:
        floor = np.full(len(sims), least)
    rows, cols = np.nonzero(sims >= floor[:, None])
    s = sims[rows, cols]
    by = np.lexsort((cols, -s, rows))
    rows, cols, s = rows[by], cols[by], s[by]
    ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pa.RecordBatch.from_arrays([pa.array(ids_a[rows[ok]], pa.string()), pa.array(ids_b[order][cols[ok]], pa.string()), pa.array(s[ok])], ["src", "dst", "sim"])


def _products(k: int, least: float, other_doc: bool):
    """A partition's groups (g, i, j), sorted, each one matrix product of its left and right rows. One group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            g, i, j = (b.column(n).to_pylist() for n in ("g", "i", "j"))
            keys = list(zip(g, i, j))
            cuts = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
            role = b.column("role").to_numpy()
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != at:
                    if (out := _best(k, least, other_doc, left, right)) is not None:
                        yield out
                    at, left, right = keys[lo], [], []
                part, r = b.slice(lo, hi - lo).select(["id", "doc", "vec"]), role[lo:hi]
                for side, sign in ((left, 1), (right, -1)):
                    mine = np.flatnonzero(r * sign >= 0)  # 1 left, -1 right, 0 both
                    if len(mine):
                        side.append(part.take(pa.array(mine)))
        if (out := _best(k, least, other_doc, left, right)) is not None:
            yield out

    return run


def top_similar(left: DataFrame, right: DataFrame, k: int, least: float, same_doc: bool) -> DataFrame:
    """(src, dst, sim, rank): of each left row its ``k`` most similar right rows at ``least`` cosine, equal ones by smaller id.

    With ``same_doc`` candidates are of the row's own document, else of the others. Rows fall into blocks (within a document, if
    only it counts), and every pair of blocks that can hold candidates is one matrix product that emits its rows' best ``k``:
    a document of one block is sent once, no group meets in one task, and never all pairs are emitted. A row without candidates has no rows; ids
    are never their own.
    """
    alone = same_doc and left is right
    right = right.toDF(*right.columns)  # own attributes, where both sides are one table
    if same_doc:
        sizes = right.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
        left = left.join(sizes.select("doc", F.col("nb").alias("nl"), F.col("nb").alias("nr")), "doc")
        right = right.join(sizes.toDF("doc", "nb").select("doc", F.col("nb").alias("nl"), F.col("nb").alias("nr")), "doc")
        group = F.col("doc")
    else:
        nl, nr = (max(1, -(-d.count() // BLOCK)) for d in (left, right))
        left, right = (d.withColumn("nl", F.lit(nl)).withColumn("nr", F.lit(nr)) for d in (left, right))
        group = F.lit("")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "doc", "vec"]
    whole = None
    if alone:  # documents of one block: each row once, for both sides
        whole = left.filter("nr = 1").select(group.alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"), *cols)
        left, right = left.filter("nr > 1"), right.filter("nr > 1")
    li = left.select(group.alias("g"), own("nl").alias("i"), every("nr").alias("j"), F.lit(1).alias("role"), *cols)
    rj = right.select(group.alias("g"), every("nl").alias("i"), own("nr").alias("j"), F.lit(-1).alias("role"), *cols)
    rows = li.unionByName(rj) if whole is None else whole.unionByName(li).unionByName(rj)
    met = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_products(k, least, not same_doc), "src string, dst string, sim double")
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def clean_edges(connections: DataFrame) -> DataFrame:
    """(src, dst, sim, type): stored edges with finite scores, each pair once with its highest score, no chunk linked to itself."""
    c = connections.filter("source_chunk_id <> target_chunk_id AND similarity_score IS NOT NULL AND NOT isnan(similarity_score)")
    return c.groupBy(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst")).agg(F.max("similarity_score").alias("sim"), F.min("connection_type").alias("type"))


def sparse_edges(edges: DataFrame, intra: int = 15, inter: int = 5, least_intra: float = 0.4, least_inter: float = 0.3) -> DataFrame:
    """Per source the best ``intra`` edges inside its document and the best ``inter`` to others; ``rank`` within the type."""
    w = Window.partitionBy("src", "type").orderBy(F.col("sim").desc(), "dst")
    inside = F.col("type") == "intra_document"
    kept = edges.filter(F.col("sim") >= F.when(inside, least_intra).otherwise(least_inter))
    ranked = kept.withColumn("rank", F.row_number().over(w))
    # the literal limit lets each task keep only what can rank, so that a hot source is not shuffled whole
    return ranked.filter(F.col("rank") <= max(intra, inter)).filter(F.col("rank") <= F.when(inside, intra).otherwise(inter))


def edge_statistics(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.round(F.avg("sim"), 6).alias("avg_sim"), F.round(F.min("sim"), 9).alias("min_sim"), F.round(F.max("sim"), 9).alias("max_sim"))


def union(intra: DataFrame, inter: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, sim, rank, type, source_document, target_document): the edges inside documents and between them as one table; ``docs`` has id and doc."""
    e = intra.withColumn("type", F.lit("intra_document")).unionByName(inter.withColumn("type", F.lit("inter_document")))
    a, b = docs.select(F.col("id").alias("src"), F.col("doc").alias("source_document")), docs.select(F.col("id").alias("dst"), F.col("doc").alias("target_document"))
    return e.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "sim", "rank", "type", "source_document", "target_document")


def ordinals(nodes: DataFrame) -> DataFrame:
    """(id, n): a number from 0 for each id, in order of the ids.

    A global sort and the prefix sums of its partitions' sizes: no partition sees another's rows.
    """
    from passagemesh.runtime import materialize

    s = nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    s = materialize(s.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "ordinals")
    sizes = s.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("at")).alias("n"))


def coordinates(edges: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(src, dst, value), or with ``numbers`` (id, n) (matrix, row, col, value) of each type's matrix and the combined one: edges as coordinates; equal places add up."""
    if numbers is None:
        return edges.groupBy("src", "dst").agg(F.round(F.sum("sim"), 9).alias("value"))
    e = edges.join(numbers.select(F.col("id").alias("src"), F.col("n").alias("row")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("n").alias("col")), "dst")
    each = e.select(F.explode(F.array("type", F.lit("combined"))).alias("matrix"), "row", "col", "sim")
    return each.groupBy("matrix", "row", "col").agg(F.round(F.sum("sim"), 9).alias("value"))


def compressed(coords: DataFrame) -> DataFrame:
    """(matrix, row, cols, values): the rows of compressed sparse matrices, columns in order."""
    c = coords.groupBy("matrix", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    return c.select("matrix", "row", F.transform("c", lambda x: x["col"]).alias("cols"), F.transform("c", lambda x: x["value"]).alias("values"))


def vector_statistics(embeddings: DataFrame) -> DataFrame:
    """Count, dimension and mean and spread of the norms of the usable vectors."""
    v = embeddings.filter(V.usable(F.col("embedding"))).select(V.norm(F.col("embedding").cast("array<double>")).alias("n"), F.size("embedding").alias("d"))
    return v.agg(F.count(F.lit(1)).alias("vectors"), F.max("d").alias("dimension"), F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.stddev_pop("n"), 6).alias("std_norm"))
