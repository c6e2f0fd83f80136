"""Top N items within every group, by one global sort (problem 5).

The rows are range-partitioned and sorted on (group, score, tie keys), so a group of any size is spread
over as many partitions as it needs. Each partition numbers its own rows and drops those beyond its
N-th of a group, which cannot be among the group's first N; what is left is at most N rows per group and
partition. Counts of the survivors per (group, partition) are prefix-summed over the partitions, and
local number + prefix gives the exact position wherever it is at most N.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemesh.runtime import materialize

_PID, _POS = "__pid", "__pos"


def _local_positions(n: int, group: str):
    """Numbers the rows of sorted batches within their group, keeping numbers up to ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group)
            # null never equals null in Arrow, so a null group is compared by its nullness
            same = pc.or_(
                pc.fill_null(pc.equal(g[1:], g[:-1]), False),
                pc.and_(pc.is_null(g[1:]), pc.is_null(g[:-1])),
            ).to_numpy(zero_copy_only=False)
            import numpy as np

            idx = np.arange(b.num_rows)
            start = np.zeros(b.num_rows, dtype=np.int64)
            start[1:] = np.where(same, 0, idx[1:])
            start = np.maximum.accumulate(start)
            pos = idx - start + 1
            if seen and g[0].as_py() == last:
                pos = pos + np.where(start == 0, seen, 0)
            last, seen = g[-1].as_py(), int(pos[-1])
            keep = pos <= n
            if keep.any():
                out = b.append_column(_POS, pa.array(pos, pa.int64()))
                yield out.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: str, n: int, order: Sequence[Column], position: str = "position") -> DataFrame:
    """The first ``n`` rows of each ``group`` under ``order``, with their 1-based ``position``.

    ``order`` must decide every tie that matters; rows equal in it come in no defined order. Rows with a null
    ``group`` form one group. An empty input gives an empty result. Other columns pass through unchanged;
    ``position`` and the names ``__pid`` and ``__pos`` must not be among them.
    """
    clash = {position, _PID, _POS} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are reserved")
    if n < 1:
        raise ValueError("n must be positive")
    keys = [F.col(f"`{group}`").asc_nulls_first(), *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn(_PID, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(_POS, T.LongType())])
    kept = materialize(ranged.mapInArrow(_local_positions(n, group), schema), "topn")
    g = F.col(f"`{group}`")
    counts = kept.groupBy(g.alias("__g"), F.col(_PID).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # Only groups that start in an earlier partition have an offset; the rest join nothing.
    offsets = offsets.filter("__before > 0")
    joined = kept.join(offsets, g.eqNullSafe(F.col("__g")) & (F.col(_PID) == F.col("__p")), "left")
    exact = F.col(_POS) + F.coalesce(F.col("__before"), F.lit(0))
    return joined.withColumn(position, exact).filter(F.col(position) <= n).drop(_PID, _POS, "__g", "__p", "__before")


def best_targets(connections: DataFrame, n: int = 5) -> DataFrame:
    """Per ``source_chunk_id`` its ``n`` best targets: score descending, then target_document (nulls last), then target id.

    Rows with a null or NaN score, a null id, or a link of a chunk to itself are left out. A pair listed several
    times counts once, with its highest score; its target_document is the smallest one listed for it.
    """
    s, t = F.col("source_chunk_id"), F.col("target_chunk_id")
    score = F.col("similarity_score")
    pairs = (
        connections.select(s, t, score, "target_document")
        .filter(s.isNotNull() & t.isNotNull() & (s != t) & score.isNotNull() & ~F.isnan(score))
        .groupBy(s, t)
        .agg(F.max(score).alias("similarity_score"), F.min("target_document").alias("target_document"))
    )
    order = [F.col("similarity_score").desc(), F.col("target_document").asc_nulls_last(), F.col("target_chunk_id").asc()]
    return top_n(pairs, "source_chunk_id", n, order)
