"""From articles to the graph's tables, in phases that are kept and skipped, and a benchmark of the retrieval algorithms over it.

    python -m passagemesh.pipeline build --tables DIR --out DIR [--fresh] [--skip themes ...]
    python -m passagemesh.pipeline benchmark --tables DIR --out DIR [--algorithms NAME ...]
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemesh.operators import corpus, evaluate, graph, similarity, themes, traversal
from passagemesh.runtime import table
from passagemesh.sources import stores

log = logging.getLogger(__name__)
PHASES = ("chunks", "edges", "themes", "graph")


@dataclass(frozen=True)
class Config:
    """What the pipeline does; wrong values raise ValueError."""

    window: int = 3
    overlap: int = 2
    intra: int = 15
    inter: int = 5
    least_intra: float = 0.4
    least_inter: float = 0.3
    themes: int = 5
    limits: traversal.Limits = field(default_factory=traversal.Limits)
    algorithms: tuple[str, ...] = traversal.ALGORITHMS
    skip: tuple[str, ...] = ()
    fresh: bool = False

    def __post_init__(self) -> None:
        if self.window < 1 or not 0 <= self.overlap < self.window:
            raise ValueError("0 <= overlap < window is required")
        if unknown := set(self.skip) - set(PHASES):
            raise ValueError(f"unknown phases: {', '.join(sorted(unknown))}")
        if unknown := set(self.algorithms) - set(traversal.ALGORITHMS):
            raise ValueError(f"unknown algorithms: {', '.join(sorted(unknown))}")

    @classmethod
    def read(cls, path: str, **overrides) -> Config:
        """From a JSON file; unknown keys raise TypeError."""
        with open(path) as f:
            got = json.load(f)
        if "limits" in got:
            got["limits"] = traversal.Limits(**got["limits"])
        for k in ("algorithms", "skip"):
            if k in got:
                got[k] = tuple(got[k])
        return replace(cls(**got), **overrides)


def _inputs(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    return {n: table(spark, tables, n) for n in ("articles", "chunks", "chunk_embeddings", "sentence_embeddings", "document_nodes")}


def build(spark: SparkSession, tables: str, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The graph's tables by name, each phase kept below ``out`` and made again only if its inputs or configuration changed, or ``fresh`` is set; skipped phases must have been kept."""
    t, made = _inputs(spark, tables), {}
    nodes = similarity.nodes(t["chunk_embeddings"], "chunk_id").withColumn("doc", F.coalesce("doc", F.lit("")))

    def edges() -> dict[str, DataFrame]:
        n = nodes.select("id", "doc", "vec")
        inside = similarity.top_similar(n, n, config.intra, config.least_intra, same_doc=True)
        across = similarity.top_similar(n, n.select("*"), config.inter, config.least_inter, same_doc=False)
        return {"edges": similarity.union(inside, across, n.select("id", "doc"))}

    def assembled() -> dict[str, DataFrame]:
        e = made["edges"]
        return {
            "documents": graph.document_nodes(t["chunks"], corpus.summaries(t["articles"])),
            "chunk_nodes": graph.chunk_nodes(nodes.select("id", "doc", "vec"), e),
            "sentence_nodes": graph.sentence_nodes(t["sentence_embeddings"]),
            "bridge": graph.bridge(t["sentence_embeddings"]),
        }

    docs = t["document_nodes"].select("doc_id", "title", F.col("doc_summary").alias("summary")).distinct()
    steps = {
        "chunks": (lambda: {"windows": corpus.windows(t["articles"].filter("title IS NOT NULL").select("title", "sentences").distinct(), config.window, config.overlap)}, [t["articles"]]),
        "edges": (edges, [t["chunk_embeddings"]]),
        "themes": (lambda: {"themes": themes.extracted(docs, most=config.themes)}, [docs]),
        "graph": (assembled, [t["chunks"], t["chunk_embeddings"], t["sentence_embeddings"]]),
    }
    for name, (make, inputs) in steps.items():
        where = f"{out}/{name}"
        if name in config.skip:
            got = stores.load(spark, where)
            if got is None:
                raise ValueError(f"phase {name} is skipped, but {where} has no tables")
        else:
            known = {k: v for k, v in asdict(config).items() if k not in ("skip", "fresh", "algorithms", "limits")}
            got = stores.cached(spark, where, stores.made_from(known, *inputs), make, config.fresh)
        log.info("phase %s: %s", name, ", ".join(got))
        made |= got
    return made


def benchmark(spark: SparkSession, tables: str, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """Answers of the configured algorithms to the stated queries over the built graph, and how they compare; kept below ``out``."""
    made, t = build(spark, tables, out, config), _inputs(spark, tables)
    nodes = similarity.nodes(t["chunk_embeddings"], "chunk_id").withColumn("doc", F.coalesce("doc", F.lit("")))
    g = traversal.graph(nodes, made["edges"], t["sentence_embeddings"])
    queries = nodes.filter(traversal.is_query(F.col("id"))).select("id", "raw", "vec")
    answers = traversal.retrieve_all(queries, g, config.algorithms, config.limits)
    stores.save({"answers": answers, "comparison": evaluate.content_comparison(answers)}, f"{out}/benchmark")
    return stores.load(spark, f"{out}/benchmark")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=("build", "benchmark"))
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--skip", nargs="*", default=[])
    p.add_argument("--algorithms", nargs="*", default=list(traversal.ALGORITHMS))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    extra = {"fresh": a.fresh, "skip": tuple(a.skip), "algorithms": tuple(a.algorithms)}
    config = Config.read(a.config, **extra) if a.config else Config(**extra)
    spark = SparkSession.builder.getOrCreate()
    got = (build if a.what == "build" else benchmark)(spark, a.tables, a.out, config)
    print(json.dumps({name: df.count() for name, df in got.items()}))


if __name__ == "__main__":
    main()
