"""Context groups, goldens and the aggregates of an evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocation(weights: dict[str, float], total: int) -> dict[str, int]:
    """Groups per strategy: floors of the weighted shares, the rest by weight in turn; equal weights where all are zero."""
    if not weights:
        return {}
    w = weights if sum(weights.values()) > 0 else dict.fromkeys(weights, 1.0)
    out = {k: math.floor(total * v / sum(w.values())) for k, v in w.items()}
    order = sorted(w, key=lambda k: -w[k])
    for i in range(total - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


#: Blanks of any script at either end, as Java and RE2 both know them.
EDGES = "^[ \\t\\n\\r\\f\\p{Z}]+|[ \\t\\n\\r\\f\\p{Z}]+$"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, EDGES, "")


def regrouped(texts: DataFrame, size: int = 3, most: int = 8000, least: int = 200) -> DataFrame:
    """(id, group, text): sentences split at full stops, repeated ones dropped in order, regrouped by ``size``.

    The groups of a text together have at most ``most`` characters: the first that goes beyond is cut there, with ... at its end, if more than ``least`` are left for it; later ones are left out.
    """
    parts = F.array_distinct(F.filter(F.transform(F.split("text", "\\."), stripped), lambda s: s != ""))
    t = texts.select("id", parts.alias("p")).filter("size(p) > 0")
    g = t.select("id", "p", F.explode(F.sequence(F.lit(0), ((F.size("p") - 1) / size).cast("int"))).alias("group"))
    g = g.select("id", "group", F.concat(F.array_join(F.slice("p", F.col("group") * size + 1, F.lit(size)), ". "), F.lit(".")).alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("id").orderBy("group"))  # a text's groups
    left = F.lit(most) - (F.col("upto") - F.length("text"))
    g = g.withColumn("upto", upto).withColumn("left", left).filter((F.col("upto") <= most) | (F.col("left") > least))
    return g.select("id", "group", F.when(F.col("upto") <= most, F.col("text")).otherwise(F.concat(F.expr("left(text, left)"), F.lit("..."))).alias("text"))


def sentence_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "[.!?]+( +|$)"), stripped), lambda s: s != ""))


def overlap(pairs: DataFrame) -> DataFrame:
    """(id, n_truth, n_found, share, band): how many sentences of ``truth`` stand in ``answer``."""
    p = pairs.select("id", sentence_set(F.col("truth")).alias("t"), sentence_set(F.col("answer")).alias("a"))
    n, k = F.size("t"), F.size(F.array_intersect("t", "a"))
    share = F.when(n > 0, F.round(100.0 * k / n, 6)).otherwise(F.lit(0.0))
    return p.select("id", n.alias("n_truth"), k.alias("n_found"), share.alias("share"), F.when(share >= 50, "good").when(share >= 25, "fair").otherwise("poor").alias("band"))


def metric_summary(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(algorithm, metric, avg_score, success_rate, std, winner) of results (algorithm, case_id, metric, score); null scores are left out."""
    g = results.filter("score IS NOT NULL").groupBy("algorithm", "metric").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("success_rate"), F.round(F.stddev_pop("score"), 6).alias("std"))
    best = g.groupBy("metric").agg(F.max("avg_score").alias("best"))
    return g.join(best, "metric").select("algorithm", "metric", "avg_score", "success_rate", "std", (F.col("avg_score") == F.col("best")).alias("winner"))


def case_results(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(algorithm, case_id, n_metrics, n_passed, success) of results (algorithm, case_id, metric, score): a case succeeds when any of its metrics reaches ``threshold``. Null scores pass nothing."""
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return results.groupBy("algorithm", "case_id").agg(F.count("score").alias("n_metrics"), F.count_if(ok).alias("n_passed"), F.bool_or(ok).alias("success"))


def ranking(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(algorithm, cases, successful, success_rate, overall, spread, efficiency, rank): overall is the mean of the metrics' means, spread their population deviation, efficiency
    the overall score by the metrics judged a case. The best overall ranks first, equal ones alike."""
    means = results.filter("score IS NOT NULL").groupBy("algorithm", "metric").agg(F.avg("score").alias("m"))
    overall = means.groupBy("algorithm").agg(F.round(F.avg("m"), 6).alias("overall"), F.round(F.stddev_pop("m"), 6).alias("spread"))
    c = case_results(results, threshold)
    cases = c.groupBy("algorithm").agg(F.count(F.lit(1)).alias("cases"), F.count_if("success").alias("successful"), F.sum("n_metrics").alias("judged"))
    j = cases.join(overall, "algorithm", "left")
    efficiency = F.when(F.col("judged") > 0, F.round(F.col("overall") * F.col("cases") / F.col("judged"), 6)).otherwise(F.lit(0.0))
    rank = F.rank().over(Window.orderBy(F.col("overall").desc_nulls_last()))  # a row an algorithm
    return j.select("algorithm", "cases", "successful", F.round(F.col("successful") / F.col("cases"), 6).alias("success_rate"), F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("spread", F.lit(0.0)).alias("spread"), efficiency.alias("efficiency"), rank.alias("rank"))


def content_comparison(answers: DataFrame) -> DataFrame:
    """(query_id, algorithm, n_sentences, n_unique, best_coverage, total_unique) of answers (query_id, algorithm, gathered): unique sentences are of no other algorithm's answer."""
    e = answers.select("query_id", "algorithm", F.explode("gathered").alias("s")).distinct()
    by = e.groupBy("query_id", "s").agg(F.count(F.lit(1)).alias("n"), F.min("algorithm").alias("one"))
    unique = by.filter("n = 1").groupBy("query_id", F.col("one").alias("algorithm")).agg(F.count(F.lit(1)).alias("n_unique"))
    total = by.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_unique"))
    n = F.size("gathered")
    most = answers.groupBy("query_id").agg(F.max(n).alias("most"))
    j = answers.select("query_id", "algorithm", n.alias("n_sentences")).join(unique, ["query_id", "algorithm"], "left").join(total, "query_id", "left").join(most, "query_id")
    return j.select("query_id", "algorithm", "n_sentences", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), (F.col("n_sentences") == F.col("most")).alias("best_coverage"), F.coalesce("total_unique", F.lit(0)).alias("total_unique"))


def retrieval_percentage(overlaps: DataFrame) -> DataFrame:
    """(n_found, n_possible, percentage) over all rows of :func:`overlap`; 0 where nothing is possible."""
    t = overlaps.agg(F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("n_truth"), F.lit(0)).alias("n_possible"))
    return t.withColumn("percentage", F.when(F.col("n_possible") > 0, F.round(100.0 * F.col("n_found") / F.col("n_possible"), 6)).otherwise(F.lit(0.0)))


# --- goldens ------------------------------------------------------------------------------------------------------------

# The kinds of evolution a golden can go through.
EVOLUTIONS = ("REASONING", "MULTICONTEXT", "CONCRETIZING", "CONSTRAINED", "COMPARATIVE", "HYPOTHETICAL", "IN_BREADTH")


def group_count(n_chunks: int, goldens: int, per_context: int) -> int:
    """How many context groups a dataset of ``goldens`` needs, no more than there are chunks."""
    return max(0, min(n_chunks, math.ceil(goldens / max(1, per_context))))


def evolution_weights(distribution: dict[str, float] | None = None, kinds: list[str] | None = None) -> dict[str, float]:
    """The weights of evolutions: the known ones of ``distribution``, else equal ones of the known ``kinds``, else reasoning alone."""
    known = {k.upper(): w for k, w in (distribution or {}).items() if k.upper() in EVOLUTIONS and w > 0}
    if not known:
        known = {k.upper(): 1.0 for k in kinds or [] if k.upper() in EVOLUTIONS}
    if not known:
        return {"REASONING": 1.0}
    total = sum(known.values())
    return {k: w / total for k, w in known.items()}


def sampled_contexts(contexts: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` contexts (group_id, ...) in seeded order, with their place from 0 in ``context_index``. The sample is the operator's purpose."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "group_id"))
    taken = contexts.withColumn("h", order).orderBy("h", "group_id").limit(count)
    return taken.withColumn("context_index", F.row_number().over(Window.orderBy("h", "group_id")) - 1).drop("h")  # as many rows as were asked for


def with_context_metadata(goldens: DataFrame, contexts: DataFrame) -> DataFrame:
    """Goldens (id, context_index, ...) with the strategy of their context (context_index, strategy): 'unknown' without an index, 'index_error' where no context has it."""
    c = contexts.select("context_index", F.coalesce("strategy", F.lit("unknown")).alias("grouping_method"), F.lit(True).alias("there"))
    j = goldens.join(c, "context_index", "left")
    return j.withColumn("grouping_method", F.when(F.col("context_index").isNull(), "unknown").when(F.col("there").isNull(), "index_error").otherwise(F.col("grouping_method"))).drop("there")


def golden_metadata(goldens: DataFrame) -> DataFrame:
    """(id, evolution, quality): what a golden's additionalMetadata says; text that is no JSON says nothing."""
    m = F.from_json("additionalMetadata", "evolutions array<string>, synthetic_input_quality double")
    return goldens.filter("id IS NOT NULL").select("id", m.alias("m")).select("id", F.explode_outer("m.evolutions").alias("evolution"), F.col("m.synthetic_input_quality").alias("quality")).distinct()


def evolution_statistics(goldens: DataFrame) -> DataFrame:
    return golden_metadata(goldens).filter("evolution IS NOT NULL").groupBy("evolution").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("avg_quality"))


def flat_context(context: Column) -> Column:
    """A list as one cell: ' | ' between items, where they hold it ' ; '."""
    return F.array_join(F.transform(context, lambda x: F.replace(x, F.lit(" | "), F.lit(" ; "))), " | ")
