"""A mix of sources in target shares of tokens, by capped water-filling (problem 9).

Shares are first divided among the sources that have documents. With a total given, sources whose share needs
more than their most repetitions are clamped there, and what they lack is divided among the others in
proportion to their shares, until nothing exceeds its cap. A source's allotment is a whole number of passes over all of its documents
and a seeded sample for the fraction: a document is in the sample when its hash is below the source's threshold, which
two histograms of hash slices, summed over all documents, place to one part in 2**24.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.llm import tokens
from passagemesh.runtime import materialize

#: Slices of each of the two histograms; the most sources a mix may list (their rows go to the driver).
SLICES, MOST_SOURCES = 4096, 100_000


#: The total that is all tokens of the listed sources' documents: small sources cannot fill their share of it.
CORPUS = "corpus"


def filled(text: Column) -> Column:
    """Whether a text has a character that is neither blank, in any script, nor invisible. Null for null."""
    return text.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]")


def fill(targets: dict[str, tuple[float, int, int]], total: float | None = None) -> tuple[float, dict[str, float]]:
    """(total, tokens by source) for {source: (share, most repetitions, tokens there)}.

    Without ``total``: the largest total at which every source with documents gets its full share.
    """
    can = {s: cap * n for s, (w, cap, n) in targets.items() if w > 0 and cap > 0 and n > 0}
    weight = sum(targets[s][0] for s in can)
    if not can:
        return 0.0, {s: 0.0 for s in targets}
    if total is None:
        total = min(can[s] * weight / targets[s][0] for s in can)
    total = min(total, sum(can.values()))
    got = {s: 0.0 for s in targets}
    free, left = set(can), total
    while free:
        w = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / w > can[s] * (1 + 1e-12)}
        if not over:
            got |= {s: left * targets[s][0] / w for s in free}
            break
        for s in over:
            got[s] = float(can[s])
            left -= can[s]
        free -= over
    return total, got


def _sized(documents: DataFrame, targets: DataFrame, seed: int, path: str) -> tuple[DataFrame, dict[str, tuple[float, int, int]]]:
    """The documents with text and a target, with n_tokens and hash slices; and per target (share, cap, tokens)."""
    listed = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("cap"))
    rows = listed.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    docs = documents.filter(F.col("source").isNotNull() & filled(F.col("text"))).select("doc_id", "source", "text")
    docs = docs.join(F.broadcast(listed.select("source")), "source", "left_semi")  # bounded just now
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = tokens.encode(docs, path=path, counts=True).select("doc_id", "source", "n_tokens", F.pmod(h, F.lit(SLICES)).alias("s1"), F.pmod(F.shiftright(h, 20), F.lit(SLICES)).alias("s2"))
    sized = materialize(sized, "sized")
    sums = dict(sized.groupBy("source").agg(F.sum("n_tokens")).collect())
    return sized, {r.source: (float(r.w or 0), int(r.cap or 0), int(sums.get(r.source) or 0)) for r in rows}


def _slice_below(part: DataFrame, slice_: str, need: DataFrame) -> DataFrame:
    """Per source the slice in which the running sum passes ``need``, the sum before it, and whether the sum after it is nearer. At most SLICES rows a source."""
    hist = part.groupBy("source", slice_).agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy(slice_)
    run = hist.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(need), "source")
    found = run.filter(F.col("upto") > F.col("need")).groupBy("source").agg(F.min(F.struct(F.col(slice_).alias("at"), "upto", "n", "need")).alias("f"))
    over, under = F.col("f.upto") - F.col("f.need"), F.col("f.need") - F.col("f.upto") + F.col("f.n")
    return found.select("source", F.col("f.at").alias(f"at_{slice_}"), (F.col("f.upto") - F.col("f.n")).alias("before"), (over < under).alias("nearer_after"))


def plan(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 9, path: str = f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}") -> tuple[DataFrame, DataFrame]:
    """(mix, report): see :func:`mix` and :func:`report`."""
    spark = documents.sparkSession
    sized, known = _sized(documents, targets, seed, path)
    if total == CORPUS:
        total = float(sum(n for w, cap, n in known.values() if w > 0 and cap > 0))
    total, got = fill(known, total)
    rows = []
    for s, (w, cap, n) in known.items():
        passes = int(got[s] // n) if n else 0
        rows.append((s, w, cap, n, float(got[s]), passes, float(got[s] - passes * n)))
    sources = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, allotted double, passes int, need double")
    need = sources.filter("passes < max_repeats").select("source", "need")
    first = _slice_below(sized, "s1", need)
    inside = sized.join(F.broadcast(first.select("source", "at_s1")), "source").filter("s1 = at_s1")
    second = _slice_below(inside, "s2", first.join(need, "source").select("source", (F.col("need") - F.col("before")).alias("need"))).select("source", (F.col("at_s2") + F.col("nearer_after").cast("int")).alias("at_s2"))
    cuts = sources.select("source", "passes").join(first.select("source", "at_s1"), "source", "left").join(second, "source", "left")
    cuts = materialize(cuts, "cuts")  # a row a source
    below = F.coalesce((F.col("s1") < F.col("at_s1")) | ((F.col("s1") == F.col("at_s1")) & (F.col("s2") < F.coalesce("at_s2", F.lit(0)))), F.lit(False))
    drawn = sized.join(F.broadcast(cuts), "source").withColumn("repeats", F.col("passes") + below.cast("int"))
    out = drawn.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    sums = out.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("repeats").alias("n_uses"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"))
    whole = sums.agg(F.sum("used").alias("all"))
    rep = sources.join(sums, "source", "left").join(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    rep = rep.select(
        "source", "target_share", (F.col("allotted") / F.lit(max(total, 1.0))).alias("planned_share"), F.when(F.col("all") > 0, zero("used") / F.col("all")).otherwise(F.lit(0.0)).alias("actual_share"),
        "available", "allotted", ((F.col("available") > 0) & (F.col("allotted") >= F.col("available") * F.col("max_repeats"))).alias("clamped"), zero("used").alias("tokens"), zero("n_docs").alias("n_docs"), zero("n_uses").alias("n_uses"), zero("most").alias("most_repeats"), "max_repeats",
    )
    return out, rep


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 9, path: str = f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}") -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each drawn document is used.

    Without ``total`` (in tokens) the mix is the largest in which every source that has documents has its target share; with
    one (or CORPUS, all tokens there are), sources that cannot fill their share are clamped at max_repeats and the rest share what is lacking. Documents
    without text (null, empty, or only blanks and invisible characters), source or target stay out; targets without documents get nothing, and their share goes to the others.
    Repeated rows of one source add up to one target; the smallest max_repeats holds.
    """
    return plan(documents, targets, total, seed, path)[0]


def report(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 9, path: str = f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}") -> DataFrame:
    """Per listed source target, planned and actual share of the mix's tokens, whether it is clamped at its most repetitions, and what was used."""
    return plan(documents, targets, total, seed, path)[1]
