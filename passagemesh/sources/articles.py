"""Articles: from topics or raw rows to clean articles with sentences, with a table of what was left out and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemesh.functions import text as T

RAW = "title string, url string, raw_text string"
# Longer names of short topics.
SYNONYMS = {"ml": "machine learning", "ai": "artificial intelligence", "nlp": "natural language processing"}


def alternatives(topic: str, most: int = 5) -> list[str]:
    """Other spellings of a topic to look for: with _ for blanks, without blanks, its words, the other number, and a longer or shorter name."""
    low = topic.lower()
    out = [topic.replace(" ", "_"), topic.replace(" ", ""), *topic.split(), topic[:-1] if topic.endswith("s") else topic + "s"]
    out += [v for k, v in SYNONYMS.items() if low == k] + [k.upper() for k, v in SYNONYMS.items() if low == v]
    return [x for x in dict.fromkeys(out) if x and x != topic][:most]


def fetched(spark: SparkSession, topics: list[str], load: Callable[[str], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """(RAW rows, (topic, error)): what ``load`` gives for each topic, or for its alternatives in turn where it gives nothing; topics that fail are listed, not raised."""
    rows, failed = [], []
    for topic in topics:
        got, why = [], "nothing found"
        for name in [topic, *alternatives(topic)]:
            try:
                got = load(name)
            except Exception as e:  # noqa: BLE001 - a topic's failure is a row
                why = str(e)
            if got:
                break
        rows += [(d.get("title"), d.get("url"), d.get("raw_text")) for d in got]
        if not got:
            failed.append((topic, why[:500]))
    return spark.createDataFrame(rows, RAW), spark.createDataFrame(failed, "topic string, error string")


def processed(raw: DataFrame, least: int = 1000, most: int = 5_000_000, sentences: int = 10) -> tuple[DataFrame, DataFrame]:
    """(articles, left out) of raw rows (title, url, raw_text).

    Texts of ``least`` to ``most`` characters are cleaned and cut into sentences, of which valid ones stay; articles with fewer than ``sentences`` are left out. The second
    table has (title, url, reason) of each row that is left out: 'no text', 'length' or 'sentences'.
    """
    n = F.length("raw_text")
    reason = F.when(F.col("raw_text").isNull(), "no text").when(~n.between(least, most), "length")
    r = raw.select("title", "url", "raw_text", reason.alias("reason"))
    good = F.filter(T.tokenized(F.col("cleaned_text")), T.valid_sentence)
    c = r.withColumn("cleaned_text", F.when(F.col("reason").isNull(), T.clean_text(F.col("raw_text")))).withColumn("sentences", F.transform(good, lambda s: F.trim(s)))
    c = c.withColumn("reason", F.coalesce("reason", F.when(F.size("sentences") < sentences, "sentences")))
    words = F.size(F.filter(F.split(F.trim("cleaned_text"), f"{T.WS}+"), lambda w: w != ""))
    meta = F.struct("title", "url", words.alias("word_count"), F.length("cleaned_text").alias("char_count"), F.size("sentences").alias("sentence_count"), F.md5("raw_text").alias("source_hash"))
    articles = c.filter("reason IS NULL").select("title", "url", "raw_text", "cleaned_text", "sentences", meta.alias("metadata"))
    return articles, c.filter("reason IS NOT NULL").select("title", "url", "reason")


def acquired(spark: SparkSession, path: str, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The articles kept at ``path``, or, where there are none or ``fresh`` is asked for, those ``make`` gives, kept there. JSON that cannot be read is left out."""
    from passagemesh.sources.stores import exists

    if fresh or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, (line)): the rows of a JSON-lines file, and the lines that are none."""
    every = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    bad = lines.filter(F.expr("try_parse_json(value)").isNull()).select(F.col("value").alias("line"))
    return every.filter("_bad IS NULL").drop("_bad"), bad

