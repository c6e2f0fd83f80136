"""Golden question-answer sets: scans and sinks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "id string, input string, actualOutput string, expectedOutput string, context string, retrievalContext string, expectedTools string, toolsCalled string, sourceFile string, additionalMetadata string, comments string"


class GoldenSource(Protocol):
    """Where goldens come from or go to: a service, or the files below."""

    def pull(self, spark: SparkSession, alias: str) -> DataFrame: ...

    def push(self, goldens: DataFrame, alias: str) -> None: ...


class Files:
    """Goldens as CSV files below a folder, one folder an alias."""

    def __init__(self, path: str) -> None:
        self.path = path

    def pull(self, spark: SparkSession, alias: str) -> DataFrame:
        return read_csv(spark, f"{self.path}/{alias}")

    def push(self, goldens: DataFrame, alias: str) -> None:
        write_csv(goldens, f"{self.path}/{alias}")


def pulled(spark: SparkSession, alias: str, *sources: GoldenSource) -> DataFrame:
    """The goldens of the first source that has them; the last one's error is raised."""
    for k, s in enumerate(sources):
        try:
            return s.pull(spark, alias)
        except Exception:  # noqa: BLE001 - the next source is asked
            if k == len(sources) - 1:
                raise
    raise ValueError("no source is given")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Goldens of a CSV file with a header; fields may hold line breaks and doubled quotes."""
    return spark.read.schema(COLUMNS).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(goldens: DataFrame, path: str) -> None:
    """Every field in quotes, quotes doubled; null fields are empty."""
    goldens.write.mode("overwrite").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)


def passages(context: Column) -> Column:
    """The passages of a context: of a JSON array, else of items joined by ' | '. Null gives null."""
    listed = F.from_json(context, "array<string>", {"allowSingleQuotes": "false"})
    return F.when(context.isNotNull(), F.coalesce(listed, F.split(context, " \\| ")))


def flat(items: Column) -> Column:
    """A list as one cell: ' | ' between items, where they hold it ' ; '; null items are left out."""
    return F.array_join(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.replace(x, F.lit(" | "), F.lit(" ; "))), " | ")


def exported(goldens: DataFrame) -> DataFrame:
    """The five columns of an upload file, from (input, expected_output, actual_output, context array, retrieval_context array); null becomes ''."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return goldens.select(text("input"), text("expected_output"), text("actual_output"), F.coalesce(flat(F.col("context")), F.lit("")).alias("context"), F.coalesce(flat(F.col("retrieval_context")), F.lit("")).alias("retrieval_context"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Goldens of a JSON file, an array or one object."""
    schema = "input string, expected_output string, actual_output string, context array<string>, retrieval_context array<string>, grouping_method string, evolutions array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Goldens, results or a comparison as JSON lines."""
    df.write.mode("overwrite").json(path)


def from_group(question: Column, sentences: Column) -> list[Column]:
    """The fields of a golden made of a context group: its sentences joined are the expected output."""
    return [question.alias("input"), F.array_join(sentences, " ").alias("expected_output"), F.lit(None).cast("string").alias("actual_output"), sentences.alias("context"), F.array().cast("array<string>").alias("retrieval_context")]
