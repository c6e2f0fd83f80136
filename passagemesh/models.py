"""Models as plug-ins: embedders, answerers and judges run in the workers over Arrow batches, with deterministic stand-ins.

A model is a function of a list of texts; it is built once in each Python worker from a factory, where it is costly to build.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

Answerer = Callable[[list[str]], list["str | None"]]

#: Providers a model may come from.
PROVIDERS = ("ollama", "openai", "openrouter", "anthropic", "local")
# What embedders of a family put before each text; keys under which a reply may hold its answer, in order of preference.
PREFIXES = {"mxbai-embed": "Represent this sentence for searching relevant passages: "}
ANSWER_KEYS = ("rewritten_input", "input", "question", "expected_output", "comparison", "reasoning", "breadth", "multicontext")


@dataclass(frozen=True)
class ModelConfig:
    """Which model to use; wrong values raise ValueError."""

    provider: str = "local"
    model_name: str = "hashing"
    temperature: float = 0.0
    max_tokens: int = 1000
    base_url: str | None = None

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}; known are {', '.join(PROVIDERS)}")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature is from 0 to 2")
        if self.max_tokens < 1:
            raise ValueError("max_tokens is 1 or more")


class HashingEmbedder:
    """A deterministic embedder: signed hashed words and their pairs, at unit length. Texts without words are zero."""

    def __init__(self, dims: int = 64, name: str = "hashing") -> None:
        self.dims, self.name = dims, name
        self.prefix = next((p for k, p in PREFIXES.items() if k in name), "")

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for r, text in enumerate(texts):
            words = re.findall(r"\w+", (self.prefix + (text or "")).lower()) if text else []
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                out[r, (h >> 1) % self.dims] += 1 if h & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embedded(texts: DataFrame, column: str, make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEmbedder, into: str = "embedding", batch: int = 32) -> DataFrame:
    """``texts`` with the vectors of ``column`` in ``into``; null texts have none. ``make`` builds the embedder, once in a task; ``batch`` texts are given to it at a time."""
    schema = S.StructType([*texts.schema.fields, S.StructField(into, S.ArrayType(S.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for b in batches:
            values = b.column(column).to_pylist()
            there = [i for i, t in enumerate(values) if t is not None]
            vectors: list[list[float] | None] = [None] * len(values)
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, v in zip(part, embed([values[i] for i in part])):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, into])

    return texts.mapInArrow(run, schema)


def embedded_by_all(texts: DataFrame, column: str, makers: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]]) -> DataFrame:
    """``texts`` once for each embedder, its name in ``model``."""
    out = None
    for name, make in makers.items():
        got = embedded(texts, column, make).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no embedder is given")
    return out


def answered(rows: DataFrame, prompt: str, into: str, model: Answerer, attempts: int = 3, batch: int = 10, wait: float = 0.0) -> DataFrame:
    """``rows`` with the model's answers to ``prompt`` in ``into``. A batch that fails is tried again, waiting twice as long each time; after the last attempt its answers are null. Null prompts are not asked."""
    schema = S.StructType([*rows.schema.fields, S.StructField(into, S.StringType())])

    def ask(texts: list[str]) -> list[str | None]:
        for k in range(attempts):
            try:
                got = list(model(texts))
                if len(got) == len(texts):
                    return got
            except Exception:  # noqa: BLE001 - whatever a model raises is a failed attempt
                pass
            time.sleep(wait * 2**k)
        return [None] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(prompt).to_pylist()
            there = [i for i, t in enumerate(values) if t is not None]
            replies: list[str | None] = [None] * len(values)
            for at in range(0, len(there), batch):
                part = there[at : at + batch]
                for i, r in zip(part, ask([values[i] for i in part])):
                    replies[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, schema)


def unfenced(reply: str) -> str:
    """A reply without the fences of a code block around it."""
    m = re.search(r"```(?:\w+)?\s*(.*?)```", reply, re.S)
    return (m.group(1) if m else reply).strip()


def cleaned_reply(reply: str | None, most: int = 500) -> str:
    """The answer in a model's reply: of a JSON object the first of ANSWER_KEYS, else its only value; else the text itself. Pages of HTML give ''. At most ``most`` characters."""
    text = unfenced(reply or "")
    if re.match(r"(?i)\s*<(!doctype|html)", text):
        return ""
    try:
        got = json.loads(text)
    except ValueError:
        got = None
    if isinstance(got, dict):
        found = next((got[k] for k in ANSWER_KEYS if isinstance(got.get(k), str)), None)
        if found is None and len(got) == 1:
            found = str(next(iter(got.values())))
        text = found if found is not None else text
    return text[:most]


def chosen(reply: str | None, n: int) -> int | None:
    """What a guided walk's model chose: a number from 1 to ``n``, 0 to stop, None where the reply says neither."""
    text = unfenced(reply or "")
    try:
        value = json.loads(text)
        value = value.get("choice") if isinstance(value, dict) else value
    except ValueError:
        value = text
    if isinstance(value, str) and value.strip().strip('"').lower() == "stop":
        return 0
    try:
        k = int(value)
    except (TypeError, ValueError):
        return None
    return k if 1 <= k <= n else None


def answers(cases: DataFrame, model: Answerer | None = None, most: int = 500) -> DataFrame:
    """``cases`` (question, context array) with ``answer``: the model's, or without one, and where it fails, the first ``most`` characters of the context."""
    joined = F.array_join("context", "\n")
    c = cases.withColumn("prompt", F.concat(F.lit("Answer from the context alone.\nContext:\n"), joined, F.lit("\nQuestion: "), F.col("question")))
    c = answered(c, "prompt", "reply", model) if model else c.withColumn("reply", F.lit(None).cast("string"))
    return c.withColumn("answer", F.coalesce("reply", F.substring(joined, 1, most))).drop("prompt", "reply")


def judged(cases: DataFrame, metrics: dict[str, Callable]) -> DataFrame:
    """(algorithm, case_id, metric, score) of ``cases`` by each metric, a function of the frame's columns to a column from 0 to 1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), f().cast("double").alias("score")) for name, f in metrics.items()]))
    return cases.select("algorithm", "case_id", pairs.alias("m")).select("algorithm", "case_id", "m.metric", "m.score")
