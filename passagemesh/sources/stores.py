"""Tables kept between runs, each in a folder of its own with a manifest of what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _fs(spark, path)
    return fs.exists(there)


def content_hash(df: DataFrame) -> str:
    """A hash of all rows, whatever their order: equal tables have equal ones."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(f"{r['n']}:{r['x']}:{r['s']}".encode()).hexdigest()


def made_from(config: dict, *inputs: DataFrame) -> str:
    """A hash of a configuration and of all rows of the inputs."""
    return hashlib.md5(json.dumps([json.dumps(config, sort_keys=True, default=str), *map(content_hash, inputs)]).encode()).hexdigest()


def save(tables: dict[str, DataFrame], path: str, origin: str = "", partitions: dict[str, list[str]] | None = None) -> None:
    """Writes each table below ``path``, by ``partitions`` where given, and last the manifest, so that a folder with one is whole."""
    spark = next(iter(tables.values())).sparkSession
    fs, there = _fs(spark, f"{path}/{MANIFEST}")
    fs.delete(there, False)
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partitions and name in partitions:
            w = w.partitionBy(*partitions[name])
        w.parquet(f"{path}/{name}")
    out = fs.create(there, True)
    out.write(bytearray(json.dumps({"origin": origin, "tables": {n: d.schema.simpleString() for n, d in tables.items()}}).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest at ``path``, None where there is none or it cannot be read."""
    fs, there = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(there):
        return None
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))  # one small file
    except ValueError:
        return None


def load(spark: SparkSession, path: str, origin: str | None = None) -> dict[str, DataFrame] | None:
    """The tables at ``path``, or None where there are none, or none of that ``origin``."""
    m = manifest(spark, path)
    if m is None or origin is not None and m["origin"] != origin:
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in m["tables"]}


def cached(spark: SparkSession, path: str, origin: str, make, fresh: bool = False) -> dict[str, DataFrame]:
    """The tables kept at ``path`` if they are of ``origin``, else those ``make`` gives, kept there."""
    got = None if fresh else load(spark, path, origin)
    if got is None:
        save(make(), path, origin)
        got = load(spark, path)
    return got
