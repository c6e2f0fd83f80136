"""Session-level helpers: table loading, lineage cuts in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hand only when it has at most this many rows (checked by :func:`bounded`).
BROADCAST_ROWS = 20_000

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="passagemesh-zip-")
    _local_dirs.append(folder)
    sc.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a temporary folder is made and
    recorded in the session, so that every later call finds the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="passagemesh-")
    _local_dirs.append(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, label: str = "cut", freed: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    One job writes it, so an expensive last stage runs once (``checkpoint()`` would run it twice). ``freed``: the shuffle files
    of that job are removed when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, "false")
    try:
        if freed:
            spark.conf.set(_FREED, "true")
        df.write.option("compression", "zstd" if freed else spark.conf.get("spark.sql.parquet.compression.codec")).parquet(path)
    finally:
        if freed:
            spark.conf.set(_FREED, before)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)  # tables live as long as the application
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the written tables that ``df``, which nothing reads any more, was read from."""
    sc = df.sparkSession.sparkContext
    for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        if folder.split(":", 1)[-1].lstrip("/").startswith(shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/") + "/"):
            there = sc._jvm.org.apache.hadoop.fs.Path(folder)
            there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` if, counted, it has at most ``rows`` rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@atexit.register
def _clean() -> None:
    for d in _local_dirs:
        shutil.rmtree(d, ignore_errors=True)
