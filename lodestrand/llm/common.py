"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the word-based operators ends at these bytes (space, tab, line ends).
WORD_BREAKS = rb" \t\n\x0b\x0c\r"
#: The same as a Java pattern.
WORD_BREAK_PATTERN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's; a new local one if none is set and all of Spark is on
    this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a second run of the Python code above,
    and what is not deterministic above (row keys, range borders) is fixed from here on.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lodestrand-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_to = at
    for held in _scratch:
        held.append(out)
    return out


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, which nothing may read any more."""
    for df in tables:
        delete(df.sparkSession, folder_of(df))


def folder_of(df: DataFrame) -> str:
    """Where ``materialize`` wrote ``df``."""
    return df.written_to.rsplit("/", 1)[0]


_scratch: list[list[DataFrame]] = []


@contextmanager
def recorded():
    """A list of all tables that are materialized within."""
    held: list[DataFrame] = []
    _scratch.append(held)
    try:
        yield held
    finally:
        _scratch.remove(held)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of finished jobs, which it deletes only after the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Arrow batches of few rows, since one text may have megabytes. The session keeps the setting, as plans read it late."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, _UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
