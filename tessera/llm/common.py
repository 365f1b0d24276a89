"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, the same set as [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A cluster names it.  Only where it is unset and Spark runs in this one process, as in tests, is
    a local folder made and named; elsewhere executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *by: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost
    executor costs a reread at most.  The table is left in place, as later plans read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect what it no longer refers to: Spark's cleaner then deletes the shuffle
    files of finished steps from the executors, which else stay until the driver's heap fills up.
    Twice, as the last step's listeners still refer to its plan when it ends."""
    gc.collect()  # Python's references to plans
    jvm = getattr(spark.sparkContext, "_jvm", None)
    for _ in range(2 if jvm is not None else 0):
        jvm.java.lang.System.gc()
        time.sleep(0.5)


def tidy() -> None:
    """Give the memory that this Python worker has freed back to the system, for an idle worker keeps
    it otherwise, beside the workers and the JVM that go on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(text: Column) -> Column:
    """Array of the runs of characters other than ``SPACE``; empty for null or blank text."""
    cut = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(cut) > 0, F.split(cut, SPACE_RE)).otherwise(F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    """How many words a text has, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the session is set to, which follows the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
