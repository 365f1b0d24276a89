"""Keep the chunks of an index in step with a table of files that grows.

    spark-submit --py-files tessera.zip jobs/refresh_chunks.py --config jobs/refresh_chunks.json \\
        --input <folder of Parquet files> --output <folder> --checkpoint <folder>

The input has documents (doc_id, text, lang, source) in Parquet files, to which files are added.  A
file stream with a checkpoint takes each file once; of its rows those count whose text differs from
what the output has.  Of several rows of a path in one batch the one of the newest file counts, of
those the one with the largest hash.  A null text deletes the path's chunks.  Rows without an id are
counted and left out, as they name no file; a null source or lang is "_" in the path.

Output: `chunks`, partitioned by batch and source, and `manifest`, partitioned by batch, which has
each path's hash and is written after the chunks.  A batch is written by dynamic overwrite of its own
partitions, from what the batches before it left, so one that is repeated after a failure ends the
same, and a run with nothing new writes nothing.  `current` reads each path's newest chunks.
Output and checkpoint belong together: begin both anew, or neither.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from typing import NamedTuple

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunk

log = logging.getLogger("refresh_chunks")

DOCUMENTS = "doc_id long, text string, lang string, source string"
CHUNKS = "rel_path string, ordinal int, start_line int, end_line int, type string, content string, length int, segment_hash string, batch_id long, source string"
MANIFEST = "rel_path string, hash string, source string, batch_id long"
DEFAULTS = {"max_files_per_trigger": 1000, "files_per_source": 8}


class Batch(NamedTuple):
    """What one batch read and wrote."""

    batch_id: int
    rows: int
    without_id: int
    changed: int
    deleted: int
    chunks: int


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that was written before, or none of its rows if nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest(manifest: DataFrame) -> DataFrame:
    """The manifest's last row of each path."""
    return manifest.groupBy("rel_path").agg(F.max_by(F.struct("hash", "batch_id"), "batch_id").alias("m")).select("rel_path", "m.*")


def rel_path() -> Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def apply(batch: DataFrame, batch_id: int, output: str, spread: int) -> Batch:
    """Write the chunks of what is new in ``batch``, then its rows of the manifest."""
    spark, seen, made = batch.sparkSession, Observation(), Observation()
    if batch.isEmpty():
        return Batch(batch_id, 0, 0, 0, 0, 0)
    rows = batch.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"))
    told = rows.where("doc_id is not null").select(rel_path().alias("rel_path"), "source", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), "changed_at")
    last = told.groupBy("rel_path").agg(F.max_by(F.struct("source", "text", "hash"), F.struct("changed_at", F.coalesce("hash", F.lit("")))).alias("f")).select("rel_path", "f.*")
    marks = table(spark, f"{output}/manifest", MANIFEST) if batch_id else spark.createDataFrame([], MANIFEST)
    known = newest(marks.where(F.col("batch_id") < batch_id)).select("rel_path", F.col("hash").alias("known"))
    changed = last.join(known, "rel_path", "left").where(~F.col("hash").eqNullSafe(F.col("known"))).drop("known").persist()
    try:
        # The one evaluation of the batch; nothing is written where nothing has changed.
        n, deleted = changed.agg(F.count("*"), F.count_if(F.col("hash").isNull())).first()
        read = seen.get
        if not n:
            return Batch(batch_id, read["rows"], read["without_id"], 0, 0, 0)
        chunks = chunk.chunk_files(changed.select("rel_path", F.col("text").alias("content"))).withColumnRenamed("file_path", "rel_path")
        chunks = chunks.join(changed.select("rel_path", "source"), "rel_path").withColumn("batch_id", F.lit(batch_id).cast("long"))
        chunks = chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))).observe(made, F.count("*").alias("chunks"))
        # A source may have most rows, so its files are dealt over several tasks.
        dealt = chunks.repartition("source", F.pmod(F.xxhash64("rel_path"), F.lit(spread))).sortWithinPartitions("source", "rel_path", "ordinal")
        _write(dealt, f"{output}/chunks", "batch_id", "source")
        mark = changed.select("rel_path", "hash", "source", F.lit(batch_id).cast("long").alias("batch_id"))
        _write(mark, f"{output}/manifest", "batch_id")
    finally:
        changed.unpersist()
    return Batch(batch_id, read["rows"], read["without_id"], n, deleted, made.get["chunks"])


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks as they stand: of each path those of its newest batch, none if that deleted it."""
    marks = newest(table(spark, f"{output}/manifest", MANIFEST)).where("hash is not null")
    return table(spark, f"{output}/chunks", CHUNKS).join(marks.select("rel_path", "batch_id", F.col("hash").alias("file_hash")), ["rel_path", "batch_id"])


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> list[Batch]:
    """Take what is new in ``source``, and wait until it is written."""
    settings = DEFAULTS | (config or {})
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings["max_files_per_trigger"]).parquet(source)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("changed_at"))
    done: list[Batch] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        done.append(apply(batch, batch_id, output, settings["files_per_source"]))
        log.info("batch %s of %s: %s rows read, %s without an id, %s changed, %s of them deleted; %s chunks written to %s", *done[-1][:1], source, *done[-1][1:], output)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%s batches, %s rows read from %s", len(done), sum(b.rows for b in done), source)
    return done


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("refresh_chunks").getOrCreate()
    try:
        # The configuration is read through Spark too, as its path may be remote.
        config = json.loads(spark.read.text(given.config, wholetext=True).first()[0])
        run(spark, given.input, given.output, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
