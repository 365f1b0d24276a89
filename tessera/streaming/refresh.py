"""Refreshing an index from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.api import Engine


def refresh_from(engine: Engine, changes: DataFrame, checkpoint: str, **trigger):
    """Start a query that applies a stream of files (rel_path, content, size, mtime_ms); a null
    content deletes the file.  Each micro-batch is one refresh of its own files: of several changes
    of a file the latest counts, one without a time before all others; of those with one time a
    deletion counts first, then the largest content.  Points are cleared before they are inserted, only the buckets
    of its files are written, and the store's HEAD
    moves once a batch, so a batch that is repeated after a failure ends in the same state."""

    # Never null, so that a change without a time isn't taken for none.
    latest_first = F.struct(F.coalesce(F.col("mtime_ms").cast("double"), F.lit(float("-inf"))), F.col("content").isNull(), F.coalesce("content", F.lit("")))

    def apply(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("rel_path").agg(F.max_by(F.struct("content", "size", "mtime_ms"), latest_first).alias("f")).select("rel_path", "f.*")
        if latest.isEmpty():
            return
        engine.store.ensure(engine.profile, engine.dimension)
        new = latest.where("content is not null")
        rows = new.select("rel_path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"), F.col("size").cast("long"), F.col("mtime_ms").cast("double"), F.unix_millis(F.current_timestamp()).alias("indexed_at"))
        engine.store.apply(latest.select("rel_path"), engine.points_of(new.select("rel_path", "content")), rows, complete=True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
