"""Exact dedup by snapshots: static binary-fuse filters screen what comes in."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored

#: Distinct digests that one filter holds, on average: 2 MB or so of memory while it is built.
FILTER_KEYS = 1 << 17
#: Snapshots that op3 and the pipeline deal a table to; see dedup().
BATCHES = 2


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class FuseFilter:
    """A static filter of 8-bit fingerprints: a key's three slots, in neighbouring segments, xor to
    its fingerprint.  No key that was put in is missed; of others, 1 in 256 passes."""

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        starts = np.uint64(size // segment - 2)
        first = ((h >> np.uint64(32)) * starts) >> np.uint64(32)
        spread = _mix(h, 0x51)
        mask = np.uint64(segment - 1)
        at = np.stack([((first + np.uint64(k)) * np.uint64(segment) + ((spread >> np.uint64(20 * k)) & mask)).astype(np.int64) for k in range(3)], 1)
        return at, (h & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """From distinct 64-bit keys.  Slots that one key alone uses are taken off in rounds, all of
        a round at once, and filled in the reverse order.  Tries other seeds until all keys go."""
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 1.25), 2, 18))
        for seed in range(1, 200):
            room = int(n * (1.15 + 0.02 * (seed // 4)) + 2 * segment)
            size = (max(room // segment + 1, 3)) * segment
            at, prints = cls.places(keys, seed, segment, size)
            uses = np.bincount(at.ravel(), minlength=size)
            sums = np.zeros(size, np.int64)  # xor of the numbers of the keys that use a slot
            for k in range(3):
                np.bitwise_xor.at(sums, at[:, k], np.arange(n))
            rounds, left, lone = [], n, np.flatnonzero(uses == 1)
            while len(lone):
                taken, first = np.unique(sums[lone], return_index=True)
                rounds.append((taken, lone[first]))
                left -= len(taken)
                for k in range(3):
                    np.subtract.at(uses, at[taken, k], 1)
                    np.bitwise_xor.at(sums, at[taken, k], taken)
                near = np.unique(at[taken].ravel())
                lone = near[uses[near] == 1]
            if not left:
                slots = np.zeros(size, np.uint8)
                for taken, pivot in reversed(rounds):
                    slots[pivot] = 0
                    a = at[taken]
                    slots[pivot] = prints[taken] ^ slots[a[:, 0]] ^ slots[a[:, 1]] ^ slots[a[:, 2]]
                return cls(seed, segment, slots)
        raise RuntimeError("no filter found; the keys must be distinct")

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key]).astype(np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.places(keys, self.seed, self.segment, len(self.slots))
        return (self.slots[at[:, 0]] ^ self.slots[at[:, 1]] ^ self.slots[at[:, 2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment], "<u4").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment = np.frombuffer(data, "<u4", 2)
        return cls(int(seed), int(segment), np.frombuffer(data, np.uint8, offset=8))


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, in lowercase hex; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _key() -> Column:
    """64 bits of a digest, for filters."""
    return F.xxhash64("sha")


def bucket(n_buckets: int) -> Column:
    """The bucket of a digest among ``n_buckets``, a power of two, so that finer buckets are parts of coarser ones."""
    return F.pmod(_key(), F.lit(n_buckets)).cast("int")


def buckets_for(rows: int) -> int:
    """How many buckets hold ``rows`` digests, about FILTER_KEYS or half as many each."""
    return 1 << max(0, -(-rows // FILTER_KEYS) - 1).bit_length()


def build_filters(known: DataFrame, n_buckets: int) -> DataFrame:
    """Filters (bucket, n_buckets, filter) over the distinct digests of a snapshot's exact buckets."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "n_buckets": n_buckets, "filter": [FuseFilter.build(keys).to_bytes()]})

    rows = known.select(bucket(n_buckets).alias("bucket"), _key().alias("key"))
    return rows.groupBy("bucket").applyInPandas(build, "bucket int, n_buckets int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, width: int) -> DataFrame:
    """(sha, ..., snapshot) for each row of ``incoming`` (sha, ...; a digest once) and each snapshot whose
    ``filters`` (snapshot, bucket, n_buckets, filter) let it through.  The snapshots themselves aren't read.

    ``width``, a power of two, is how many buckets the digests are dealt to: no fewer than any snapshot
    has, and enough for ``incoming``.  The filter of a coarser bucket is sent to each of
    its parts, so a task holds its share of the digests and one filter of each snapshot, however
    small a snapshot and large a batch are."""
    columns = incoming.columns

    def passed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left["key_"].to_numpy(np.int64).view(np.uint64)
        found = [left.iloc[:0][columns].assign(snapshot=pd.Series(dtype=object))]
        if len(left):
            for snapshot, data in zip(right["snapshot"], right["filter"]):
                found.append(left.loc[FuseFilter.from_bytes(data).contains(keys), columns].assign(snapshot=snapshot))
        return pd.concat(found[1:] or found)

    rows = incoming.withColumns({"key_": _key(), "part_": bucket(width)})
    parts = filters.select("snapshot", "filter", F.explode(F.sequence("bucket", F.lit(width - 1), "n_buckets")).alias("part_"))
    schema = T.StructType([*incoming.schema.fields, T.StructField("snapshot", T.StringType())])
    return rows.groupBy("part_").cogroup(parts.groupBy("part_")).applyInPandas(passed, schema)


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest of a batch: (sha, best, n).  ``best`` is the row that stays."""
    return rows.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, keep_id, group_size, kept, text_sha256.

    The table is dealt to ``batches`` by a hash of the id.  Each batch is grouped by digest.  The
    first makes a snapshot: exact buckets, and for each bucket a filter.  The digests of a later
    batch are screened by the filters of every snapshot before it; what they let through joins the exact
    buckets, and texts are compared byte by byte.  Digests that are new make the next snapshot.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest
    id stays; of several rows with that id, one of them.  Null ids come before all others.  An
    empty table gives no rows; other columns are ignored.  Groups are counted before they are
    shuffled, so a group of any size is a few rows a task."""
    rows = stored(
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("sha"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(batches)).cast("int").alias("batch")),
        "exact-digests",
    )
    heads, snapshots = [], []
    for b in range(batches):
        batch = grouped(rows.where(F.col("batch") == b))
        joined = None
        if snapshots:
            batch = stored(batch, "exact-batch")
            filters = reduce(DataFrame.unionByName, [f.withColumn("snapshot", F.lit(str(k))) for k, (_, f, _) in enumerate(snapshots)])
            width = max(buckets_for(batch.count()), *(n for _, _, n in snapshots))
            positive = screen(batch.select("sha", F.col("best").alias("new")), filters, width)
            olds = reduce(DataFrame.unionByName, [known.select("sha", F.col("best").alias("old"), F.lit(str(k)).alias("snapshot")) for k, (known, _, _) in enumerate(snapshots)])
            joined = positive.join(olds, ["sha", "snapshot"])
        if joined is not None:
            same = stored(equal_bytes(docs, joined), "exact-same")
            heads.append(batch.join(same.select("sha"), "sha", "left_semi"))
            batch = batch.join(same.select("sha"), "sha", "left_anti")
        known = stored(batch, "exact-buckets")
        heads.append(known)
        if b < batches - 1:
            n_buckets = buckets_for(known.count())
            snapshots.append((known, stored(build_filters(known, n_buckets), "exact-filters"), n_buckets))
    whole = heads[0]
    for more in heads[1:]:
        whole = whole.unionByName(more)
    # Written, so that the join below has plain exchanges on both sides, and a large group is split.
    groups = stored(whole.groupBy("sha").agg(F.max("best").alias("best"), F.sum("n").alias("group_size")), "exact-groups")
    return rows.join(groups, "sha").select(
        "doc_id",
        "row",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def equal_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests (sha) of the ``pairs`` (sha, new, old) whose two documents have the same bytes.  Only
    the texts of these documents are kept of the second reading.  Raises should one digest stand
    for two texts, rather than drop a document over it."""
    wanted = pairs.select(F.col("sha").alias("sha_"), F.explode(F.array("new.doc_id", "old.doc_id")).alias("id_")).distinct()
    texts = docs.select("doc_id", digest(F.col("text")).alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left_semi")
    ends = texts.groupBy("sha").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return ends.where(F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("boolean"))).select("sha")


BUCKETS = "sha string, doc_id long, text string, snapshot string"
FILTERS = "bucket int, n_buckets int, filter binary, snapshot string"


class Snapshots:
    """Immutable snapshots of what was let in, in a folder that driver and executors share, as two Parquet
    tables by snapshot: exact buckets (sha, doc_id, text) and filters.  Filters are written
    last: a snapshot without them doesn't count, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, schema: str, before: str) -> DataFrame:
        """Rows of the snapshots whose names come before ``before``."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.where(F.col("snapshot") < before)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{self.folder}/{name}")

    def admit(self, docs: DataFrame, snapshot: str) -> DataFrame:
        """One row for each row of ``docs``, a new batch: doc_id, row, keep_id, group_size, kept,
        text_sha256; what is kept becomes the snapshot named ``snapshot``.

        Digests are screened by the filters of all snapshots whose names come before this one's, in the
        order of strings; what they let through joins those exact buckets, and texts are
        compared byte by byte.  A text that is there already isn't kept again, whatever its id,
        and keep_id is the earlier document's.  Of equal texts of the batch alone the row with the
        largest id stays, as in dedup(); group_size counts the batch's rows.  A batch that is
        admitted again under its name gives the same rows and tables.

        Null counts as empty text; null ids come before all others.  An empty batch, or one with
        nothing new, adds no snapshot.  Columns other than doc_id and text are ignored."""
        # Written once, so that a row has the same number wherever it is read.
        rows = stored(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("sha"), F.coalesce("text", F.lit("")).alias("text")), "exact-incoming")
        batch = stored(grouped(rows), "exact-batch")
        filters = self.table("filters", FILTERS, snapshot)
        widest = filters.agg(F.max("n_buckets")).first()[0] or 1
        positive = screen(batch.select("sha", F.col("best.row").alias("row")), filters, max(widest, buckets_for(batch.count())))
        known = self.table("buckets", BUCKETS, snapshot).select("sha", "snapshot", F.col("doc_id").alias("old_id"), F.col("text").alias("old"))
        met = positive.join(known, ["sha", "snapshot"]).join(rows.select("row", "text"), "row")
        same = F.when(F.col("old") == F.col("text"), True).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("boolean"))
        there = stored(met.where(same).groupBy("sha").agg(F.max("old_id").alias("old_id")), "exact-same")
        new = batch.join(there, "sha", "left_anti").select("sha", F.col("best.row").alias("row"))
        fresh = rows.join(new.select("row"), "row", "left_semi").select("sha", "doc_id", "text", F.lit(snapshot).alias("snapshot"))
        self._write(fresh, "buckets")
        kept = self.table("buckets", BUCKETS, snapshot + "\0").where(F.col("snapshot") == snapshot)
        if n := kept.count():
            self._write(build_filters(kept, buckets_for(n)).withColumn("snapshot", F.lit(snapshot)), "filters")
        # Written, so that the join below has plain exchanges on both sides, and a large group is split.
        groups = stored(batch.join(there.withColumn("known", F.lit(True)), "sha", "left"), "exact-groups")
        known_before = F.coalesce("known", F.lit(False))
        return rows.drop("text").join(groups, "sha").select(
            "doc_id",
            "row",
            F.when(known_before, F.col("old_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.col("n").alias("group_size"),
            (~known_before & (F.col("row") == F.col("best.row"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
