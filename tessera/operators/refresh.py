"""Incremental maintenance: manifests, diffs, deletes, inserts, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most files of an automatic refresh; sizes and times of a seeded manifest row.
AUTO_REFRESH_FILES, SEEDED_SIZE, SEEDED_MTIME = 200, -1, 0.0


def diff(manifest: DataFrame | None, files: DataFrame) -> DataFrame:
    """(rel_path, state) of every path: added, maybe_stale, unchanged or deleted.  Equal size and
    time mean unchanged.  Without a manifest all files are added."""
    if manifest is None:
        return files.select("rel_path", F.lit("added").alias("state"))
    old = manifest.select("rel_path", F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime"), F.lit(True).alias("known"))
    new = files.select("rel_path", "size", "mtime_ms", F.lit(True).alias("found"))
    state = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("found").isNull(), "deleted")
        .when((F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime")), "unchanged")
        .otherwise("maybe_stale")
    )
    return old.join(new, "rel_path", "full_outer").select("rel_path", state.alias("state"))


def guarded(states: DataFrame, truncated: bool) -> DataFrame:
    """A truncated scan proves no file gone: nothing counts as deleted then."""
    return states.where("state <> 'deleted'") if truncated else states


def confirm_stale(states: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, state) of the maybe stale files, whose contents alone are hashed: changed or unchanged.
    Files that can't be read (null content) are left out."""
    stale = states.where("state = 'maybe_stale'").select("rel_path")
    now = files.join(stale, "rel_path", "left_semi").where("content is not null").select("rel_path", F.sha2(F.encode("content", "UTF-8"), 256).alias("now"))
    return now.join(manifest.select("rel_path", "hash"), "rel_path").select("rel_path", F.when(F.col("now") == F.col("hash"), "unchanged").otherwise("changed").alias("state"))


def clear_and_insert(points: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """``points`` without those of ``changed`` (rel_path) files, and with the ``new`` ones."""
    gone = changed.select(F.col("rel_path").alias("file_path")).distinct()
    return points.join(gone, "file_path", "left_anti").unionByName(new)


def finished_files(chunks: DataFrame, accepted: DataFrame) -> DataFrame:
    """(file_path, n_chunks, n_accepted, done): a file is recorded once all its chunks are stored."""
    ok = accepted.select("file_path", "id", F.lit(1).alias("ok"))
    return (
        chunks.join(ok, ["file_path", "id"], "left")
        .groupBy("file_path")
        .agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_accepted"))
        .withColumn("done", F.col("n_chunks") == F.col("n_accepted"))
    )


def importable(points: DataFrame, dim: int) -> DataFrame:
    """Points of another index that can be copied: a vector of the right size and the fields that
    search needs."""
    fields = [F.col(c).isNotNull() for c in ("file_path", "code_chunk", "start_line", "end_line")]
    keep = (F.size("vector") == dim) & (F.col("file_path") != "")
    for f in fields:
        keep = keep & f
    return points.where(keep)


def path_hashes(points: DataFrame) -> DataFrame:
    """(file_path, file_hash): of each path the hash of the point with the largest id."""
    return points.where("file_hash is not null").groupBy("file_path").agg(F.max_by("file_hash", "id").alias("file_hash"))


def seeded_manifest(hashes: DataFrame, now_ms: int) -> DataFrame:
    """Manifest rows of copied files, which the next diff calls maybe stale and confirms by hash."""
    return hashes.select(F.col("file_path").alias("rel_path"), F.col("file_hash").alias("hash"), F.lit(SEEDED_SIZE).cast("long").alias("size"), F.lit(SEEDED_MTIME).alias("mtime_ms"), F.lit(now_ms).cast("long").alias("indexed_at"))


def freshness(states: DataFrame) -> DataFrame:
    """Counts of added, maybe stale and deleted files, in one row."""
    counted = [F.count_if(F.col("state") == s).alias(s) for s in ("added", "maybe_stale", "deleted", "unchanged")]
    return states.agg(*counted)


def must_rebuild(metadata: dict, profile: str) -> bool:
    """Whether all files are to be indexed again: the store holds vectors of another profile."""
    return metadata.get("profile") not in (None, profile)


def profile_changed(stored: Column, provider: Column, model: Column, dimension: Column) -> Column:
    """Whether a stored profile (provider, model, dimension) differs from the configured one; a null
    dimension isn't known yet and differs from none, and without a stored profile nothing does."""
    apart = ~stored["provider"].eqNullSafe(provider) | ~stored["model"].eqNullSafe(model)
    return stored.isNotNull() & (apart | F.coalesce(stored["dimension"] != dimension, F.lit(False)))


def probed_dimension(embed, stored: dict | None, provider: str, model: str, known: int | None = None) -> int:
    """The dimension of a model: the catalog's, else that of a store of the same provider and model,
    else that of one text's vector."""
    if known:
        return known
    if stored and (stored.get("provider"), stored.get("model")) == (provider, model) and stored.get("dimension"):
        return int(stored["dimension"])
    return len(embed(["dimension"])[0])


def discovered(found: DataFrame, profiles: DataFrame, profile: str) -> DataFrame:
    """(kind, name, compatible, problem): sources of points (kind, name) that can be imported.  One
    without a profile in ``profiles`` (name, profile, problem) counts as compatible; one that
    can't be read is told with its problem, not raised."""
    told = found.join(profiles, "name", "left")
    fits = F.col("problem").isNull() & (F.col("profile").isNull() | (F.col("profile") == profile))
    return told.select("kind", "name", fits.alias("compatible"), "problem")


def auto_refresh(states: DataFrame, most: int = AUTO_REFRESH_FILES) -> bool:
    """Whether few enough files changed to refresh without being asked: some, but not over ``most``."""
    n = states.where("state <> 'unchanged'").limit(most + 1).count()
    return 0 < n <= most
