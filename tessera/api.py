"""The engine's entry points: scan, chunk, embed, build, refresh, import, search, status."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk, embed, refresh, search, syntax
from tessera.sources.store import MANIFEST, POINTS, REQUIRED, Mismatch, Store, projected


class Report(NamedTuple):
    added: int
    changed: int
    unchanged: int
    deleted: int
    points: int
    complete: bool
    notes: tuple[str, ...] = ()


class Engine:
    """One corpus: a store, an embedder and the profile that names its vectors.

    ``embed_column`` makes a vector column from a text column; the default is lexical.  Files are
    chunked by their syntax where ``by_syntax`` has a grammar for them, by lines or sections else."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        profile: str = "local:hashed:64",
        dimension: int = embed.DIM,
        embed_column: Callable[[Column], Column] = embed.hashed_vector,
        by_syntax: Callable[[str, str], list[chunk.Chunk] | None] | None = syntax.by_syntax,
    ):
        self.spark, self.store, self.by_syntax = spark, Store(spark, root), by_syntax
        self.profile, self.dimension, self.embed_column = profile, dimension, embed_column

    def points_of(self, files: DataFrame) -> DataFrame:
        """Points of ``files`` (rel_path, content), one of each chunk.  A chunk whose text has no vector
        is kept with zeros, which have no cosine, so no search finds it."""
        chunks = chunk.chunk_files(files, self.by_syntax)
        rows = chunks.select(
            T.uuid5(F.col("segment_hash")).alias("id"),
            F.coalesce(self.embed_column(F.col("content")), F.array_repeat(F.lit(0.0).cast("float"), self.dimension)).alias("vector"),
            T.slashed(F.col("file_path")).alias("file_path"),
            "file_hash",
            F.col("content").alias("code_chunk"),
            "start_line",
            "end_line",
            "segment_hash",
        )
        return projected(rows, [x.split()[0] for x in POINTS.split(", ")])

    def build(self, files: DataFrame, files_per_commit: int | None = None) -> Report:
        """Index all ``files`` (rel_path, content, size, mtime_ms) anew, and delete what isn't there any
        more.  A store that holds vectors of another profile is dropped and made again."""
        head = self.store.head()
        if head and refresh.must_rebuild(head["metadata"], self.profile):
            self.store.recreate(self.profile, self.dimension)
        return self._run(files, full=True, files_per_commit=files_per_commit)

    def refresh(self, files: DataFrame, truncated: bool = False, files_per_commit: int | None = None) -> Report:
        """Index what changed since the manifest: new and changed files are cleared and inserted
        anew, deleted ones cleared.  A truncated listing deletes nothing.  A store that holds vectors
        of another profile is refused."""
        return self._run(files, full=False, truncated=truncated, files_per_commit=files_per_commit)

    def _run(self, files: DataFrame, full: bool, truncated: bool = False, files_per_commit: int | None = None) -> Report:
        """With ``files_per_commit`` a run commits about so many files at a time, each with its part of
        the manifest, so that one that breaks off is taken up by the next refresh where it was."""
        self.store.ensure(self.profile, self.dimension)
        try:
            return self._indexed(files, full, truncated, files_per_commit)
        finally:
            self.store.clear_scratch()

    def _indexed(self, files: DataFrame, full: bool, truncated: bool, files_per_commit: int | None) -> Report:
        # One evaluation of the listing and the hashes, which all that follows reads.
        state = self.store.scratch(self._states(files, self.store.manifest(), truncated))
        gone = state.where("state = 'deleted'").select("rel_path")
        work = state.where("content is not null and state <> 'deleted'" + ("" if full else " and state in ('added', 'changed')"))
        made = self.store.scratch(self.points_of(work.select("rel_path", "content")))
        accepted = self.accepted(made)
        points = made.join(accepted, ["file_path", "id"], "left_semi")
        unfinished = refresh.finished_files(made.select("file_path", "id"), accepted).where("not done").select(F.col("file_path").alias("rel_path"))
        # Of unchanged files those whose size or time is new are noted again, so that they aren't hashed each time.
        read = state.where("content is not null and state <> 'deleted'" + ("" if full else " and (state <> 'unchanged' or was = 'maybe_stale')"))
        fresh = read.join(unfinished, "rel_path", "left_anti")
        now = int(time.time() * 1000)
        fresh = fresh.select("rel_path", "hash", F.col("size").cast("long"), F.col("mtime_ms").cast("double"), F.lit(now).cast("long").alias("indexed_at"))
        unread = F.count_if(F.col("content").isNull() & F.col("state").isin("added", "maybe_stale"))
        counts = {r["state"]: r for r in state.groupBy("state").agg(F.count("*").alias("n"), unread.alias("unread")).collect()}
        n = {name: row["n"] for name, row in counts.items()}
        missed = sum(row["unread"] for row in counts.values())
        refused = not unfinished.isEmpty()
        steps = max(1, -(-work.count() // files_per_commit)) if files_per_commit else 1
        share = lambda c: F.pmod(F.xxhash64(F.lit("step"), c), F.lit(steps))  # noqa: E731  a file's step
        for step in range(steps):
            parts = ((work.select("rel_path"), "rel_path"), (points, "file_path"), (fresh, "rel_path"))
            part = [df.where(share(c) == step) if steps > 1 else df for df, c in parts]
            clear = part[0].unionByName(gone) if step == 0 else part[0]
            self.store.apply(clear, part[1], part[2], complete=step == steps - 1 and not missed and not refused)
        notes = ("the listing was truncated, so no file counts as deleted",) if truncated else ()
        if missed:
            notes += (f"{missed} files couldn't be read",)
        if refused:
            notes += ("not all chunks were accepted",)
        points_now = self.store.points().count()
        self.store.grow(points_now)
        return Report(n.get("added", 0), n.get("changed", 0), n.get("unchanged", 0) + n.get("maybe_stale", 0), n.get("deleted", 0), points_now, not missed and not refused, notes)

    def accepted(self, points: DataFrame) -> DataFrame:
        """Points (file_path, id) that the store takes; a store that refuses some overrides this.  The
        others aren't stored, and their files are tried again by the next refresh."""
        return points.select("file_path", "id")

    def _states(self, files: DataFrame, manifest: DataFrame, truncated: bool) -> DataFrame:
        """(rel_path, state, was, content, size, mtime_ms, hash): every path's state, maybe stale ones told
        apart by their hashes (was: before that); one that can't be read stays maybe stale."""
        states = refresh.guarded(refresh.diff(manifest, files), truncated)
        now = files.select("rel_path", "content", "size", "mtime_ms", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
        told = states.join(now, "rel_path", "left").join(manifest.select("rel_path", F.col("hash").alias("old")), "rel_path", "left")
        stale = F.col("state") == "maybe_stale"
        same = F.when(stale & F.col("hash").isNull(), "maybe_stale").when(stale & (F.col("hash") == F.col("old")), "unchanged").when(stale, "changed").otherwise(F.col("state"))
        return told.select("rel_path", same.alias("state"), F.col("state").alias("was"), "content", "size", "mtime_ms", "hash")

    def import_index(self, points: DataFrame, profile: str) -> int:
        """Copy another index's vectors of the same profile, and seed the manifest so that the next
        refresh confirms files by their hashes.  Copying nothing is an error."""
        if profile != self.profile:
            raise Mismatch(f"profile {profile}, not {self.profile}")
        self.store.ensure(self.profile, self.dimension)
        good = refresh.importable(projected(points, [x.split()[0] for x in POINTS.split(", ")]), self.dimension)
        n = good.count()
        if not n:
            raise ValueError("no point could be imported")
        manifest = refresh.seeded_manifest(refresh.path_hashes(good), int(time.time() * 1000))
        self.store.apply(manifest.select("rel_path"), good, manifest, complete=True)
        return n

    def status(self, files: DataFrame | None = None) -> dict:
        """What the store holds, and how fresh it is against a listing."""
        info = self.store.info()
        if files is not None:
            info |= refresh.freshness(refresh.diff(self.store.manifest(), files)).first().asDict()
        return info


def find(
    engine: Engine,
    query: str,
    path: str | None = None,
    limit: int | None = None,
    min_score: float | None = None,
    baseline: Engine | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Hits for a query in one or two corpora: file_path, start_line, end_line, score, code_chunk,
    file_hash, source.  A corpus with points that can't be searched is an error, not half an answer."""
    spark, k = engine.spark, search.clamp_limit(limit)
    least = search.MIN_SCORE if min_score is None else min_score
    sides = []
    for name, e in (("baseline", baseline), ("own", engine)):
        if e is None or not e.store.exists():
            continue
        try:
            vector = spark.range(1).select(e.embed_column(F.lit(query)).alias("v")).first()["v"]
        except Exception as error:  # noqa: BLE001
            search.refuse_partial(name, e.store.points().count(), error)
            continue
        if vector is None:
            continue
        try:
            e.store.points().select("id").limit(1).collect()  # files that are gone fail here, not in the caller's action
        except Exception as error:  # noqa: BLE001
            search.refuse_partial(name, 1, error)
        points = search.valid_hits(e.store.points(), *REQUIRED, "file_hash")
        if path:
            points = points.where(T.under_segments(F.col("file_path"), path))
        hits = search.top_k(search.scored(points, list(vector)).where(F.col("score") >= least), k, "file_path", "start_line", "end_line")
        sides.append((name, hits.select("file_path", "start_line", "end_line", "score", "code_chunk", "file_hash")))
    if not sides:
        return spark.createDataFrame([], "file_path string, start_line int, end_line int, score double, code_chunk string, file_hash string, source string")
    by = dict(sides)
    empty = sides[0][1].limit(0)
    found = search.merged(by.get("baseline", empty), by.get("own", empty), k)
    if files is not None and len(by) == 2:
        found = search.without_ghosts(found, files).drop("rank")
    return found


def rendered(hits: DataFrame) -> list[str]:
    """Numbered lines of a result, at most as many as the limit allows."""
    return [f"{n}. [{h['source']}] {h['file_path']}:{h['start_line']}-{h['end_line']} (score {h['score']:.4f})" for n, h in enumerate(hits.collect(), 1)]


__all__ = ["MANIFEST", "Engine", "Report", "find", "rendered"]
