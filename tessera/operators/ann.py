"""Approximate nearest neighbours by an inverted file: vectors are stored by the cell of their nearest
centroid, and a query reads the cells nearest to it."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.search import rounded
from tessera.sources.shared import written

#: Vectors that an index is fitted on, at most, those of them that are asked for, and most numbers a sample has.
SAMPLE, ASKED, SAMPLE_NUMBERS = 16_384, 256, 1 << 22
#: Most cells of an index.
CELLS = 4_096
#: Share of the nearest vectors that a query is to find, in the mean.
RECALL = 0.95
#: Points of a cell, and queries that read it, which one group has, about.
POINTS, QUERIES = 4_096, 4_096


class Index(NamedTuple):
    """Centroids (unit vectors), the cells that a query reads, and the table of (id, vector, cell)."""

    centroids: np.ndarray
    probes: int
    points: DataFrame


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision; a zero vector stays zero."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else x.reshape(0, 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """n unit vectors that the rows of ``x`` gather around; one that no row is near stays."""
    found = x[np.sort(np.random.default_rng(42).choice(len(x), n, replace=False))].copy()
    for _ in range(rounds):
        near = (x @ found.T).argmax(1)
        sums = np.stack([np.bincount(near, x[:, d], n) for d in range(x.shape[1])], 1)
        length = np.linalg.norm(sums, axis=1)
        found[length > 0] = sums[length > 0] / length[length > 0, None]
    return found


def _probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells with which queries from the sample find ``recall`` of their ``k`` nearest in
    the sample.  Among all vectors the nearest are nearer, so this asks for no less there."""
    asked = x[np.random.default_rng(7).permutation(len(x))[:ASKED]]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    home = (x @ centroids.T).argmax(1)
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None], 1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def build(points: DataFrame, path: str, k: int = 10, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Index all ``points`` (key, vector) under ``path``, for searches of ``k`` nearest.

    Centroids and the number of cells to read are fitted on the vectors with the smallest hashes, a
    bounded sample; every vector is stored, in the folder of its cell.  Null vectors are left out;
    all others have one length."""
    spark = points.sparkSession
    rows = points.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    total, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    wanted = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(dim or 1, 1)))
    share = int(min(1.0, wanted / max(total, 1)) * 2**31)
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vector"), F.lit(2**31)) <= share).limit(2 * wanted)
    sample = unit(picked.select("vector").toArrow()["vector"])
    n = int(min(max(1, round(total**0.5)), CELLS, max(1, len(sample))))
    centroids = _centroids(sample, n) if total else np.zeros((1, max(dim or 1, 1)))
    probes = _probes(sample, centroids, k, recall) if n > 1 else 1
    kept = spark.createDataFrame([(json.dumps({"probes": probes, "centroids": centroids.tolist()}),)], "fitted string")
    written(kept, f"{path}/fitted")
    placed = rows.withColumn("cell", _cell(centroids, 1)(F.col("vector"))[0])
    # A cell may hold most points: it is dealt over files by the id as well.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/points")
    return opened(spark, path, rows.schema)


def opened(spark: SparkSession, path: str, schema) -> Index:
    """An index that was built before; ``schema`` is that of id and vector."""
    fitted = json.loads(spark.read.parquet(f"{path}/fitted").first()[0])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return Index(np.array(fitted["centroids"]), fitted["probes"], spark.read.schema(f"{kinds}, cell int").parquet(f"{path}/points"))


def _cell(centroids: np.ndarray, n: int):
    """A function from vectors to the numbers of their ``n`` nearest centroids, nearest first."""
    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        x = unit(pa.array(vectors, pa.list_(pa.float64())))
        near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)
        return pd.Series(list(near))

    return cells


def top_k(index: Index, queries: DataFrame, k: int, min_score: float, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each of ``queries`` (key, vector) the best ``k`` points with
    score >= min_score among the cells that it reads; ties by id.  With as many ``probes`` as there
    are cells the result is exact.  Cells that no query reads aren't read, as their folders are
    pruned."""
    probes = min(probes or index.probes, len(index.centroids))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    calls = asked.select("id", "vector", F.explode(_cell(index.centroids, probes)(F.col("vector"))).alias("cell"))
    return ranked(met(index.points, calls, "cell", k, min_score), k, "query_id")


def by_profile(points: DataFrame, queries: DataFrame, k: int, min_score: float) -> DataFrame:
    """(profile, query_id, id, score, rank): for each of ``queries`` (profile, id, vector) the best
    ``k`` of the ``points`` (profile, id, vector) of its profile, all profiles in one job.

    Vectors of a profile have one length, and those of different profiles aren't compared: scores of
    different models say nothing of each other, so ranks are by profile.  A query of a profile that
    has no points has no rows.  Null vectors are left out."""
    some = lambda df: df.where("vector is not null and profile is not null").select("profile", "id", "vector")
    return ranked(met(some(points), some(queries), "profile", k, min_score), k, "profile", "query_id")


def ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The best ``k`` hits of each query, with rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    columns = [*dict.fromkeys((*by, "query_id", "id", "score"))]
    return hits.select(*columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def met(points: DataFrame, calls: DataFrame, group: str, k: int, min_score: float) -> DataFrame:
    """(group, query_id, id, score): the best ``k`` points (group, id, vector) of each query (group,
    id, vector) with a score of min_score or more, in each block of its group.

    A group with many of either is cut into blocks, of which each of one meets each of the other in
    one matrix product, and a block hands on k rows a query at most."""
    kind = points.schema[group].dataType.simpleString()
    points, calls = points.toDF(*points.columns), calls.toDF(*calls.columns)
    held = points.groupBy(group).agg(F.count("*").alias("n"))
    read = calls.groupBy(group).agg(F.count("*").alias("q")).join(held, group)
    full = read.select(group, F.ceil(F.col("n") / POINTS).cast("int").alias("np"), F.ceil(F.col("q") / QUERIES).cast("int").alias("nq"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = calls.join(full, group).select(group, every("np").alias("pb"), own("nq").alias("qb"), "id", "vector")
    right = points.join(full, group).select(group, own("np").alias("pb"), every("nq").alias("qb"), "id", "vector")

    def best(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if q.num_rows and p.num_rows:
            ids = p["id"].to_numpy()
            scores = rounded(unit(q["vector"]) @ unit(p["vector"]).T)
            for query, row in zip(q["id"].to_pylist(), scores, strict=True):
                near = np.flatnonzero(row >= min_score)
                near = near[np.lexsort((ids[near], -row[near]))[:k]]
                found += zip([query] * len(near), ids[near].tolist(), row[near].tolist(), strict=True)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        groups = pa.array([key[0].as_py()] * len(found), key[0].type)
        return pa.table({group: groups, "query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    blocks = (group, "pb", "qb")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may come of one table
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(best, f"{group} {kind}, query_id long, id long, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall): how many of the exact hits (query_id, id) of each query
    were found."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    counted = met.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return counted.withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
