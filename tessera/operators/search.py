"""Search: filtered cosine top-k over one or two corpora, merged with override."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V

#: Default threshold, limit and its ceiling, and how many hits are looked up.
MIN_SCORE, LIMIT, MOST_RESULTS, GHOST_CHECKS = 0.4, 50, 200, 60
#: Queries that are sent to the workers at a time.
QUERY_BLOCK = 2048
#: The largest double below a half: added to one, it takes halves to the next integer, and nothing below them.
HALF = np.nextafter(0.5, 0)


def clamp_limit(limit: int | None) -> int:
    return max(1, min(LIMIT if limit is None else limit, MOST_RESULTS))


def threshold(*choices: Column) -> Column:
    """The first threshold that is set."""
    return F.coalesce(*choices, F.lit(MIN_SCORE))


def scored(points: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """``points`` with the cosine ``score`` against one query, to 6 places."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("score", F.round(V.cosine(F.col(vector), literal), 6))


def rounded(scores: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero as in F.round and in SQL; np.round takes them to the even one.
    Vectors of whole numbers have such halves: 77/128 is 0.6015625."""
    scaled = scores * 1e6
    return np.trunc(scaled + np.copysign(HALF, scaled)) / 1e6


def top_k(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    """The best ``k`` by score, ties by the named columns; each task keeps k rows at most."""
    return hits.orderBy(F.col("score").desc(), *ties).limit(k)


def top_k_per_query(points: DataFrame, queries: DataFrame, k: int | None, min_score: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, <key>, score, rank) of the best ``k`` points of each query with score >= min_score;
    all of them, without rank, if k is None.

    Queries are gathered QUERY_BLOCK at a time, so what is sent to workers is bounded.  Each batch of
    points meets a block in one matrix product and hands on k rows a query at most."""
    spark = points.sparkSession
    found = None
    rows = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v"))
    for block in blocks(rows, QUERY_BLOCK):
        ids = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], np.float64)
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)))

        def run(batches, sent=sent):
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(keys), -1)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = rounded(q @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T)
                for row, (i, scores) in enumerate(zip(ids, s, strict=True)):
                    del row
                    near = np.flatnonzero(scores >= min_score)
                    near = near[np.lexsort((keys[near], -scores[near]))[:k]]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i)), pa.array(keys[near]), pa.array(scores[near])], ["query_id", key, "score"])

        part = points.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_id long, {key} long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id long, {key} long, score double")
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(rows: DataFrame, size: int):
    block = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def valid_hits(hits: DataFrame, *required: str) -> DataFrame:
    """Hits with all required fields, none null or an empty string."""
    for name in required:
        hits = hits.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return hits


def merged(baseline: DataFrame, own: DataFrame, limit: int, *by: str) -> DataFrame:
    """Hits (file_path, start_line, end_line, score, ...) of two corpora, the own one's in place of
    the baseline's with the same key, then the best ``limit``: of all, or of each query by the
    columns ``by``."""
    both = baseline.withColumn("source", F.lit("baseline")).unionByName(own.withColumn("source", F.lit("own")))
    one = Window.partitionBy(*by, "file_path", "start_line", "end_line").orderBy(F.col("source").desc(), F.col("score").desc())
    best = both.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    if not by:
        return top_k(best, limit, "file_path", "start_line", "end_line")
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "file_path", "start_line", "end_line")
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def without_ghosts(hits: DataFrame, files: DataFrame, checked: int = GHOST_CHECKS, by: tuple[str, ...] = ()) -> DataFrame:
    """``hits`` without those, among the first ``checked`` of each query, whose file is gone."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "file_path", "start_line", "end_line")  # hits are limited already
    ranked = hits.withColumn("rank", F.row_number().over(order))
    there = files.select(F.col("rel_path").alias("there")).distinct()
    return ranked.join(there, F.col("file_path") == F.col("there"), "left").where((F.col("rank") > checked) | F.col("there").isNotNull()).drop("there")


class Unreachable(RuntimeError):
    """A corpus that has points couldn't be searched; half an answer is refused."""


def refuse_partial(name: str, points: int, error: Exception | None) -> str | None:
    """Raise if a corpus with points failed; tell the error of an empty one."""
    if error is None:
        return None
    if points:
        raise Unreachable(f"{name}: {error}") from error
    return f"{name}: {error}"
