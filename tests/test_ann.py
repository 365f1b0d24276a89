"""The inverted file: exact over all cells, recall over few, hot cells, and awkward tables."""

import numpy as np
import pytest

from tessera.operators import ann, search
from tessera.sources import shared

VEC = "vec_id long, embedding array<float>"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)], VEC)


def clustered(n, dim=12, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))


def rows(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


def test_recall_reading_few_cells(spark):
    points = table(spark, clustered(1500))
    index = ann.build(points, shared.fresh(spark, "ann"))
    queries = points.where("vec_id % 10 = 0")
    exact = search.top_k_per_query(points, queries, 10, 0.0).withColumnRenamed("vec_id", "id")
    assert index.probes < len(index.centroids) / 2  # in clusters few cells are enough
    measured = ann.recall(ann.top_k(index, queries, 10, 0.0), exact).collect()
    assert len(measured) == 150 and sum(r["recall"] for r in measured) >= 0.9 * 150
    assert rows(ann.top_k(index, queries, 10, 0.0, probes=len(index.centroids))) == rows(exact)
    again = ann.opened(spark, index.points.inputFiles()[0].split("/points/")[0], index.points.drop("cell").schema)
    assert again.probes == index.probes and rows(ann.top_k(again, queries, 3, 0.0)) == rows(ann.top_k(index, queries, 3, 0.0))


def test_a_query_reads_its_cells_alone(spark):
    points = table(spark, clustered(600))
    index = ann.build(points, shared.fresh(spark, "ann"))
    read = index.points.where("cell = 3")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and read.count() == points.count() - index.points.where("cell <> 3").count()


def test_full_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "POINTS", 16)
    monkeypatch.setattr(ann, "QUERIES", 8)
    x = np.concatenate([np.tile(np.array([[1.0, 0.0, 0.1]]), (200, 1)), np.random.default_rng(1).normal(size=(100, 3))])
    points = table(spark, x)
    index = ann.build(points, shared.fresh(spark, "ann"))
    exact = search.top_k_per_query(points, points.where("vec_id % 3 = 0"), 7, 0.5).withColumnRenamed("vec_id", "id")
    assert rows(ann.top_k(index, points.where("vec_id % 3 = 0"), 7, 0.5, probes=len(index.centroids))) == rows(exact)


@pytest.mark.parametrize("x", [[], [[1.0, 2.0]], [[0.0, 0.0], [1.0, 0.0], None]])
def test_small_and_awkward_tables(spark, x):
    points = spark.createDataFrame(list(enumerate(x)), VEC)
    index = ann.build(points, shared.fresh(spark, "ann"))
    got = rows(ann.top_k(index, points, 5, 0.5))
    assert got == [(i, i, 1.0, 1) for i, v in enumerate(x) if v and any(v)]


def test_profiles_in_one_job(spark, monkeypatch):
    """Profiles of unequal dimension, one without points, one that is cut into blocks."""
    monkeypatch.setattr(ann, "POINTS", 16)
    schema = "profile string, id long, vector array<double>"
    rows = [("a:2", i, [1.0, i / 10]) for i in range(60)] + [("b:3", i, [0.0, 1.0, float(i)]) for i in range(4)] + [("b:3", 9, None), (None, 8, [1.0])]
    asked = [("a:2", 1, [1.0, 0.0]), ("b:3", 1, [0.0, 1.0, 0.0]), ("c:1", 1, [1.0])]
    got = ann.by_profile(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), 2, 0.1).collect()
    assert sorted((r["profile"], r["query_id"], r["id"], r["score"], r["rank"]) for r in got) == [
        ("a:2", 1, 0, 1.0, 1), ("a:2", 1, 1, 0.995037, 2), ("b:3", 1, 0, 1.0, 1), ("b:3", 1, 1, 0.707107, 2),
    ]
