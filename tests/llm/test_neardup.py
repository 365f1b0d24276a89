"""Near-duplicate vectors: against SQL and brute force, recall of the index, and awkward tables."""

import math

import numpy as np
import pytest

from tessera.llm import neardup, queries

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs and a walk over links."""
    unit = []
    for _, v in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if fine else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    near = [[j for j, b in enumerate(unit) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold] for i, a in enumerate(unit)]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        part[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((r[0], len(near[i]), part[i], r[0] == part[i]) for i, r in enumerate(rows)), key=repr)


def found(df, **more):
    return sorted(map(tuple, neardup.near_duplicates(df, **more).collect()), key=repr)


def planted(n, groups, size, dim=16, seed=0, spread=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    centres = rng.normal(size=(groups, dim))
    near = (centres[:, None] + spread * rng.normal(size=(groups, size, dim))).reshape(-1, dim)
    whole = np.concatenate([x, near])[rng.permutation(n + groups * size)]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(whole)]


def test_sql(same):
    same(queries.QUERIES["op12_near_vectors"], queries.SQL["op12_near_vectors"])


def test_chains_and_groups_by_brute_force(spark):
    """Fewer vectors than a grid takes, so one cell has all and nothing may be missed; neighbours on
    a circle link into one chain."""
    circle = [(1000 + k, [math.cos(k / 10), math.sin(k / 10)] + [0.0] * 14) for k in range(40)]
    rows = planted(150, 5, 12) + circle
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    assert found(df) == brute([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_recall_of_the_grid(spark):
    """With a grid: nothing that isn't linked, and nearly all that is, by brute force."""
    rows = planted(2500, 120, 5, spread=0.12)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    books = neardup.codebooks(df.selectExpr("embedding AS vector", "size(embedding) AS dim"), 0.9)
    assert set(books) == {16} and books[16].visits < len(books[16].left) * len(books[16].right)
    got, want = {r[0]: r for r in found(df)}, {r[0]: r for r in brute([(r["vec_id"], r["embedding"]) for r in df.collect()])}
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.97 * sum(r[1] for r in want.values()) > 0
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_cells_are_visited_from_near_to_far(k):
    rng = np.random.default_rng(k)
    x, books = rng.normal(size=(50, 6)), neardup.Codebooks(rng.normal(size=(k, 3)), rng.normal(size=(k + 1, 3)), 1)
    got = books.cells(x, k * (k + 1))
    d = ((x[:, None, :3] - books.left) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - books.right) ** 2).sum(2)[:, None]
    assert (np.sort(got, 1) == np.arange(k * (k + 1))).all()
    assert (np.diff(np.take_along_axis(d.reshape(50, -1), got, 1), axis=1) >= -1e-9).all()
    assert (got[:, :2] == books.cells(x, 2)).all()


def test_full_cells_are_split(spark, monkeypatch):
    """A hot group and copies, met over several blocks of one cell: nothing is lost or counted twice."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    hot = planted(40, 1, 260, dim=8, spread=0.05)
    df = spark.createDataFrame([(i, v, 0) for i, v in hot] + [(5000 + i, hot[0][1], 0) for i in range(40)], VEC)
    got = found(df)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()]) and max(r[1] for r in got) >= 259


AWKWARD = [
    (1, [1.0, 0.0, 0.0]),
    (2, [1.0, 0.0, 0.0]),
    (2, [1.0, 0.0, -0.0]),
    (3, [1e30, 0.0, 0.0]),
    (4, [1e-30, 0.0, 1e-31]),
    (None, [0.99, 0.1, 0.0]),
    (None, None),
    (5, None),
    (6, []),
    (7, [0.0, 0.0, 0.0]),
    (8, [1.0, None, 0.0]),
    (9, [1.0, float("nan"), 0.0]),
    (10, [float("inf"), 0.0, 0.0]),
    (11, [1.0, 0.0]),
    (12, [1.0]),
    (13, [-1.0]),
    (13, [-2.0]),
    (-3, [0.0, 1.0, 0.0]),
]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, None) for i, v in AWKWARD], VEC)
    clash = df.withColumns({c: F.lit("clash") for c in "node vector dim n visits home code kept n_links component least cell a b".split()})
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert found(clash) == want
    assert (1, 5, 1, True) in want and (13, 1, 13, True) in want
    assert found(clash.select("vec_id", F.expr("CAST(embedding AS array<double>)").alias("embedding"))) == want


def test_empty(spark):
    df = neardup.near_duplicates(spark.createDataFrame([], VEC))
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and df.collect() == []
