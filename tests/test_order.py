"""Places in an order, and requests packed along it, over many small blocks."""

import random

import pytest

from tessera.operators import embed, order


@pytest.mark.parametrize(("n", "items", "most", "block", "fan"), [(1, 3, 10, 4, 2), (57, 4, 12, 4, 2), (300, 5, 20, 8, 3), (300, 7, 15, 64, 2), (64, 8, 1000, 8, 2), (65, 8, 3, 8, 4)])
def test_requests_by_the_plain_fold(spark, n, items, most, block, fan):
    rng = random.Random(n + items)
    sizes = [rng.choice([0, 1, 2, 3, 5, 9, 40]) for _ in range(n)]
    rows = spark.createDataFrame([(i * 3, s if s else None) for i, s in enumerate(sizes)], "id long, tokens long").repartition(3)
    got = order.packed(rows, "id", "tokens", items, most, block, fan).orderBy("id").collect()
    whole = embed.request_batches(["x" * (4 * s) for s in sizes], items, most)
    assert [r["request"] for r in got] == [k for k, b in enumerate(whole) for _ in b]
    assert got[0].asDict().keys() == {"id", "tokens", "request"}


def test_no_texts(spark):
    assert order.packed(spark.createDataFrame([], "id long, tokens long"), "id", "tokens", 3, 10).collect() == []
    with pytest.raises(ValueError):
        order.packed(spark.createDataFrame([], "id long, tokens long"), "id", "tokens", 9, 10, block=8)


def test_places_in_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = order.placed(df, "g", "k", "i").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r[1:]):
        by.setdefault(r[0], []).append(r)
    assert sorted(map(tuple, got), key=repr) == sorted((r + (p,) for g in by.values() for p, r in enumerate(g)), key=repr)
    whole = order.placed(df, None, "k", "i").collect()
    assert [r["i"] for r in sorted(whole, key=lambda r: r["pos"])] == [r[2] for r in sorted(rows, key=lambda r: r[1:])]
