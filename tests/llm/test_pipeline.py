"""The pipeline, stage by stage, against plain Python."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tessera.llm import quality
from test_ops import AWKWARD, DOC, brute_components, pairs, rows_of


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = dict(P.STAGES)
    assert list(by) == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    kept = by["quality rules"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert rows(kept) == rows(quality.judge(docs).where("kept"))
    last = {t: i for i, t in sorted(pairs(kept))}
    once = P.stored(by["exact dedup"](spark, kept, sf), "test")
    assert rows(once) == Counter((i, t) for t, i in last.items())
    near = P.stored(by["n-gram Jaccard join"](spark, once, sf), "test")
    first = {c for (_, _, c), _ in brute_components(pairs(once)).items()}
    assert rows(near) == Counter((i, t) for t, i in last.items() if i in first)
    mixed = P.stored(by["mixing sources"](spark, near, sf), "test")
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(rows(near)) and max(rows(mixed).values()) <= 2
    pieces = by["best-fit packing"](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(i for (i, _), n in rows(mixed).items() for _ in range(n))
    assert {r["doc_id"] for r in P.run(spark, sf).select("doc_id").collect()} == {r["doc_id"] for r in pieces}


def test_stages_on_awkward_rows(spark):
    docs = P.stored(spark.createDataFrame(rows_of(AWKWARD), DOC), "test")
    once = rows(P.exact_dedup(spark, docs, ""))
    last = defaultdict(lambda: None)
    for i, t in pairs(docs):
        if i is not None and (last[t or ""] is None or i > last[t or ""]):
            last[t or ""] = i
    assert Counter((i, t or "") for i, t in once.elements()) == Counter((last[t], t) for t in {t or "" for _, t in pairs(docs)})
    near = rows(P.near_dedup(spark, docs, ""))
    assert near[(10, "another text under the same id")] == 1 and near[(4, None)] == 1
    assert sum(n for (i, _), n in near.items() if i == 2) == 0 and sum(n for (i, _), n in near.items() if i == 1) == 1
    mixed = rows(P.mix_sources(spark, docs, ""))
    assert max(mixed.values()) <= 4 and set(mixed) <= set(rows(docs))


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_of_nothing(spark, stage):
    assert stage(spark, spark.createDataFrame([], DOC), "").count() == 0
