"""The substring index: terms and phrases against Python's own counting, and the name ranker."""

import itertools
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate, matching, postings
from tessera.plans import registry
from tessera.sources import shared

FILES = "rel_path string, content string"
TEXTS = {
    "a": "aaaa ab AAA-aab_aa",
    "b": None,
    "c": "",
    "d": "Straße İstanbul tokenizer token_izer TOKENIZE retoken",
    "e": "日本語 !!! ... a\tb\nc",
    "f": "z" * 5000 + "needle" + "y" * 3000 + " x" * 10,
    "g": "the quick brown fox. the quick Brown fox? quickbrown",
}


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), FILES)


def hits(spark, texts, terms, cap=None):
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    return {(r["term"], r["rel_path"]): r["n"] for r in postings.term_hits(postings.build(files(spark, texts)), asked, cap).collect()}


def counted(texts, terms):
    return {(t, p): c.lower().count(t) for t in {*terms} - {None, ""} for p, c in texts.items() if c and c.lower().count(t)}


def test_terms_of_any_length(spark):
    terms = ["a", "aa", "aaa", "token", "tokenizer", "izer", "needle", "zz", "zneedley", "quick", "nothere", "x", "", None, "aa", "stanbul"]
    assert hits(spark, TEXTS, terms) == counted(TEXTS, terms)
    assert hits(spark, TEXTS, ["a"], 3)["a", "a"] == 3


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    texts = {f"f{i}": "".join(rng.choice([word(), " ", "-", "\n"]) for _ in range(40)) for i in range(12)}
    terms = [word() for _ in range(25)]
    assert hits(spark, texts, terms) == counted(texts, terms)


def test_phrases_as_they_are_written(spark):
    asked = ["quick brown", "the quick brown fox", "quick Brown fox?", "The quick", "!!! ...", "日本", "x x x", "okenizer token_i", "needle", ". the", "", None, "no such words here", "a\tb\nc"]
    df = spark.createDataFrame([(p,) for p in asked + asked[:3]], "phrase string")
    got = postings.phrase_hits(postings.build(files(spark, TEXTS)), df, files(spark, TEXTS)).collect()
    want = {(p, f) for p, (f, c) in itertools.product(asked, TEXTS.items()) if p and c and p in c}
    assert {(r["phrase"], r["rel_path"]) for r in got} == want and len(got) == len(want)


def test_an_index_is_read_back(spark):
    path = shared.fresh(spark, "kept")
    built = postings.build(files(spark, TEXTS), path)
    again = spark.read.parquet(f"{path}/words")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, built.words.collect()))
    assert built.vocabulary.where("word = 'quick'").first()["files"] == 1


def test_an_empty_corpus(spark):
    empty = spark.createDataFrame([], FILES)
    index = postings.build(empty)
    asked = spark.createDataFrame([("abc",), ("a",)], "term string")
    assert postings.term_hits(index, asked).collect() == []
    assert postings.phrase_hits(index, asked.withColumnRenamed("term", "phrase"), empty).collect() == []


def test_keyword_ranking_leaves_out_what_it_does_not_read(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_CHARS", 100)
    texts = {"a.py": "parser parser tokens", "b.py": "parser", "x.lock": "parser tokens", "long.py": "parser tokens " * 20, "c.py": "none"}
    asked = spark.createDataFrame([(1, "parser tokens"), (2, "absent words")], "query_id long, query string")
    got = evaluate.keyword_ranked(asked, files(spark, texts), postings.build(files(spark, texts)), 10).collect()
    assert [(r["query_id"], r["rel_path"], r["n_terms"], r["n_hits"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a.py", 2, 3, 1), (1, "b.py", 1, 1, 2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_ranks_as_postings_do(spark, monkeypatch, seed):
    """In one pass, over blocks of queries, files rank as by an index, repeated paths and ids too."""
    monkeypatch.setattr(matching, "QUERY_BLOCK", 3)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
    rows = [(f"f{i}.py", " ".join(rng.choice([word(), word().upper(), "-", "abcabc"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [*rows[:3], ("f1.py", word()), ("null.py", None), ("x.lock", "abc abcabc"), ("many.py", "abc" * 30)]
    asked = spark.createDataFrame([(i % 9, " ".join(word()[: rng.randint(3, 5)] for _ in range(5))) for i in range(10)] + [(99, "of"), (98, None)], "query_id long, query string")
    listed = spark.createDataFrame(rows, FILES)
    want = evaluate.keyword_ranked(asked, listed, postings.build(listed), 7)
    got = evaluate.keyword_ranked(asked, listed, None, 7).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    phrases = spark.createDataFrame([(r[1][4:20],) for r in rows if r[1]] + [("",), (None,), ("-",), ("cab a",)], "phrase string")
    held = matching.phrases_in(phrases, listed)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, postings.phrase_hits(postings.build(listed), phrases, listed).collect()))


def test_one_pass_over_nothing(spark):
    empty, asked = spark.createDataFrame([], FILES), spark.createDataFrame([(1, "parser")], "query_id long, query string")
    assert evaluate.keyword_ranked(asked, empty, None, 3).count() == evaluate.keyword_ranked(asked.limit(0), files(spark, TEXTS), None, 3).count() == 0
    assert matching.phrases_in(asked.select(F.col("query").alias("phrase")).limit(0), files(spark, TEXTS)).count() == 0


def test_rankings_of_tables_store_no_postings(spark, sf):
    """An index of all words is as large as the texts; a ranking that is made once doesn't write it."""
    at = shared.folder(spark).removeprefix("file://")
    before = set(os.listdir(at))
    assert registry.QUERIES["ndcg"](spark, sf).count() and registry.QUERIES["rrf_fusion"](spark, sf).count()
    assert not [f for f in set(os.listdir(at)) - before if f.startswith("postings")]


@pytest.mark.parametrize("seed", [1, 2])
def test_names_begin_alike(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(2, 7)))
    paths = {f"{word()}/{word()}_{word()}.py": "" for _ in range(30)}
    queries = [(i, " ".join(word() for _ in range(4))) for i in range(20)]
    got = evaluate.name_ranked(spark.createDataFrame(queries, "query_id long, query string"), files(spark, paths), 5).collect()
    want = []
    for i, q in queries:
        terms = {t for t in q.split() if len(t) >= 3 and t not in T.STOP_WORDS}
        scored = []
        for p in paths:
            parts = [x for x in p.replace(".", "/").replace("_", "/").split("/") if len(x) >= 4]
            n = sum(any(x.startswith(t) or t.startswith(x) for x in parts) for t in terms)
            if n:
                scored.append((-n, p))
        want += [(i, p, k) for k, (_, p) in enumerate(sorted(scored)[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
