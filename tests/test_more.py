"""Syntax-aware chunks, replies of embedding services, mean vectors, and the store's commits."""

import ast
import base64
import struct

import pytest
from pyspark.sql import functions as F

from tessera.api import Engine, find
from tessera.operators import chunk, embed, evaluate, refresh, search, syntax
from tessera.plans import registry
from tessera.sources import store as S
from tessera.streaming.refresh import refresh_from
from test_engine import FILES, files, text

CODE = '''import os
from collections import namedtuple as a_rather_long_name_that_fills_the_line_up


@decorated("with an argument that is long enough to matter")
class Thing:
    """A thing with a method that is long enough for a chunk."""

    def method(self, argument):
        return [argument, "and some words so that it is long enough"]


squares = {number: number * number for number in range(1000) if number % 2}
count: int = 0
'''


def test_captured_nodes():
    found = {(c.type, c.start_line, c.end_line) for c in syntax.by_syntax("a/b.py", CODE)}
    assert found == {
        ("import_from_statement", 2, 2),
        ("decorated_definition", 5, 10),
        ("class_definition", 6, 10),
        ("function_definition", 9, 10),
        ("expression_statement", 13, 13),
    }
    whole = {c.type: c.content for c in syntax.by_syntax("a/b.py", CODE)}
    assert whole["decorated_definition"].startswith("@decorated(") and whole["class_definition"].startswith("class Thing")
    assert ast.parse(whole["decorated_definition"]) and whole["expression_statement"].endswith("% 2}")


def test_large_nodes_give_way_to_their_children_and_lines():
    body = "\n".join(f"    def method_{k}(self):\n        return 'méthode {k}, long enough for a chunk of its own'" for k in range(30))
    found = syntax.by_syntax("x.py", f"class Big:\n{body}\n")
    # As captures, and as children of the class: the engine keeps the first of each hash.
    assert {c.type for c in found} == {"function_definition"} and len({(c.start_line, c.content) for c in found}) == 30 == len(found) / 2
    leaf = syntax.Node("leaf", 4, 9, "\n".join(["x" * 300] * 6), list)
    assert [(c.start_line, c.end_line, c.type) for c in syntax.walk([leaf])] == [(c.start_line, c.end_line, "leaf") for c in chunk.by_lines(["x" * 300] * 6, "leaf", 5)]


def test_files_without_grammar_or_captures_are_cut_by_lines(spark):
    rows = [("a.py", "def broken(:\n" * 9), ("b.py", "x = 1 + 1\n" * 9), ("c.rs", "fn f() {}\n" * 9), ("d.py", None), ("e.py", CODE)]
    found = chunk.chunk_files(spark.createDataFrame(rows, "rel_path string, content string"), syntax.by_syntax).collect()
    assert {r["type"] for r in found if r["file_path"] < "d"} == {"fallback_chunk"}
    assert {r["file_path"] for r in found} == {"a.py", "b.py", "c.rs", "e.py"} and len([r for r in found if r["file_path"] == "e.py"]) == 5


PYTHON = '''import os_path_with_a_long_name_of_more_than_fifty_characters
short = 1
plain = lambda argument_of_some_length: argument_of_some_length + 1 + 2
held = (lambda argument_of_some_length: argument_of_some_length + 1 + 2)
numbers = [number_of_some_length * 2 for number_of_some_length in range(10)]
called = sorted(number_of_some_length * 2 for number_of_some_length in (1, 2))


def f(a, typed_parameter_with_a_name: "dict[str, list[tuple[int, int]]]", other_typed_parameter: "dict[str, list[int]]" = None):
    return a
'''


def test_python_captures_by_hand():
    """Of what is 50 units or more: lambdas in parentheses alone, parameters with a type alone."""
    got = [(c.type, c.start_line, c.end_line) for c in syntax.by_syntax("a.py", PYTHON)]
    assert got == [
        ("import_statement", 1, 1),
        ("expression_statement", 4, 4),
        ("expression_statement", 5, 5),
        ("function_definition", 9, 10),
        ("typed_parameter", 9, 9),
    ]


def test_an_index_has_syntax_chunks(spark, engine):
    engine.build(files(spark, [("a.py", PYTHON, 1), ("a.txt", PYTHON, 1), ("bad.py", text("not python at all"), 1)]))
    got = {(r["file_path"], r["start_line"], r["end_line"]) for r in engine.store.points().collect()}
    assert got == {("a.py", n, m) for n, m in ((1, 1), (4, 4), (5, 5), (9, 10), (9, 9))} | {("a.txt", 1, 11), ("bad.py", 1, 6)}
    assert find(engine, "held argument of some length", min_score=0.1).first()["file_path"] == "a.py"


def test_retries_end():
    waits, replies = [], [embed.HttpFailure(503), ConnectionError("gone"), "done"]

    def request():
        said = replies.pop(0)
        if isinstance(said, Exception):
            raise said
        return said

    assert embed.retried("x", request, waits.append) == "done" and waits == [0.5, 1.0]
    replies[:] = [embed.HttpFailure(429)] * 3
    with pytest.raises(RuntimeError, match="x: embedding request failed: HTTP 429"):
        embed.retried("x", request, waits.append)
    replies[:], waits[:] = [embed.HttpFailure(400), "never"], []
    with pytest.raises(RuntimeError):
        embed.retried("x", request, waits.append)
    assert waits == [] and replies == ["never"]


def test_replies():
    coded = base64.b64encode(struct.pack("<2f", 0.5, -2.0)).decode()
    data = [{"index": 1, "embedding": [1, 2]}, {"index": 0, "embedding": coded}]
    assert embed.reply_vectors({"data": data}, 2) == [[0.5, -2.0], [1.0, 2.0]]
    assert embed.reply_vectors({"data": [{"embedding": [1]}, {"embedding": [2]}]}, 2) == [[1.0], [2.0]]
    assert embed.reply_vectors({"embeddings": [[1], [2]]}, 2) == embed.reply_vectors({"embeddings": [{"values": [1]}, {"values": [2]}]}, 2) == [[1.0], [2.0]]
    for bad in (None, {}, {"data": data[:1]}, {"data": [data[0], data[0]]}, {"data": [data[0], {"index": 2, "embedding": [1]}]}, {"data": [{}, {}]}, {"embeddings": [{}, {}]}, {"embeddings": [[1]]}):
        with pytest.raises(ValueError):
            embed.reply_vectors(bad, 2)


def test_mean_vectors(spark):
    tokens = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 9), (2, 9), (3, None), (4, 0), (4, 2)], "doc long, token long")
    table = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 6.0]), (2, [-3.0, 0.0])], "token long, vector array<float>")
    got = {r["doc"]: (r["known"], [round(x, 6) for x in r["vector"]]) for r in embed.mean_vectors(tokens, "doc", table, 2).collect()}
    assert got == {1: (3, [0.707107, 0.707107]), 2: (0, [0.0, 0.0]), 3: (0, [0.0, 0.0]), 4: (2, [0.0, 0.0])}


def test_means_by_hashed_terms(spark):
    """As the means of exploded tokens, with nulls, a number that is not one, and keys and tokens that come twice."""
    texts = [(1, "alpha Beta, alpha"), (1, "gamma"), (2, None), (3, ""), (4, "beta " * 300 + "delta"), (5, "zeta"), (None, "alpha eta")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    number = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") % 7
    tokens = docs.select("doc", F.explode_outer(F.transform(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != ""), number)).alias("token"))
    rows = [(0, [3.0, 0.5]), (1, [0.0, 6.0]), (1, [2.0, None]), (2, None), (3, [-3.0, 1.0]), (4, [float("nan"), 1.0]), (5, [0.25, -1.0]), (7, [9.0, 9.0]), (None, [9.0, 9.0])]
    table = spark.createDataFrame(rows, "token long, vector array<float>")
    told = lambda df: {r["doc"]: (r["known"], [round(x, 9) for x in r["vector"]]) for r in df.collect()}
    found = embed.hashed_means(docs, "doc", "text", 7, table, 2)
    assert repr(sorted(told(found).items(), key=repr)) == repr(sorted(told(embed.mean_vectors(tokens, "doc", table, 2)).items(), key=repr))


def test_mean_embed_shuffles_no_terms(spark, sf):
    plan = registry.QUERIES["mean_embed"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Aggregate") == 1  # one row of sums a text, then its dimensions


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/own")


def test_an_interrupted_commit_changes_nothing(spark, engine, tmp_path):
    engine.build(files(spark, [("a.py", text("a"), 1)]))
    heads = tmp_path / "own" / "heads"
    (heads / "000000000099").mkdir()  # a writer that ended before its content was there
    (heads / ".half").write_text("{")
    (tmp_path / "own" / "points-lost").mkdir()
    assert engine.store.info()["points"] == 1
    gone = engine.store.clean()
    assert "points-lost" in gone and engine.store.points().count() == 1


def test_the_second_of_two_writers_fails(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1)]))
    before = engine.store.head()
    engine.store.mark_complete(False)
    with pytest.raises(S.Mismatch):
        engine.store._commit(before, metadata=before["metadata"])
    assert engine.store.info()["complete"] is False


def test_a_change_writes_its_bucket_alone(spark, engine, tmp_path):
    engine.build(files(spark, [(f"f{k}.py", text(f"word{k}"), 1) for k in range(20)]))
    before = engine.store.head()["buckets"]
    drop = f"{tmp_path}/drop"
    spark.createDataFrame([("f3.py", text("new"), 99, None), ("f3.py", text("newer"), 99, 5.0)], FILES).write.parquet(drop)
    refresh_from(engine, spark.readStream.schema(FILES).parquet(drop), f"{tmp_path}/c").awaitTermination()
    after = engine.store.head()["buckets"]
    assert len([b for b in after if before.get(b) != after[b]]) == 1 and set(after) == set(before)
    assert engine.store.points().count() == 20 and "newer" in engine.store.points().where("file_path = 'f3.py'").first()["code_chunk"]


def test_a_change_without_a_time_is_no_deletion(spark, engine, tmp_path):
    spark.createDataFrame([("a.py", text("a"), 9, None)], FILES).write.parquet(f"{tmp_path}/drop")
    refresh_from(engine, spark.readStream.schema(FILES).parquet(f"{tmp_path}/drop"), f"{tmp_path}/c").awaitTermination()
    assert engine.store.points().count() == 1


def test_a_run_with_refused_chunks_is_incomplete(spark, engine):
    listed = files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)])
    engine.accepted = lambda points: points.where("file_path <> 'b.py'").select("file_path", "id")
    report = engine.build(listed)
    assert not report.complete and report.notes and engine.store.info()["complete"] is False
    assert [r["rel_path"] for r in engine.store.manifest().collect()] == ["a.py"]
    assert [r["file_path"] for r in engine.store.points().collect()] == ["a.py"]  # what was refused isn't stored
    del engine.accepted
    again = engine.refresh(listed)
    assert again.complete and again.added == 1 and engine.store.points().count() == 2


def test_a_file_that_was_accepted_and_is_refused_now(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)]))
    engine.accepted = lambda points: points.where("file_path <> 'b.py'").select("file_path", "id")
    report = engine.refresh(files(spark, [("a.py", text("a"), 1), ("b.py", text("bb"), 2)]))
    assert (report.complete, report.changed, report.points) == (False, 1, 1)
    assert [r["rel_path"] for r in engine.store.manifest().collect()] == ["a.py"]


def test_a_build_deletes_files_that_are_gone(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)]))
    report = engine.build(files(spark, [("a.py", text("a"), 1)]))
    assert (report.deleted, report.points, report.complete) == (1, 1, True)
    assert [r["rel_path"] for r in engine.store.manifest().collect()] == ["a.py"]
    assert {h["file_path"] for h in find(engine, text("b"), min_score=0.0).collect()} == {"a.py"}


def test_another_profile_is_rebuilt_by_a_build_alone(spark, engine, tmp_path):
    listed = files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)])
    engine.build(listed)
    other = Engine(spark, engine.store.root, "local:hashed:16", 16, lambda c: embed.hashed_vector(c, 16))
    with pytest.raises(S.Mismatch):
        other.refresh(listed)
    assert engine.store.points().count() == 2  # a refresh that is refused leaves the store as it was
    report = other.build(listed.where("rel_path = 'a.py'"))
    assert (report.added, report.points, report.complete) == (1, 1, True)
    assert other.store.info()["profile"] == "local:hashed:16" and len(other.store.points().first()["vector"]) == 16


def test_a_run_that_breaks_off_is_taken_up(spark, engine):
    """Commits of a few files each: those that were made stay, and the next refresh does the rest."""
    listed = files(spark, [(f"f{k}.py", text(f"word{k}"), 1) for k in range(12)])
    apply, calls = engine.store.apply, []

    def broken(*args, **more):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(apply(*args, **more))

    engine.store.apply = broken
    with pytest.raises(RuntimeError):
        engine.build(listed, files_per_commit=3)
    engine.store.apply = apply
    had = engine.store.manifest().count()
    assert 0 < had < 12 and engine.store.points().count() == had and engine.store.info()["complete"] is False
    report = engine.refresh(listed, files_per_commit=5)
    assert (report.added, report.unchanged, report.points, report.complete) == (12 - had, had, 12, True)


def test_a_refresh_writes_what_changed(spark, engine):
    """Of points and manifest, only the buckets that a changed file lies in."""
    listed = [(f"f{k}.py", text(f"word{k}"), 1) for k in range(40)]
    engine.build(files(spark, listed))
    before = engine.store.head()
    engine.refresh(files(spark, [*listed[1:], ("f0.py", text("other"), 2)]))
    after = engine.store.head()
    for part in ("buckets", "manifest"):
        assert set(after[part]) == set(before[part]) and len([b for b in after[part] if after[part][b] != before[part][b]]) == 1
    assert engine.store.points().count() == engine.store.manifest().count() == 40
    engine.refresh(files(spark, [(p, c, 9 if p == "f1.py" else m) for p, c, m in [*listed[1:], ("f0.py", text("other"), 2)]]))
    assert engine.store.manifest().where("rel_path = 'f1.py'").first()["mtime_ms"] == 9.0  # touched, and not hashed again next time


def test_buckets_grow_with_the_store(spark, engine, monkeypatch):
    monkeypatch.setattr(S.Store, "BUCKETS", 2)
    monkeypatch.setattr(S.Store, "POINTS_OF_BUCKET", 3)
    engine.build(files(spark, [(f"f{k}.py", text(f"word{k}"), 1) for k in range(20)]))
    assert engine.store.head()["n"] == 2  # 20 points are below four times what two buckets should have
    engine.refresh(files(spark, [(f"f{k}.py", text(f"word{k}"), 1) for k in range(40)]))
    head = engine.store.head()
    assert head["n"] == 16 and len(head["buckets"]) > 4 and len(head["manifest"]) > 4
    report = engine.refresh(files(spark, [(f"f{k}.py", text(f"word{k}"), 1) for k in range(1, 40)]))
    assert (report.unchanged, report.deleted, report.points) == (39, 1, 39) and engine.store.manifest().count() == 39


def test_runs_leave_no_scratch(spark, engine, tmp_path):
    engine.build(files(spark, [("a.py", text("a"), 1)]))
    engine.refresh(files(spark, [("a.py", text("b"), 2)]))
    assert not list((tmp_path / "own").glob("scratch-*"))


def test_lost_files_are_refused(spark, engine, tmp_path):
    import shutil

    engine.build(files(spark, [("a.py", text("a"), 1)]))
    for folder in (tmp_path / "own").glob("points-*"):
        shutil.rmtree(folder)
    with pytest.raises(search.Unreachable):
        find(engine, "a")


def test_stores_pages_and_prefixes(spark, engine, tmp_path):
    engine.build(files(spark, [(p, text(p), 1) for p in ("src/a/x.py", "src/a.py", "src/ab/y.py", "z.py")]))
    assert S.stores(spark, f"file://{tmp_path}") == ["own"] and S.stores(spark, f"file://{tmp_path}/none") == []
    engine.store.delete_prefixes(spark.createDataFrame([("src\\a",)], "file_path string"))
    assert {r["file_path"] for r in engine.store.points().collect()} == {"src/a.py", "src/ab/y.py", "z.py"}
    rows = spark.createDataFrame([(k,) for k in range(5)], "id long")
    first = S.page(rows, "id", None, 3).collect()
    assert [(r["id"], r["next"]) for r in first] == [(0, 2), (1, 2), (2, 2)]
    assert [(r["id"], r["next"]) for r in S.page(rows, "id", 2, 3).collect()] == [(3, None), (4, None)]
    with pytest.raises(ValueError):
        S.page(rows, "id", None, 0)
    engine.store.recreate("other:model:8", 8)
    assert engine.store.info() == {"exists": True, "points": 0, "schema": S.SCHEMA_VERSION, "profile": "other:model:8", "dimension": 8, "complete": False}


def test_upsert_moves_a_point(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)]))
    moved = engine.store.points().where("file_path = 'a.py'").withColumn("file_path", F.lit("c.py"))
    engine.store.upsert(moved)
    assert sorted(r["file_path"] for r in engine.store.points().collect()) == ["b.py", "c.py"]


def test_dimensions(spark):
    assert refresh.probed_dimension(None, None, "p", "m", 8) == 8
    assert refresh.probed_dimension(None, {"provider": "p", "model": "m", "dimension": "16"}, "p", "m") == 16
    assert refresh.probed_dimension(lambda texts: [[0.0] * 3], {"provider": "q", "model": "m", "dimension": 16}, "p", "m") == 3


def rows_read(df):
    """Rows that the scans of a query without a shuffle gave to it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_skip_files(spark, engine):
    engine.build(files(spark, [(f"d{k % 7}/f{k}.py", text(f"word{k}"), 1) for k in range(400)]))
    ids = [r["id"] for r in engine.store.points().orderBy("id").select("id").limit(5).collect()]
    found = engine.store.lookup([*ids, "not-there", ids[0]])
    assert sorted(r["id"] for r in found.collect()) == ids
    assert rows_read(engine.store.lookup(ids)) < 120  # of 400: parts that can't have them aren't read
    assert rows_read(engine.store.lookup(["not-there"])) < 40
    assert engine.store.lookup([]).collect() == []
    assert rows_read(engine.store.points().where(F.startswith("file_path", F.lit("zzz")))) == 0  # files are sorted by path
