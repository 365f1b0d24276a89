"""The store, refreshes, searches and scans from end to end."""

import pytest
from pyspark.sql import functions as F

from tessera.api import Engine, find, rendered
from tessera.operators import evaluate, refresh, search, status
from tessera.sources import scan
from tessera.sources.store import Mismatch
from tessera.streaming.refresh import refresh_from

FILES = "rel_path string, content string, size long, mtime_ms double"


def text(word):
    return "\n".join([f"{word} alpha beta gamma delta {word}"] * 6)


def files(spark, rows):
    return spark.createDataFrame([(p, c, len(c), float(m)) for p, c, m in rows], FILES)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/own")


def test_build_refresh_search(spark, engine):
    first = [("src/a.py", text("apple"), 1), ("src/b.py", text("banana"), 1), ("src2/c.py", text("cherry"), 1)]
    report = engine.build(files(spark, first))
    assert (report.added, report.points) == (3, 3)
    again = engine.refresh(files(spark, first))
    assert (again.added, again.changed, again.unchanged, again.deleted) == (0, 0, 3, 0)
    second = [("src/a.py", text("avocado"), 2), ("src/b.py", text("banana"), 5), ("src/d.py", text("date"), 1)]
    r = engine.refresh(files(spark, second))
    assert (r.added, r.changed, r.unchanged, r.deleted) == (1, 1, 1, 1)
    rebuilt = Engine(spark, f"{engine.store.root}-again")
    rebuilt.build(files(spark, second))
    key = lambda e: sorted((x["id"], x["file_path"], x["code_chunk"]) for x in e.store.points().collect())
    assert key(engine) == key(rebuilt)
    hits = find(engine, text("banana"), min_score=0.2)
    assert hits.first()["file_path"] == "src/b.py"
    assert rendered(hits)[0].startswith("1. [own] src/b.py:1-6 (score 1.0000)")
    assert {h["file_path"] for h in find(engine, "alpha beta", path="src", min_score=0.0).collect()} == {"src/a.py", "src/b.py", "src/d.py"}


def test_a_chunk_without_a_vector_is_a_point_that_nothing_finds(spark, engine):
    report = engine.build(files(spark, [("a.txt", "# - " * 40, 1), ("b.txt", text("pear"), 1)]))
    assert (report.points, report.complete) == (2, True)
    assert set(engine.store.points().where("file_path = 'a.txt'").first()["vector"]) == {0.0}
    assert [h["file_path"] for h in find(engine, text("pear"), min_score=-1.0).collect()] == ["b.txt"]
    r = engine.refresh(files(spark, [("a.txt", "# - " * 40, 1), ("b.txt", text("pear"), 1)]))
    assert (r.added, r.changed, r.unchanged, r.points) == (0, 0, 2, 2)


def test_truncated_listing_deletes_nothing(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)]))
    r = engine.refresh(files(spark, [("a.py", text("a"), 1)]), truncated=True)
    assert (r.deleted, r.points) == (0, 2) and r.notes


def test_two_corpora_override_and_ghosts(spark, engine, tmp_path):
    base = Engine(spark, f"file://{tmp_path}/base")
    base.build(files(spark, [("a.py", text("pear"), 1), ("gone.py", text("pear"), 1)]))
    engine.build(files(spark, [("a.py", text("pear") + " more", 2)]))
    hits = find(engine, text("pear"), min_score=0.1, baseline=base)
    assert {(h["file_path"], h["source"]) for h in hits.collect()} == {("a.py", "own"), ("gone.py", "baseline")}
    kept = find(engine, text("pear"), min_score=0.1, baseline=base, files=files(spark, [("a.py", "x", 1)]))
    assert [h["file_path"] for h in kept.collect()] == ["a.py"]


def test_unreachable_corpus_is_refused(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1)]))

    def broken(column):
        raise RuntimeError("no embedder")

    engine.embed_column = broken
    with pytest.raises(search.Unreachable):
        find(engine, "a")


def test_store_checks(spark, engine):
    engine.build(files(spark, [("a.py", text("a"), 1)]))
    with pytest.raises(Mismatch):
        engine.store.ensure("other:model:64", 64)
    with pytest.raises(Mismatch):
        engine.store.ensure(engine.profile, 32)
    engine.store.mark_complete(False)
    assert engine.store.info()["complete"] is False
    engine.store.delete_all()
    assert engine.store.info()["points"] == 0
    engine.store.drop()
    assert not engine.store.exists()


def test_import_seeds_the_manifest(spark, engine, tmp_path):
    base = Engine(spark, f"file://{tmp_path}/base")
    listed = files(spark, [("a.py", text("a"), 1), ("b.py", text("b"), 1)])
    base.build(listed)
    assert engine.import_index(base.store.points(), engine.profile) == 2
    r = engine.refresh(listed)
    assert (r.added, r.changed, r.unchanged) == (0, 0, 2)
    with pytest.raises(Mismatch):
        engine.import_index(base.store.points(), "x:y:1")
    with pytest.raises(ValueError):
        engine.import_index(base.store.points().limit(0), engine.profile)


def test_streamed_changes(spark, engine, tmp_path):
    drop = f"{tmp_path}/drop"
    files(spark, [("a.py", text("a"), 1), ("a.py", text("aa"), 2), ("b.py", text("b"), 1)]).write.parquet(drop)
    refresh_from(engine, spark.readStream.schema(FILES).parquet(drop), f"{tmp_path}/checkpoint").awaitTermination()
    assert engine.store.points().count() == 2
    spark.createDataFrame([("b.py", None, 0, 3.0)], FILES).write.mode("append").parquet(drop)
    refresh_from(engine, spark.readStream.schema(FILES).parquet(drop), f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["file_path"] for r in engine.store.points().collect()] == ["a.py"]


def test_diff_golden(spark):
    manifest = spark.createDataFrame([("same", "h", 5, 100.0), ("stale", "h", 5, 100.0), ("gone", "h", 5, 100.0)], "rel_path string, hash string, size long, mtime_ms double")
    listed = spark.createDataFrame([("same", 5, 100.0), ("stale", 6, 200.0), ("new", 1, 1.0)], "rel_path string, size long, mtime_ms double")
    assert {r["rel_path"]: r["state"] for r in refresh.diff(manifest, listed).collect()} == {"same": "unchanged", "stale": "maybe_stale", "gone": "deleted", "new": "added"}
    assert {r["state"] for r in refresh.diff(None, listed).collect()} == {"added"}
    assert refresh.auto_refresh(refresh.diff(manifest, listed)) and not refresh.auto_refresh(refresh.diff(manifest, listed), most=2)


def test_scan(spark, tmp_path):
    tree = {".gitignore": "*.log\n!important.log\nsub/\n!sub/keep.ts\n", "code.ts": "x", "important.log": "x", "other.log": "x", "sub/keep.ts": "x", "pkg/__init__.py": "x", "_x/b.py": "x", ".github/w.yml": "x", ".hid/x": "x", "node_modules/m.js": "x", "a.png": "x", "empty.py": ""}
    for name, body in tree.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "t" / "link.ts").symlink_to(tmp_path / "t" / "code.ts")
    found, counts = scan.scan(spark, str(tmp_path / "t"))
    names = {r["rel_path"] for r in found.collect()}
    assert names == {".gitignore", ".github/w.yml", "_x/b.py", "code.ts", "pkg/__init__.py"} | {"important.log"}
    assert counts["skipped_ignored"] >= 4 and not counts["truncated"]
    assert {r["rel_path"] for r in scan.read(found).where("content is not null").collect()} == names
    assert scan.walk(str(tmp_path / "t"), max_files=2)[1]["truncated"]
    assert scan.walk(str(tmp_path / "missing"))[0] == []
    (tmp_path / "t" / ".indexignore").write_text("pkg/\n!other.log\n")
    more = {r[0] for r in scan.walk(str(tmp_path / "t"), ignore_files=(".gitignore", ".indexignore", ".absent"))[0]}
    assert more == names - {"pkg/__init__.py"} | {"other.log", ".indexignore"}


@pytest.mark.parametrize(
    ("path", "rules", "want"),
    [
        ("a.log", ["*.log", "!important.log"], True),
        ("important.log", ["*.log", "!important.log"], False),
        ("sub/keep.ts", ["sub/", "!sub/keep.ts"], True),
        ("sub", ["sub/"], False),
        ("x/y/z.md", ["x/**/z.md"], True),
        ("x/z.md", ["x/**/z.md"], True),
        ("q/x/z.md", ["x/*.md"], False),
        ("q/b1.c", ["b[0-9].c"], True),
        ("q/bx.c", ["b[!0-9].c"], True),
    ],
)
def test_ignore_patterns(spark, path, rules, want):
    assert spark.range(1).select(scan.ignored(F.lit(path), rules).alias("v")).first()["v"] is want


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id long, rel_path string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id long, rel_path string")
    m = {r["query_id"]: r for r in evaluate.metrics(ranked, expected, 10).collect()}
    assert (m[1]["hit"], m[1]["recall"], m[1]["rr"]) == (1, 0.5, 0.5)
    assert m[1]["ndcg"] == pytest.approx((1 / 1.584962501) / (1 + 1 / 1.584962501), abs=1e-6)
    assert (m[2]["hit"], m[2]["rr"], m[2]["ndcg"]) == (0, 0.0, 0.0)


def test_limits_and_groups(spark):
    assert [search.clamp_limit(x) for x in (None, 0, 500, 7)] == [50, 1, 200, 7]
    rows = spark.createDataFrame([("z", "a"), ("b", "a"), ("k", "new")], "key string, group string")
    got = {r["group"]: (r["rank"], r["keys"]) for r in status.setting_groups(rows, ["a", "c"]).collect()}
    assert got == {"a": (1, ["b", "z"]), "new": (3, ["k"])}
    tabs = spark.createDataFrame([("t1", "s1"), ("t2", None)], "tab string, session string")
    sessions = spark.createDataFrame([("s1", "/w")], "session string, directory string")
    assert {r["tab"]: r["directory"] for r in status.workspace_of(tabs, sessions, "/i").collect()} == {"t1": "/w", "t2": "/i"}


def test_top_k_of_queries_and_empty(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.top_k_per_query(points, points.where("vec_id = 0"), 2, 0.5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 1.0), (1, 0.707107)]
    assert search.top_k_per_query(points, points.limit(0), 2, 0.5).count() == 0


def test_scores_take_halves_away_from_zero(spark):
    """As F.round does: the second point's cosine is 77/128, which isn't a tie with 0.601562."""
    rows = [(1, [73.0, 96.0, 10.0, 9.0, 0.0]), (2, [77.0, 102.0, 7.0, 1.0, 1.0]), (3, [-77.0, 102.0, 7.0, 1.0, 1.0])]
    points, asked = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in search.top_k_per_query(points, asked, 3, -1.0).orderBy("rank").collect()]
    assert got == [(2, 0.601563), (1, 0.601562), (3, -0.601563)]
    one_by_one = search.scored(points, [1.0, 0.0, 0.0, 0.0, 0.0], "embedding")
    assert dict(got) == {r["vec_id"]: r["score"] for r in one_by_one.collect()}


def test_findings_by_hand(spark):
    """A gain in rank alone counts, a gain of .02 doesn't, small sets and lone strategies don't."""
    rows = [
        ("rank", "semantic", 12, 0.96, 0.70), ("rank", "fusion", 12, 0.96, 0.73), ("rank", "keyword", 12, 0.5, 0.4), ("rank", "names", 12, 0.5, 0.3),
        ("level", "semantic", 10, 0.95, 0.75), ("level", "fusion", 10, 0.97, 0.77), ("level", "names", 10, 0.97, 0.9),
        ("small", "semantic", 9, 1.0, 0.1), ("small", "fusion", 9, 1.0, 0.9),
        ("lone", "semantic", 50, 1.0, 0.1),
        ("none", "keyword", 10, 0.2, 0.2), ("none", "names", 10, 0.2, 0.2),
    ]
    got = {r["label"]: tuple(r)[1:] for r in evaluate.findings(spark.createDataFrame(rows, "label string, strategy string, n int, hit double, rr double")).collect()}
    assert got == {
        "rank": (12, 0.0, 0.03, True, 0.96, 0.5, True, True),
        "level": (10, 0.02, 0.02, False, 0.95, None, False, False),
        "none": (10, None, None, False, None, 0.2, True, False),
    }


def test_a_tree_is_expanded_by_levels(spark, tmp_path):
    """The same listing as one process gives, on a tree of some thousand files; a cut one, a bare one."""
    root = tmp_path / "tree"
    for i in range(12):
        for j in range(8):
            folder = root / f"p{i}" / ("node_modules" if j == 7 else f"q{j}") / "deep"
            folder.mkdir(parents=True)
            for k in range(30):
                (folder / (f"f{k}.py" if k % 5 else f"f{k}.log")).write_text("x" * (k % 4))
    (root / ".gitignore").write_text("q3/\nf11.py\n!f10.log\n")
    (root / "big.py").write_text("x" * 2000)
    (root / "p0" / "loop").symlink_to(root)
    (root / "p0" / "none").mkdir()
    want, told = scan.walk(str(root), max_bytes=1000)
    found, counts = scan.scan(spark, str(root), max_bytes=1000)
    assert sorted(map(tuple, found.collect())) == want and counts == told and len(want) > 1000
    cut, counts = scan.scan(spark, str(root), max_files=100)
    assert [r["rel_path"] for r in cut.orderBy("rel_path").collect()] == sorted(r[0] for r in scan.walk(str(root))[0])[:100] and counts["truncated"]
    assert scan.scan(spark, str(tmp_path / "missing"))[0].collect() == []
