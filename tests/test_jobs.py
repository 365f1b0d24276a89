"""The jobs: against SQL, over growing input, run again, broken off in between, and from the command line."""

import json
import os
import subprocess
import sys

import pytest

from jobs import quality_report, queries, refresh_chunks
from tessera.operators import chunk
from tessera.sources import shared

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_job_matches_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.fixture
def place(spark):
    return shared.fresh(spark, "job-test")


def add(spark, place, rows):
    """One more file of the input."""
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC).coalesce(1).write.mode("append").parquet(f"{place}/in")


def run(spark, place, **config):
    return refresh_chunks.run(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint", config)


def chunks(spark, place):
    rows = refresh_chunks.current(spark, f"{place}/out").collect()
    return sorted((r["rel_path"], r["ordinal"], r["content"], r["segment_hash"]) for r in rows)


def wanted(texts):
    """Chunks of {path: text} by the plain function."""
    return sorted((p, n, c.content, chunk.identity(p, c)) for p, t in texts.items() for n, c in enumerate(chunk.chunk_text(p, t)))


def body(word):
    return "\n".join(f"{word} line {i} of a file" for i in range(60))


def test_growing_input(spark, place):
    add(spark, place, [(1, body("one"), "a"), (2, body("two"), "a"), (3, body("three"), None)])
    first = run(spark, place)
    assert [(b.rows, b.changed, b.deleted) for b in first] == [(3, 3, 0)] and first[0].chunks == len(chunks(spark, place))
    assert chunks(spark, place) == wanted({"a/en/1.txt": body("one"), "a/en/2.txt": body("two"), "_/en/3.txt": body("three")})
    assert run(spark, place) == []  # nothing is new

    # One is as it was, one has changed, one goes, one is new, and one names no file.
    add(spark, place, [(1, body("one"), "a"), (2, body("again"), "a"), (3, None, None), (4, body("four"), "b"), (None, "lost", "b")])
    second = run(spark, place)
    assert [(b.rows, b.without_id, b.changed, b.deleted) for b in second] == [(5, 1, 3, 1)]
    assert chunks(spark, place) == wanted({"a/en/1.txt": body("one"), "a/en/2.txt": body("again"), "b/en/4.txt": body("four")})
    assert run(spark, place) == []

    add(spark, place, [(3, body("back"), None)])
    assert [b.changed for b in run(spark, place)] == [1]
    assert len(chunks(spark, place)) == len(wanted({"a/en/1.txt": body("one"), "a/en/2.txt": body("again"), "b/en/4.txt": body("four"), "_/en/3.txt": body("back")}))


def test_one_run_equals_many(spark, place):
    files = [[(i, body(f"w{i}"), "hot" if i % 3 else "s") for i in range(k, k + 6)] for k in (0, 4, 8)]
    for f in files:
        add(spark, place, f)
        run(spark, place)
    other = shared.fresh(spark, "job-test")
    for f in files:
        add(spark, other, f)
    assert len(run(spark, other, max_files_per_trigger=1)) == 3
    assert chunks(spark, place) == chunks(spark, other) and chunks(spark, place)


def test_a_batch_that_broke_off_is_repeated(spark, place, monkeypatch):
    """The chunks were written, the manifest wasn't: the next run writes both again."""
    add(spark, place, [(1, body("one"), "a")])
    run(spark, place)
    add(spark, place, [(1, body("changed"), "a"), (2, body("two"), "b")])
    write = refresh_chunks._write

    def broken(df, path, *by):
        if path.endswith("manifest"):
            raise RuntimeError("lost")
        write(df, path, *by)

    monkeypatch.setattr(refresh_chunks, "_write", broken)
    with pytest.raises(Exception, match="lost"):
        run(spark, place)
    monkeypatch.undo()
    assert chunks(spark, place) == wanted({"a/en/1.txt": body("one")})  # the old state is whole
    assert [(b.batch_id, b.changed) for b in run(spark, place)] == [(1, 2)]
    assert chunks(spark, place) == wanted({"a/en/1.txt": body("changed"), "b/en/2.txt": body("two")})


def test_rows_of_one_path(spark, place):
    """In one file the largest hash counts; a deletion counts only where nothing else is there."""
    add(spark, place, [(1, body("x"), "a"), (1, body("y"), "a"), (1, None, "a"), (2, "", "a"), (3, None, "a")])
    run(spark, place)
    last = max((body("x"), body("y")), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert chunks(spark, place) == wanted({"a/en/1.txt": last})


def test_nothing_was_written_yet(spark, place):
    assert refresh_chunks.current(spark, f"{place}/out").collect() == []
    add(spark, place, [])
    add(spark, place, [(None, "names no file", "a")])
    assert [(b.rows, b.changed) for b in run(spark, place, max_files_per_trigger=1)] == [(0, 0), (1, 0)] and chunks(spark, place) == []
    add(spark, place, [(1, body("one"), "a"), (2, None, "a")])
    assert [(b.rows, b.changed) for b in run(spark, place)] == [(2, 1)]
    add(spark, place, [(1, body("one"), "a")])
    assert [(b.rows, b.changed, b.chunks) for b in run(spark, place)] == [(1, 0, 0)]
    assert chunks(spark, place) == wanted({"a/en/1.txt": body("one")})


DOCS = [
    (1, "the parser reads tokens of a stream and builds a tree of nodes", "parser"),
    (2, "tokens tokens tokens everywhere", "other"),
    (3, None, "parser"),
    (None, "the parser reads tokens", None),
    (4, "nothing to see here", None),
]


def test_report_by_hand(spark, place):
    add(spark, place, DOCS)
    passages = [(1, "parser reads tokens of a stream"), (2, "in no file at all"), (3, None), (None, "tokens")]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{place}/queries")
    settings = spark.conf.get("spark.sql.sources.partitionOverwriteMode")

    def rows():
        quality_report.run(spark, f"{place}/in", f"{place}/queries", f"{place}/out", {"short_words": 3})
        read = [sorted(map(tuple, spark.read.parquet(f"{place}/out/{t}").collect()), key=repr) for t in ("rankings", "measures", "summary")]
        return [sorted(map(tuple, quality_report.report(spark, f"{place}/out").collect()), key=repr), *read]

    first = rows()
    assert rows() == first and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == settings
    ranked = {(r[0], r[2]): r[3] for r in first[0] if r[1] == 1}
    assert ranked["keyword", "parser/en/1.txt"] == 1 and ranked["keyword", "other/en/2.txt"] == 2 and ranked["names", "parser/en/1.txt"] == 1
    assert {r[0]: r[4:] for r in first[0] if r[1] == 1 and r[2] == "parser/en/1.txt"} == dict.fromkeys(("keyword", "names", "fusion"), ("long", 1, 1.0, 1.0, 1.0))
    assert all(r[5] is None for r in first[0] if r[1] == 2)  # no file is right, so nothing is measured
    assert {(r[-1], r[0]): r[1] for r in first[3]} == {(s, t): 1 for s in ("keyword", "names", "fusion") for t in (None, "long")}


def test_command_line(spark, place):
    """Both jobs in processes of their own, twice; the configuration is a file."""
    add(spark, place, [(i, body(f"w{i}"), "a") for i in range(3)])
    spark.createDataFrame([(1, "w1 line 3 of")], "item_id long, text string").write.parquet(f"{place}/queries")

    def call(job, *args):
        said = subprocess.run(
            [sys.executable, f"{ROOT}/jobs/{job}.py", "--config", f"file://{ROOT}/jobs/{job}.json", *args], cwd="/", capture_output=True, text=True, timeout=240, check=True,
            env=os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"},
        )
        return said.stderr

    args = ("--input", f"{place}/in", "--output", f"{place}/out", "--checkpoint", f"{place}/checkpoint")
    assert "3 rows read" in call("refresh_chunks", *args)
    assert "0 batches, 0 rows read" in call("refresh_chunks", *args)
    assert len({r[0] for r in chunks(spark, place)}) == 3
    said = call("quality_report", "--documents", f"{place}/in", "--queries", f"{place}/queries", "--output", f"{place}/report")
    assert "1 queries in" in said and spark.read.parquet(f"{place}/report/summary").where("type IS NULL AND hit = 1").count() >= 1
    assert set(json.load(open(f"{ROOT}/jobs/refresh_chunks.json"))) == set(refresh_chunks.DEFAULTS)
