"""Golden values of the chunkers, and what must hold of any chunking."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunk


def sizes(lines):
    return [(c.start_line, c.end_line, len(c.content)) for c in chunk.by_lines(lines)]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["x" * 99] * 30, [(1, 11, 1099), (12, 22, 1099), (23, 30, 799)]),
        (["a" * 2500], [(1, 1, 1000), (1, 1, 1000), (1, 1, 500)]),
        (["w" * 2001], [(1, 1, 1000), (1, 1, 1000), (1, 1, 1)]),
        (["a" * 1200, "b" * 100, "c" * 100], [(1, 1, 1000), (1, 1, 200), (2, 3, 201)]),
        (["a" * 570, "b" * 570, "c" * 50, "d" * 50], [(1, 1, 1141), (2, 4, 101)]),
        (["const x = 1", ""], []),
        ([""], []),
    ],
)
def test_golden(lines, want):
    assert sizes(lines) == want


def test_last_short_line_joins():
    assert [x[:2] for x in sizes(["a" * 600, "b" * 560, "c" * 30])] == [(1, 1), (2, 3)]


def test_segments_are_marked():
    kinds = [c.type for c in chunk.by_lines(["a" * 2500])]
    assert kinds == ["fallback_chunk_segment"] * 3


@given(st.lists(st.integers(0, 1400), max_size=40))
@settings(max_examples=200, deadline=None)
def test_sizes_hold(lengths):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab ") for _ in range(n)) for n in lengths]
    for c in chunk.by_lines(lines):
        assert len(c.content) <= 1150
        if c.start_char is None:
            assert len(c.content) >= 49
            assert c.start_line <= c.end_line


def test_markdown():
    text = "# Title\n\n" + "a " * 40 + "\n\n## Section\n\n" + "b " * 40
    found = chunk.chunk_text("x.md", text)
    assert [(c.type, c.start_line) for c in found] == [("markdown_header_h1", 1), ("markdown_header_h2", 5)]
    assert [c.type for c in chunk.chunk_text("x.md", "plain words " * 10)] == ["markdown_content"]
    under = "Title here\n===\n" + "c " * 60
    assert [c.type for c in chunk.chunk_text("x.md", under)] == ["markdown_header_h1"]


def test_carriage_returns_stay():
    (c,) = chunk.chunk_text("a.txt", "x" * 60 + "\r\n" + "y" * 10)
    assert c.content == "x" * 60 + "\r\n" + "y" * 10


def test_astral_characters_count_twice():
    parts = list(chunk.by_lines(["😀" * 600]))
    assert [chunk.units(c.content) for c in parts] == [1000, 200]


def test_chunk_files(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n" * 40), ("empty.txt", ""), ("none.txt", None)], "rel_path string, content string")
    rows = chunk.chunk_files(files).collect()
    assert {r["file_path"] for r in rows} == {"a.py"}
    calls = chunk.chunk_files(files, by_syntax=lambda p, t: [chunk.Chunk(1, 2, "assignment", t)]).collect()
    assert [r["type"] for r in calls if r["file_path"] == "a.py"] == ["assignment"]

    def fails(path, text):
        raise ValueError(path)

    assert chunk.chunk_files(files, by_syntax=fails).count() == len(rows)


def test_identity_agrees_with_the_expression(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as T

    c = chunk.Chunk(3, 7, "x", "some content " * 20)
    row = spark.range(1).select(T.segment_hash(F.lit("a/b.py"), F.lit(3), F.lit(7), F.lit(c.content)).alias("h")).first()
    assert row["h"] == chunk.identity("a/b.py", c)


def test_a_task_hands_chunks_on_as_it_goes():
    """However large a batch of files is, chunks of HELD characters and one file's are held at most."""

    class Listing:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = chunk.chunk_files(Listing())
    text = "\n".join(["# head", "word " * 150] * 1400)
    batch = pa.RecordBatch.from_pydict({"rel_path": [f"f{k}.md" for k in range(12)], "content": [text] * 11 + [None]})
    sizes = [sum(len(x) for x in b.column(5).to_pylist()) for b in run(iter([batch]))]
    assert len(sizes) > 1 and max(sizes) <= chunk.HELD + len(text) and sum(sizes) > 8 << 20
