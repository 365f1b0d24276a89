"""Chunking: files to line ranges, oversized-line segments, Markdown sections."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Chunk size, least size, least rest, tolerated size, and file kinds.
MOST, LEAST, REST, TOLERATED = 1000, 50, 200, 1150
MARKDOWN = (".md", ".markdown")
LINES_ONLY = (
    ".bash .bazel .bzl .build .gradle .ninja .sh .zsh .dart .elm .m .mm .ql .r .res .resi .sql .vb .yaml .yml .rst .scala .swift"
).split()

#: Characters of chunks that a task holds at a time.
HELD = 4 << 20

CHUNKS = "file_path string, ordinal int, start_line int, end_line int, type string, content string, length int, segment_hash string, file_hash string"


class Chunk(NamedTuple):
    start_line: int
    end_line: int
    type: str
    content: str
    start_char: int | None = None


def units(text: str) -> int:
    """Length in UTF-16 units, in which the sizes are defined."""
    return len(text) if text.isascii() or max(text, default="") <= "￿" else len(text.encode("utf-16-le")) // 2


def _cut(line: str) -> list[str]:
    if units(line) == len(line):
        return [line[k : k + MOST] for k in range(0, len(line), MOST)]
    data = line.encode("utf-16-le")
    return [data[k : k + 2 * MOST].decode("utf-16-le", "replace") for k in range(0, len(data), 2 * MOST)]


def by_lines(lines: list[str], kind: str = "fallback_chunk", base: int = 1) -> Iterator[Chunk]:
    """Greedy line ranges of up to TOLERATED units.

    Held lines always are a run that ends at the line before; ``label`` is the line at which the
    chunk is said to start.  When a short rest would follow, the chunk is said to end earlier and
    the next to start there, while its content stays the run: labels and content differ then, as
    stored indexes have it."""
    n = len(lines)
    sizes = [units(x) + 1 for x in lines]
    if n:
        sizes[-1] -= 1
    before = [0, *accumulate(sizes)]  # units of the lines before
    label = held = 0  # first label line; first held line

    def done(i: int, end: int) -> Iterator[Chunk]:
        if before[i] - before[held] >= LEAST:
            yield Chunk(base + label, base + end, kind, "\n".join(lines[held:i]))

    for i, size in enumerate(sizes):
        if size > TOLERATED:
            if held < i:
                yield from done(i, i - 1)
            for k, part in enumerate(_cut(lines[i])):
                yield Chunk(base + i, base + i, f"{kind}_segment", part, k * MOST)
            label = held = i + 1
            continue
        have = before[i] - before[held]
        if not have or have + size <= TOLERATED:
            continue
        end, rest = i - 1, before[n] - before[i]
        if have >= LEAST and rest < REST and i - held > 1:
            # The last line up to i - 2 after which at least REST units remain (the join counts
            # a line's end once more for the last line), if what comes before it is large enough.
            k = min(i - 2, bisect.bisect_right(before, before[n] + 1 - REST) - 2)
            head = before[k + 1] - before[label] if k >= label else 0
            if head >= LEAST:
                end = k
        yield from done(i, end)
        label, held = end + 1, i
    if held < n:
        yield from done(n, n - 1)


def markdown_heads(lines: list[str]) -> list[tuple[int, int]]:
    """(row, level) of each heading: # to ######, or a line underlined with = or -."""
    import re

    atx, under = re.compile(r"^(#{1,6})\s+(.+)$"), (re.compile(r"^={3,}\s*$"), re.compile(r"^-{3,}\s*$"))
    title = re.compile(r"^\s*[^#<>!\[\]`\t]+[^\n]$")
    heads = []
    for i, line in enumerate(lines):
        if m := atx.match(line):
            heads.append((i, len(m[1])))
        elif i and title.match(lines[i - 1]):
            heads += [(i - 1, level) for level, rule in enumerate(under, 1) if rule.match(line)]
    return sorted(heads, key=lambda x: x[0])


def by_sections(lines: list[str]) -> Iterator[Chunk]:
    """Markdown sections, from each heading to the line before the next; large ones by lines."""
    heads = markdown_heads(lines) if "".join(lines).strip() else []
    starts = [(0, "markdown_content"), *((row, f"markdown_header_h{level}") for row, level in heads)]
    if heads and heads[0][0] == 0:
        starts = starts[1:]
    for (row, kind), end in zip(starts, [*(r for r, _ in starts[1:]), len(lines)], strict=True):
        part = lines[row:end]
        whole = "\n".join(part)
        if units(whole.strip()) < LEAST:
            continue
        if units(whole) > TOLERATED or any(units(x) > TOLERATED for x in part):
            yield from by_lines(part, kind, row + 1)
        else:
            yield Chunk(row + 1, row + len(part), kind, whole)


def chunk_text(path: str, text: str) -> list[Chunk]:
    """The chunks of one file: by sections for Markdown, by lines else."""
    lines = text.split("\n")
    return list(by_sections(lines) if path.lower().endswith(MARKDOWN) else by_lines(lines))


def identity(path: str, c: Chunk) -> str:
    """The segment hash; see functions.text.segment_hash."""
    start = [] if c.start_char is None else [str(c.start_char)]
    parts = [path, str(c.start_line), str(c.end_line), *start, str(units(c.content)), c.content[: T.PREVIEW_CHARS]]
    return hashlib.sha256("-".join(parts).encode("utf-8", "replace")).hexdigest()


def chunk_files(files: DataFrame, by_syntax=None) -> DataFrame:
    """Chunks of ``files`` (rel_path, content), of each hash the first of a file.

    The fold over a file's lines is sequential, so it runs in Python on Arrow batches; files are
    independent, and nothing is shuffled.  ``by_syntax(path, text)`` may give chunks of files
    that aren't for lines only; what it can't do, or None, is cut by lines.  A task holds the chunks
    of HELD characters, and of one more file, before it hands them on."""

    names, kinds = zip(*(x.split() for x in CHUNKS.split(", ")), strict=True)

    def recorded(rows):
        types = {"string": pa.string(), "int": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for path, text in zip(*batch.columns, strict=True):  # one file's text at a time
                path, text = path.as_py(), text.as_py()
                if text is None:
                    continue
                if held > HELD:
                    yield recorded(rows)
                    rows, held = [], 0
                found = None
                if by_syntax and not path.lower().endswith((*LINES_ONLY, *MARKDOWN)):
                    try:
                        found = by_syntax(path, text)
                    except Exception:  # noqa: BLE001  a parser that fails leaves the lines
                        found = None
                seen, file_hash = set(), hashlib.sha256(text.encode()).hexdigest()
                for c in found or chunk_text(path, text):
                    key = identity(path, c)
                    if key not in seen:
                        seen.add(key)
                        held += len(c.content)
                        rows.append((path, len(seen) - 1, c.start_line, c.end_line, c.type, c.content, units(c.content), key, file_hash))
            if rows:
                yield recorded(rows)

    return files.select("rel_path", "content").mapInArrow(run, CHUNKS)


def segments(files: DataFrame) -> DataFrame:
    """Segments of oversized lines alone, in expressions: (rel_path, line, start_char, content)."""
    lines = F.posexplode(F.split("content", "\n", -1)).alias("row", "line")
    sized = files.select("rel_path", F.size(F.split("content", "\n", -1)).alias("n"), lines)
    long = sized.where(F.length("line") + F.when(F.col("row") < F.col("n") - 1, 1).otherwise(0) > TOLERATED)
    cut = long.select("rel_path", (F.col("row") + 1).alias("line_no"), "line", F.explode(F.sequence(F.lit(0), F.length("line") - 1, F.lit(MOST))).alias("start_char"))
    return cut.select("rel_path", "line_no", "start_char", F.substring("line", F.col("start_char") + 1, F.lit(MOST)).alias("content"))


def route(path: Column, has_text: Column) -> Column:
    """Which chunker a file takes."""
    extension = T.extension_of_path(path)
    return F.when(~has_text, "none").when(extension.isin(*MARKDOWN), "markdown").when(extension.isin(*LINES_ONLY), "lines").otherwise("syntax_or_lines")


def sections(files: DataFrame) -> DataFrame:
    """Markdown sections in relational form: (rel_path, start_line, end_line, level), level 0 for
    what comes before the first heading.  Each file is one row until its sections are, so nothing
    is shuffled; null contents have none."""

    def head(line: Column, i: Column) -> Column:
        atx = line.rlike(r"^#{1,6}\s+.+$")
        titled = F.coalesce(F.get("lines", i - 1).rlike(r"^\s*[^#<>!\[\]`\t]+[^\n]$"), F.lit(False))
        level = F.when(atx, F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))).when(titled & line.rlike(r"^={3,}\s*$"), 1).when(titled & line.rlike(r"^-{3,}\s*$"), 2)
        return F.struct(F.when(atx, i).otherwise(i - 1).alias("row"), level.alias("level"))

    lined = files.where("content is not null").select("rel_path", F.split("content", "\n", -1).alias("lines"))
    headed = lined.select("rel_path", F.size("lines").alias("n"), F.filter(F.transform("lines", head), lambda h: h["level"].isNotNull()).alias("heads"))
    first = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("level")))
    starts = F.when(F.exists("heads", lambda h: h["row"] == 0), F.col("heads")).otherwise(F.concat(first, F.col("heads")))
    placed = headed.select("rel_path", "n", starts.alias("starts"))
    following = lambda k: F.coalesce(F.get("starts", k + 1)["row"], F.col("n"))
    found = F.transform("starts", lambda s, k: F.struct((s["row"] + 1).alias("start_line"), following(k).alias("end_line"), s["level"].alias("level")))
    return placed.select("rel_path", F.inline(found))
