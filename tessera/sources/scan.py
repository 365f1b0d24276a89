"""Scanning a tree of files: pruning, ignore patterns, predicates, limits."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import fresh, written

#: What a scan never enters or reads.
IGNORED_DIRS = (
    ".git node_modules vendor dist build out target bin obj .next .nuxt .cache coverage __pycache__ .venv venv .idea .vs .gradle .terraform .turbo .parcel-cache"
).split()
ALLOWED_DOT_DIRS = ".github .vscode .gitlab .devcontainer".split()
IGNORED_GLOBS = "*.min.js *.min.css *.map *.lock package-lock.json *.log *.snap *.generated.*".split()
BINARY = (
    ".avif .bmp .class .db .dll .dylib .eot .exe .flac .gif .gz .ico .jar .jpeg .jpg .mkv .mov .mp3 .mp4 .o .ogg .otf .parquet .pdf .png .pyc .pyo .rar .so .sqlite .tar .tiff .ttf .wav .webm .webp .woff .woff2 .zip"
).split()
MAX_BYTES = 1 << 20
FILES = "rel_path string, abs_path string, size long, mtime_ms double"


class Pattern(NamedTuple):
    """An ignore pattern, compiled: a regular expression of whole paths, whether it takes back what
    earlier ones ignored, and whether it is for folders only."""

    regex: str
    negated: bool
    folders: bool


def compiled(pattern: str) -> Pattern | None:
    """None for comments and blanks.  A pattern with a slash inside is anchored at the root; others
    match at any depth.  * and ? stay within a segment; **/ crosses them; [..] is a set."""
    text = pattern.rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    folders = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    tokens = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = "".join(
        tokens[t] if t in tokens else (("[^" + t[2:] if t[1] in "!^" else t) if len(t) > 2 and t[0] == "[" else re.escape(t))
        for t in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", text, re.S)
    )
    return Pattern(f"^{'' if anchored else '(?:.*/)?'}{out}$", negated, folders)


def ignored(path: Column, patterns: list[str], is_dir: bool = False) -> Column:
    """Whether a path is ignored: the last pattern that matches decides, and what lies in an ignored
    folder stays ignored, whatever a later pattern takes back."""
    rules = [p for p in map(compiled, patterns) if p]
    parts = T.path_segments(path)

    def verdict(p: Column, folder: Column) -> Column:
        last = F.greatest(F.lit(0), F.lit(0), *[F.when(p.rlike(r.regex) & (folder if r.folders else F.lit(True)), F.lit(k + 1)).otherwise(F.lit(0)) for k, r in enumerate(rules)])
        taken_back = [k + 1 for k, r in enumerate(rules) if r.negated]
        return (last > 0) & ~(last.isin(taken_back) if taken_back else F.lit(False))

    above = F.sequence(F.lit(1), F.size(parts) - 1)
    in_ignored = F.when(F.size(parts) > 1, F.exists(above, lambda n: verdict(F.array_join(F.slice(parts, 1, n), "/"), F.lit(True)))).otherwise(F.lit(False))
    return in_ignored | verdict(F.array_join(parts, "/"), F.lit(is_dir))


def pruned(path: Column) -> Column:
    """Whether a path lies in a folder that scans don't enter."""
    folders = F.transform(F.slice(T.path_segments(path), 1, F.greatest(F.size(T.path_segments(path)) - 1, F.lit(0))), lambda s: F.lower(s))
    dotted = F.exists(folders, lambda s: F.startswith(s, F.lit(".")) & ~s.isin(ALLOWED_DOT_DIRS))
    return F.exists(folders, lambda s: s.isin(IGNORED_DIRS)) | dotted


def verdict(path: Column, size: Column, patterns: list[str], extensions: list[str] | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """What becomes of a file; the first reason that holds is the one that is counted."""
    extension = T.extension_of_name(path)
    wanted = extension.isin(extensions) if extensions else ~extension.isin(BINARY)
    return (
        F.when(pruned(path), "pruned")
        .when(F.coalesce(size, F.lit(0)) <= 0, "empty")
        .when(ignored(path, patterns), "ignored")
        .when(~wanted, "unwanted")
        .when(size > max_bytes, "too_large")
        .otherwise("kept")
    )


def looks_like_text(content: Column) -> Column:
    """No NUL among the first 1,024 characters."""
    return F.instr(F.substring(content, 1, 1024), "\0") == 0


#: Files of patterns that are read unless others are named.
IGNORE_FILES = (".gitignore",)


class Rules(NamedTuple):
    """What a walk takes: compiled patterns, extensions (None: all but BINARY), and the largest size."""

    patterns: list
    extensions: list[str] | None
    max_bytes: int

    def out(self, path: str, folder: bool) -> bool:
        last = [r for r in self.patterns if (folder or not r.folders) and re.match(r.regex, path, re.S)]
        return bool(last) and not last[-1].negated


def _rules(root: str, patterns, extensions, max_bytes: int, ignore_files: tuple[str, ...]) -> Rules:
    return Rules([p for p in map(compiled, [*IGNORED_GLOBS, *_own_patterns(root, ignore_files), *patterns]) if p], extensions, max_bytes)


def _entries(folder: str, prefix: str, rules: Rules) -> Iterator[tuple]:
    """(kind, rel_path, abs_path, size, mtime_ms) of what a folder holds, by name: file, folder,
    ignored or too_large.  Links, empty files and unwanted ones aren't told of; neither is a folder
    that can't be read."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{prefix}{e.name}"
        if e.is_symlink():
            continue
        if e.is_dir():
            low = e.name.lower()
            pruned_ = low in IGNORED_DIRS or (low.startswith(".") and low not in ALLOWED_DOT_DIRS) or rules.out(path, True)
            yield "ignored" if pruned_ else "folder", path, e.path, 0, 0.0
            continue
        stat = e.stat()
        if not e.is_file() or not stat.st_size:
            continue
        if rules.out(path, False):
            yield "ignored", path, e.path, 0, 0.0
            continue
        extension = os.path.splitext(e.name)[1].lower()
        if (extension not in rules.extensions) if rules.extensions else (extension in BINARY):
            continue
        yield "too_large" if stat.st_size > rules.max_bytes else "file", path, e.path, stat.st_size, stat.st_mtime_ns / 1e6


def walk(root: str, patterns: list[str] = (), extensions: list[str] | None = None, max_bytes: int = MAX_BYTES, max_files: int | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> tuple[list[tuple], dict]:
    """Files under ``root`` and what was skipped, in this process.  ``ignore_files`` name files at the root whose lines
    are patterns, those of later files after those of earlier ones.  Folders are pruned before they are entered, links
    aren't followed, a missing root is empty.  ``truncated`` is set once max_files are found."""
    rules = _rules(root, patterns, extensions, max_bytes, ignore_files)
    counts = {"skipped_ignored": 0, "skipped_too_large": 0, "truncated": False}
    found: list[tuple] = []

    def visit(folder: str, prefix: str) -> bool:
        for kind, path, *rest in _entries(folder, prefix, rules):
            if kind == "folder":
                if not visit(rest[0], f"{path}/"):
                    return False
            elif kind == "file":
                found.append((path, *rest))
                if max_files and len(found) >= max_files:
                    counts["truncated"] = True
                    return False
            else:
                counts[f"skipped_{kind}"] += 1
        return True

    visit(root, "")
    return sorted(found), counts


def _own_patterns(root: str, names: tuple[str, ...]) -> list[str]:
    lines: list[str] = []
    for name in names:
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
        except OSError:
            pass
    return lines


LISTED = "kind string, rel_path string, abs_path string, size long, mtime_ms double"


def scan(spark: SparkSession, root: str, patterns: list[str] = (), extensions: list[str] | None = None, max_bytes: int = MAX_BYTES, max_files: int | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> tuple[DataFrame, dict]:
    """(files, counts): what ``walk`` finds, as a DataFrame.

    The tree is expanded by levels: the folders of one level are listed by tasks, and the folders
    that they hold are the next level.  Each level is written, so the driver has counts alone.  The
    tree must be mounted on all workers.  Of a listing that is cut to ``max_files`` the first by
    path stay."""
    import pandas as pd

    rules, width = _rules(root, patterns, extensions, max_bytes, ignore_files), spark.sparkContext.defaultParallelism

    def listed(frames):
        for f in frames:
            rows = [row for folder, path in zip(f["abs_path"], f["rel_path"], strict=True) for row in _entries(folder, f"{path}/" if path else "", rules)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LISTED.split(", ")])

    base, levels = fresh(spark, "scan"), []
    folders = spark.createDataFrame([("folder", "", root, 0, 0.0)], LISTED)
    while not folders.isEmpty():
        levels.append(f"{base}/{len(levels)}")
        written(folders.repartition(width, "rel_path").mapInPandas(listed, LISTED), levels[-1])
        folders = spark.read.schema(LISTED).parquet(levels[-1]).where("kind = 'folder'")
    whole = spark.read.schema(LISTED).parquet(*levels)
    n = {r["kind"]: r["n"] for r in whole.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    files = whole.where("kind = 'file'").drop("kind")
    counts = {f"skipped_{k}": n.get(k, 0) for k in ("ignored", "too_large")} | {"truncated": bool(max_files) and n.get("file", 0) >= max_files}
    if max_files:
        files = files.orderBy("rel_path").limit(max_files)
    return files.repartition(max(width, n.get("file", 0) // 4096), "rel_path"), counts


def read(files: DataFrame) -> DataFrame:
    """``files`` with content; files that can't be read have null.  The folder must be mounted on all
    workers.  Spark's own file source isn't used, as it hides names that begin with . or _."""
    import pandas as pd

    def load(frames):
        for f in frames:
            texts = []
            for path in f["abs_path"]:
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as g:
                        texts.append(g.read())
                except OSError:
                    texts.append(None)
            yield pd.DataFrame(f.assign(content=texts))

    return files.mapInPandas(load, f"{FILES}, content string")
