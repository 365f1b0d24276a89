"""A Merkle manifest of a dataset: every document's leaf, its authentication path and the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, stored

#: Children of a node, and the fields that a leaf commits to, in order.
ARITY, FIELDS = 3, ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of an aligned block, which one task walks: 3 ** 7 = 2,187 leaves.
HEIGHT = 7
PATH = "array<struct<left string, right string>>"
_LINK = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf(**instead: Column) -> Column:
    """SHA-256 in lowercase hex of a document's fields: `-` for null, else byte count, `:` and value.
    ``instead`` names columns to take in place of fields."""

    def part(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(part, FIELDS)), 256)


def digest(*parts: str) -> str:
    """A node: SHA-256 in hex of its children's hex digests, one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` leaves: runs of three become one node while several remain."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


class TreeHash:
    """A stack that takes leaves from ``start`` on, one at a time, and makes the nodes of one run at
    ``level``.  It holds at most two nodes a level below, as a third closes the run."""

    def __init__(self, leaves: list[str], start: int, level: int):
        self.leaves, self.at, self.level = leaves, start, level
        self.end = min(start + ARITY ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    @property
    def done(self) -> bool:
        return self.at >= self.end

    @property
    def tail(self) -> int:
        """The lowest level that holds a node, the own level if none does."""
        return next((k for k, run in enumerate(self.stack) if run), self.level)

    @property
    def held(self) -> int:
        return len(self.nodes) + sum(map(len, self.stack))

    def _add(self, node: str, level: int) -> None:
        while level < self.level:
            run = self.stack[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, level = digest(*run), level + 1
            run.clear()
        self.nodes.append(node)

    def advance(self) -> None:
        """Take one leaf; after the last leaf of all, runs that aren't full are closed as they are."""
        self._add(self.leaves[self.at], 0)
        self.at += 1
        if self.at == len(self.leaves):
            for level, run in enumerate(self.stack):
                if run:
                    node = digest(*run)
                    run.clear()
                    self._add(node, level + 1)


class Traversal:
    """Paths of a block's leaves from left to right, ``height`` levels each.

    At each level it keeps the run that the current leaf lies under, and a TreeHash that makes the
    run after it.  Each leaf pays for one step a level, and a step goes to the TreeHash whose
    lowest node is lowest (of equal ones the lowest level), so that few stacks are open at once and
    what is held stays in proportion to the height.  ``most`` is the largest number of digests held."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height, self.most = leaves, height, 0
        self.runs: list[list[str]] = []
        for level in range(height):  # the first run of each level
            first = TreeHash(leaves, 0, level)
            while not first.done:
                first.advance()
            self.runs.append(first.nodes)
        self.ahead = [self._next(0, level) for level in range(height)]

    def _next(self, at: int, level: int) -> TreeHash | None:
        start = at + ARITY ** (level + 1)
        return TreeHash(self.leaves, start, level) if start < len(self.leaves) else None

    def root(self) -> str:
        """The block's node: that of the top level's only run, or the leaf itself."""
        return digest(*self.runs[-1]) if self.height else self.leaves[0]

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf its siblings, level by level: those to the left and those to the right."""
        for i in range(len(self.leaves)):
            path, node = [], i
            for run in self.runs:
                at = node % ARITY
                path.append(("".join(run[:at]), "".join(run[at + 1 :])))
                node //= ARITY
            yield path
            self._step()
            self._turn(i + 1)

    def _step(self) -> None:
        for _ in range(self.height):
            open_ = [t for t in self.ahead if t is not None and not t.done]
            if not open_:
                break
            min(open_, key=lambda t: (t.tail, t.level)).advance()
        self.most = max(self.most, sum(map(len, self.runs)) + sum(t.held for t in self.ahead if t is not None))

    def _turn(self, at: int) -> None:
        """At the first leaf of a run, take the run that was made ahead and begin the one after it."""
        for level in range(self.height):
            if at % ARITY ** (level + 1):
                break
            made = self.ahead[level]
            if made is not None:
                while not made.done:
                    made.advance()
                self.runs[level] = made.nodes
            self.ahead[level] = self._next(at, level)


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (tree, digest, and the columns of ``order``) with pos, their place in their tree by
    ``order``, and n, the tree's nodes.

    One range sort over all trees, so a tree of any size is spread over tasks; places are counted by
    range, and a tree's ranges are no more than the shuffle's."""
    keys = ["tree", *(F.col(c).asc_nulls_first() for c in order)]
    dealt = nodes.repartitionByRange(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = stored(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "merkle-ranked")
    runs = rows.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return rows.join(runs, ["tree", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _block(height: int) -> Column:
    return F.expr(f"pos div {ARITY**height}").alias("block")


def _sorted(table: pa.Table, most: int) -> tuple[pa.Table, list[str], int]:
    """A block's rows and digests in order, and its height: ``most``, or less where its tree ends."""
    table = table.sort_by("pos")
    return table, table["digest"].to_pylist(), min(most, levels(table["n"][0].as_py()))


def folded(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes (tree, pos, n, digest) ``most`` levels above ``nodes``, or fewer where a tree ends."""

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        _, run, height = _sorted(table, most)
        for _ in range(height):
            run = [digest(*run[k : k + ARITY]) for k in range(0, len(run), ARITY)]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-table["n"][0].as_py() // ARITY**most)], "digest": run})

    rows = nodes.select("tree", "pos", "n", "digest", _block(most))
    return rows.groupBy("tree", "block").applyInArrow(fold, "tree string, pos long, n long, digest string")


def climbed(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest), the nodes ``height`` levels above, and so on to one a tree."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(stored(folded(found[-1], height), "merkle-nodes"))
        most = -(-most // ARITY**height)
    return found


def _walker(own: list[str], given: list[str], most: int):
    """Makes the rows of a block, columns ``own``, with their paths and the ``given`` columns of the
    one row of the other side, which has the path above the block."""

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        table, leaves, height = _sorted(left, most)
        above = [(x["left"], x["right"]) for x in right["path"][0].as_py()]
        lefts, rights = [], []
        for path in Traversal(leaves, height):
            for a, b in (*path, *above):
                lefts.append(a)
                rights.append(b)
        each = height + len(above)
        links = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_LINK))
        path = pa.ListArray.from_arrays(pa.array([each * i for i in range(len(leaves) + 1)], pa.int32()), links)
        shared = {c: pa.array([right[c][0].as_py()] * len(leaves), right[c].type) for c in given}
        return pa.table({c: table[c] for c in own} | {"path": path} | shared)

    return walk


def descended(found: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """``found[0]`` with path: each node's siblings up to its tree's root, then the path of ``tops``
    (tree, path, and columns that every node of the tree is given).

    Blocks of a level walk their own levels leaf by leaf and append the path of their root, which
    all of a block share and which is sent to it once."""
    given = [f for f in tops.schema if f.name not in ("tree", "path")]
    upper = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(found) - 1, -1, -1):
        nodes = found[k]
        if k == len(found) - 1:  # one node a tree: its path is that of the top
            upper = nodes.join(upper.drop("pos"), "tree")
            continue
        own = nodes.schema.fields
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", path {PATH}"
        schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in given)
        shared = upper.select("tree", F.col("pos").alias("block"), "path", *(f.name for f in given))
        upper = nodes.withColumn("block", _block(height)).groupBy("tree", "block").cogroup(shared.groupBy("tree", "block")).applyInArrow(_walker([f.name for f in own], [f.name for f in given], height), schema)
    return upper


def manifest(docs: DataFrame, height: int = HEIGHT, **carried: Column) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, path, subroot, root, and ``carried`` columns.

    path lists, level by level from the leaf to the root, the digests to the left and to the right
    of the own one in its run; ``verified`` folds it.  Each source is a tree of its rows in order of
    doc_id, and the sources' roots are the leaves of the top tree, in order of source: null first,
    then by the bytes of UTF-8.

    Null ids come first; rows of one id are in order of their leaves, and rows that are equal are
    leaves each.  Nulls in fields differ from empty texts.  A source of one row is its leaf; an
    empty table gives no rows; other columns are ignored.  A task walks blocks of 3 ** ``height``
    leaves, which changes nothing but the work's division."""
    tree = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    rows = docs.select("doc_id", tree.alias("tree"), leaf().alias("digest"), F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in carried.items()))
    sources = climbed(ranked(stored(rows, "merkle-leaves"), "doc_id", "digest", "row"), height)
    roots = sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_"), "digest")
    tops = climbed(ranked(roots, "source_"), height)
    root = tops[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    top = stored(descended(tops, root, height).select(F.col("source_").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    found = descended(sources, top, height)
    return found.select("doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", *carried)


def folded_root(start: Column, path: Column) -> Column:
    """The root that ``path`` gives with ``start`` as the leaf."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def audited(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` held against copies of which some have lost their line breaks: those
    where the CRC-32 of the decimal id is even.  One without an id isn't changed.  verified says
    whether the copy's leaf and the original path lead to the root."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    copy = F.when(even, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf())
    found = manifest(docs, height, copied_=copy).withColumn("folded_root", folded_root(F.col("copied_"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
