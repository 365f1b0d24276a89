"""Syntax-aware chunks: a walk over captured nodes behind a seam for parsers, and Python's own parser."""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

from tessera.operators.chunk import LEAST, TOLERATED, Chunk, by_lines, units


class Node(NamedTuple):
    """A piece of a syntax tree; ``row`` counts from 0, ``children`` are in the order of the text."""

    kind: str
    row: int
    end_row: int
    text: str
    children: Callable[[], list[Node]]


#: A grammar takes a text and gives the captured nodes, in order of their beginnings.
Grammar = Callable[[str], list[Node]]


def walk(captured: list[Node]) -> Iterator[Chunk]:
    """Chunks of captured nodes, breadth first: small nodes go, large ones are replaced by their
    children, or cut by lines where they have none.  Captures that overlap are all kept."""
    waiting = deque(captured)
    while waiting:
        node = waiting.popleft()
        size = units(node.text)
        if size < LEAST:
            continue
        if size <= TOLERATED:
            yield Chunk(node.row + 1, node.end_row + 1, node.kind, node.text)
        elif parts := node.children():
            waiting.extend(parts)
        else:
            yield from by_lines(node.text.split("\n"), node.kind, node.row + 1)


#: Names of node kinds as stored indexes have them.
KINDS = {
    ast.ClassDef: "class_definition",
    ast.FunctionDef: "function_definition",
    ast.AsyncFunctionDef: "function_definition",
    ast.With: "with_statement",
    ast.AsyncWith: "with_statement",
    ast.Try: "try_statement",
    ast.TryStar: "try_statement",
    ast.Import: "import_statement",
    ast.arg: "typed_parameter",
    ast.ImportFrom: "import_from_statement",
}
_ASSIGNED = (ast.ListComp, ast.DictComp, ast.SetComp)


class _Source:
    """A text and the places of its rows; the parser counts columns in UTF-8 bytes."""

    def __init__(self, text: str):
        # The parser ends rows at these alone, so form feeds and the like stay within a row.
        self.rows = re.split("(?<=\n)|(?<=\r)(?!\n)", text)

    def node(self, kind: str, tree: ast.AST, children: Callable[[], list[Node]]) -> Node:
        first, last = tree.lineno - 1, tree.end_lineno - 1
        return self.cut(kind, first, tree.col_offset, last, tree.end_col_offset, children)

    def cut(self, kind: str, first: int, start: int, last: int, end: int, children: Callable[[], list[Node]]) -> Node:
        head, tail = self.rows[first].encode(), self.rows[last].encode()
        if first == last:
            text = head[start:end].decode()
        else:
            text = head[start:].decode() + "".join(self.rows[first + 1 : last]) + tail[:end].decode()
        return Node(kind, first, last, text, children)


def _typed(tree: ast.arguments) -> list[ast.arg]:
    """Parameters with a type and no default."""
    plain = [*tree.posonlyargs, *tree.args]
    plain = plain[: len(plain) - len(tree.defaults)] + [x for x, d in zip(tree.kwonlyargs, tree.kw_defaults, strict=True) if d is None]
    return [x for x in (*plain, tree.vararg, tree.kwarg) if x is not None and x.annotation is not None]


def _captured(source: _Source, tree: ast.AST) -> list[ast.AST]:
    """What is captured at a tree: itself, or the typed ones of parameters.  Of assigned lambdas
    those in parentheses are, which the tree doesn't have: they are in the text before the lambda."""
    if isinstance(tree, ast.arguments):
        return _typed(tree)
    if isinstance(tree, ast.AnnAssign):
        return [tree] if isinstance(tree.target, ast.Name) else []
    if not isinstance(tree, ast.Assign):
        return [tree] if type(tree) in KINDS and not isinstance(tree, ast.arg) else []
    if len(tree.targets) != 1 or not isinstance(tree.targets[0], ast.Name):
        return []
    if isinstance(tree.value, ast.Lambda):
        name, value = tree.targets[0], tree.value
        between = source.cut("", name.end_lineno - 1, name.end_col_offset, value.lineno - 1, value.col_offset, list).text
        return [tree] if "(" in between else []
    return [tree] if isinstance(tree.value, _ASSIGNED) else []


def _nodes(source: _Source, tree: ast.AST) -> list[Node]:
    """The node of a tree; a decorated definition is one node around the definition's own."""

    def children() -> list[Node]:
        parts = [x for x in ast.iter_child_nodes(tree) if hasattr(x, "lineno") and x not in getattr(tree, "decorator_list", [])]
        return [n for x in sorted(parts, key=lambda x: (x.lineno, x.col_offset)) for n in _nodes(source, x)[:1]]

    kind = KINDS.get(type(tree), "expression_statement" if isinstance(tree, (ast.Assign, ast.AnnAssign)) else type(tree).__name__.lower())
    own = source.node(kind, tree, children)
    if not getattr(tree, "decorator_list", None):
        return [own]
    first = tree.decorator_list[0]
    around = source.cut("decorated_definition", first.lineno - 1, first.col_offset - 1, tree.end_lineno - 1, tree.end_col_offset, lambda: [own])
    return [around, own]


def python_nodes(text: str) -> list[Node]:
    """Definitions, imports, with and try statements, parameters with a type, and assigned lambdas in
    parentheses, comprehensions and annotated names of a Python text, outer ones before inner ones."""
    source = _Source(text)
    tree = ast.parse(text)
    places = [x for at in ast.walk(tree) for x in _captured(source, at)]
    return sorted((n for x in places for n in _nodes(source, x)), key=lambda n: (n.row, -n.end_row))


def _python() -> Grammar:
    return python_nodes


#: How a grammar is loaded, by extension.  Other languages need a parser that isn't here.
LOADERS: dict[str, Callable[[], Grammar]] = {".py": _python, ".pyi": _python, ".pyw": _python}


@cache
def loaded(extension: str) -> Grammar | None:
    """An extension's grammar, loaded once a worker; None if there is none or it fails to load."""
    try:
        return LOADERS[extension]()
    except Exception:  # noqa: BLE001  a grammar that can't be loaded leaves the lines
        return None


def by_syntax(path: str, text: str) -> list[Chunk] | None:
    """Chunks of a file by its syntax, for chunk_files(); None leaves the file to the lines: without
    a grammar, and where nothing is captured.  A text that can't be parsed raises."""
    name = path.lower().rsplit("/", 1)[-1]
    grammar = loaded(name[name.rfind(".") :]) if "." in name else None
    captured = grammar(text) if grammar and text else []
    return list(walk(captured)) if captured else None
