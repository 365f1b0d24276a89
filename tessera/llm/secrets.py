"""Secret scans through a trigram index, in DataFrame operations only."""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


class Rule(NamedTuple):
    """A kind of secret: a pattern that Python and Java read alike, the group whose length counts
    (0: the whole match), and the least length.  Matches are leftmost and don't overlap; those that
    are too short are dropped afterwards.

    A search that backtracks may try each letter of a long run as a beginning.  ``fast`` is a
    pattern that gives the same kept matches and goes over a run once; matches of it whose group
    ``must`` is empty aren't kept."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fast: str = ""
    must: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")

#: The base rules, then those the method adds.  Production parameters.
BASE = (
    Rule("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]++(\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+)?", 1),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("url", r"[a-z]+://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D@/]+@", 0, 12, r"(?<![a-z])[a-z]++://[A-Za-z0-9._%+-]++:[^\x20\x09-\x0D@/]++@"),
)
RULES = BASE + MORE

#: A pattern's part is followed as exact strings up to so many; beyond, only what it must hold is kept.
MOST_STRINGS = 64


class _Part(NamedTuple):
    """What is known of a part of a pattern.  exact: all strings that it can match, or None.
    starts, ends: sets with one of which any match begins or ends.  query: a set of conjunctions
    (of trigrams) of which one holds in any match; {empty} always holds."""

    exact: frozenset | None
    starts: frozenset
    ends: frozenset
    query: frozenset


_ANY = frozenset([frozenset()])
_EMPTY = _Part(frozenset([""]), frozenset([""]), frozenset([""]), _ANY)
_UNKNOWN = _Part(None, frozenset([""]), frozenset([""]), _ANY)


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(query: frozenset) -> frozenset:
    """Without conjunctions that hold more than another one."""
    return frozenset(q for q in query if not any(o < q for o in query))


def _both(a: frozenset, b: frozenset) -> frozenset:
    both = _least(frozenset(x | y for x, y in product(a, b)))
    return both if len(both) <= MOST_STRINGS else min(a, b, key=len)


def _one_of(strings: frozenset) -> frozenset:
    return _least(frozenset(map(_grams, strings)))


def _short(strings: frozenset, end: bool) -> frozenset:
    cut = frozenset(s[-2:] if end else s[:2] for s in strings)
    return cut if len(cut) <= MOST_STRINGS else frozenset([""])


def _joined(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        exact = frozenset(x + y for x, y in product(a.exact, b.exact))
        return _Part(exact, exact, exact, _one_of(exact))
    across = frozenset(x + y for x, y in product(a.exact or a.ends, b.exact or b.starts))
    query = _both(_both(a.query, b.query), _one_of(across) if len(across) <= MOST_STRINGS else _ANY)
    starts = frozenset(x + y for x, y in product(a.exact, b.starts)) if a.exact is not None else a.starts
    ends = frozenset(x + y for x, y in product(a.ends, b.exact)) if b.exact is not None else b.ends
    return _Part(None, _short(starts, False), _short(ends, True), query)


def _either_of(parts: list[_Part]) -> _Part:
    query = _least(frozenset().union(*(p.query for p in parts)))
    if all(p.exact is not None for p in parts):
        exact = frozenset().union(*(p.exact for p in parts))
        if len(exact) <= MOST_STRINGS:
            return _Part(exact, exact, exact, _one_of(exact))
    ends = [frozenset().union(*(x for p in parts for x in [(p.exact or p.starts) if side else (p.exact or p.ends)])) for side in (1, 0)]
    return _Part(None, _short(ends[0], False), _short(ends[1], True), query)


def _part(items) -> _Part:
    whole = _EMPTY
    for op, arg in items:
        if op is sre.LITERAL:
            c = frozenset([chr(arg).lower()])
            part = _Part(c, c, c, _ANY)
        elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            ranges = [(a, a) if o is sre.LITERAL else a for o, a in arg]
            if sum(hi - lo + 1 for lo, hi in ranges) <= MOST_STRINGS // 4:
                c = frozenset(chr(x).lower() for lo, hi in ranges for x in range(lo, hi + 1))
                part = _Part(c, c, c, _ANY)
            else:
                part = _UNKNOWN
        elif op is sre.SUBPATTERN:
            part = _part(arg[-1])
        elif op is sre.BRANCH:
            part = _either_of([_part(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            once = _part(inner)
            if (low, high) == (0, 1):
                part = _either_of([_EMPTY, once])
            elif low == 0:
                part = _UNKNOWN
            else:
                part = once if (low, high) == (1, 1) else _Part(None, _short(once.exact or once.starts, False), _short(once.exact or once.ends, True), once.query)
        else:
            part = _UNKNOWN
        whole = _joined(whole, part)
    return whole


def trigram_query(pattern: str) -> list[list[str]]:
    """The trigrams that a match of ``pattern`` must hold, in lower case, as a list of conjunctions
    of which one must hold; [[]] if the pattern has no mandatory trigrams, so all texts must be read."""
    return sorted(sorted(q) for q in _part(_parser.parse(pattern)).query)


def build_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index: postings (gram, id) of the trigrams that rules ask for, each once for
    a document, whole texts in lower case (A-Z).  ``docs`` has id and text."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.array_compact(F.array(*[F.when(F.contains("low_", F.lit(g)), F.lit(k)) for k, g in enumerate(vocabulary)]))
    return docs.withColumn("low_", low).select("id", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[list[str]]], vocabulary: list[str]) -> DataFrame:
    """Candidates (id, kinds): for each conjunction its trigrams' postings are intersected, and
    the conjunctions of a rule united.  Postings are dealt by document, so a trigram that all
    documents hold isn't brought together."""
    number = {g: k for k, g in enumerate(vocabulary)}
    clauses = [(kind, n, number[g], len(q)) for kind, query in queries.items() for n, q in enumerate(query) for g in q]
    asked = postings.sparkSession.createDataFrame(clauses, "kind string, clause int, gram int, need int")
    met = postings.join(F.broadcast(asked), "gram").groupBy("id", "kind", "clause").agg(F.count("*").alias("have"), F.first("need").alias("need"))
    return met.where("have = need").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, f) -> Column:
    """f(value), with ``value`` made once however often f uses it."""
    return F.transform(F.array(value), f)[0]


#: Matches whose places are summed up at a time; their number squared is what a sum costs.
TOGETHER = 256


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, size) of a rule's matches, in code points:
    lengths of the matches and of what lies between them are summed up, in blocks of matches."""
    pattern = rule.fast or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    if rule.must:
        sized = F.zip_with(sized, F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.must)), lambda s, m: F.when(F.length(m) > 0, s).otherwise(""))
    between = F.split(text, pattern, -1)
    met = _let(found, lambda f: F.zip_with(f, F.slice(between, 1, F.size(f)), lambda m, b: F.struct(F.length(m).alias("m"), F.length(b).alias("b"))))
    lengths = F.zip_with(met, sized, lambda x, s: F.struct(x["m"].alias("m"), x["b"].alias("b"), F.length(s).alias("s")))
    none = F.array().cast("array<struct<start:int,end:int,size:int>>")
    add = lambda a, x: F.struct(
        (a["at"] + x["b"] + x["m"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + x["b"]).alias("start"), (a["at"] + x["b"] + x["m"]).alias("end"), x["s"].alias("size")))).alias("out"),
    )

    def placed(all_: Column) -> Column:
        last = F.ceil(F.size(all_) / TOGETHER).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * TOGETHER + 1, F.lit(TOGETHER)))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["m"] + x["b"]))
        begun = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        whole = F.zip_with(blocks, begun, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"]))
        return F.when(last >= 0, F.flatten(whole)).otherwise(none)

    return F.filter(_let(lengths, placed), lambda x: x["size"] >= rule.least)


def scan(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """For each row of ``docs``: doc_id, a count n_<kind> for each base rule, base_sha256 of the
    base rules' spans, and spans, those of all rules, as kind:start:end.

    An index of the rules' mandatory trigrams gives candidates for each rule; a rule runs on its
    candidates only.  A rule without mandatory trigrams runs on every text.

    Null texts count as empty and give no spans.  Null ids, ids that repeat and repeated rows are
    told apart by nothing but (id, hash of the text), which is enough: rows that share both
    are equal.  Ties of start go by the order of the rules.  An empty table gives no rows; columns
    other than doc_id and text are ignored."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    identity = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.xxhash64("text").alias("h"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {k: q for k, q in queries.items() if [] not in q}
    vocabulary = sorted({g for q in queries.values() for c in q for g in c})
    postings = build_index(texts.select(identity.alias("id"), "text"), vocabulary)
    found = stored(candidates(postings.distinct(), queries, vocabulary), "secret-candidates")
    rows = texts.withColumn("id", identity).join(found, "id", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    columns = {}
    for k, rule in enumerate(rules):
        asked = F.array_contains(kinds, rule.kind) if rule.kind in queries else F.lit(True)
        # A plain search for one long enough match comes first: few texts have any.
        columns[f"s_{k}"] = F.when(asked & F.col("text").rlike(_quick(rule)), spans(F.col("text"), rule))
    rows = rows.select("doc_id", *[c.alias(n) for n, c in columns.items()])
    number = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    tagged = [F.coalesce(F.transform(f"s_{k}", number(k)), none) for k in range(len(rules))]
    names = F.array(*[F.lit(r.kind) for r in rules])
    told = lambda some: F.array_join(F.transform(F.sort_array(F.concat(*some)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n_base = len(base)
    return rows.select(
        "doc_id",
        *[F.coalesce(F.size(f"s_{k}"), F.lit(0)).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(base)],
        F.sha2(told(tagged[:n_base]), 256).alias("base_sha256"),
        told(tagged).alias("spans"),
    )


def _quick(rule: Rule) -> str:
    """A pattern that finds a match if the rule has one that is long enough: the fast one; or, where
    the pattern is literals and one final repeat, that with the repeat so long; else itself."""
    m = re.fullmatch(r"([A-Za-z]*)(\[[^\]]+\])\+", rule.pattern)
    if rule.fast or not m or rule.group:
        return rule.fast or rule.pattern
    return f"{m[1]}{m[2]}{{{max(1, rule.least - len(m[1]))},}}"
