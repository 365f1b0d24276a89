"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, words

#: The characters that count as symbols, and frequent words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the a of and to in is that it for on with as was at by "
    "der die das und ist in zu den von mit ein eine auf für "
    "le la les de des et un une est que en du pour dans "
    "el los las y del que en por con para se un una"
)


class Rule(NamedTuple):
    """A document fails the rule if ``ratio`` is under ``least`` or over ``most``."""

    ratio: str
    least: float | None
    most: float | None


#: Production thresholds.  The base rules are exact integer comparisons; see BASE.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("dup_lines_share", None, 0.5),
    Rule("stop_words_share", 0.04, None),
)
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Up to so many repeated windows of a text are searched one by one.
FEW = 12


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
HELPERS = ("w_", "n_", "l_", "h_", "s_", "dups_", "z_", "m_")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules use.  Each step is a projection; nothing is shuffled.

    Windows of three words are compared by a 64-bit hash.  Sorted hashes show which occur twice.
    Most texts have few such hashes, and a plain search finds their places.  Texts with more sort
    (hash, place) and compare neighbours, so that no text costs the square of its length."""
    text, w, z = F.col("text"), F.col("w_"), F.col("z_")
    without = lambda chars: F.length(F.translate(text, chars, ""))
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))
    marked = F.transform(F.col("h_"), lambda x, i: F.when(F.array_contains(F.col("dups_"), x), i))
    same = lambda i, x: F.coalesce(F.get(z, i)["x"] == x, F.lit(False))
    runs = F.transform(z, lambda s, i: F.when(same(i - 1, s["x"]) | same(i + 1, s["x"]), s["i"]))
    there = lambda at: covered(F.filter(at, lambda p: p.isNotNull()))
    stop = F.array(*map(F.lit, dict.fromkeys(STOP_WORDS.split())))
    found = (
        docs.withColumn("w_", words(text))
        .withColumn("n_", F.size(w))
        .withColumn("l_", F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), has_word))
        .withColumn(
            "h_",
            F.when(
                F.col("n_") > 2,
                F.transform(F.sequence(F.lit(0), F.col("n_") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("s_", F.sort_array("h_"))
        .withColumn("dups_", F.array_distinct(F.filter("s_", lambda x, i: F.coalesce(x == F.get("s_", i + 1), F.lit(False)))))
        .withColumn("z_", F.when(F.size("dups_") > FEW, F.sort_array(F.transform("h_", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    )
    counts = F.struct(
        F.col("n_").cast("long").alias("n_words"),
        F.coalesce(without(SPACE), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.length(text) - without(SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("dups_") == 0, 0).when(F.size("dups_") <= FEW, there(marked)).otherwise(there(runs)).cast("long").alias("n_repeat_words"),
        F.size("l_").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.array_contains(stop, F.lower(x)))).cast("long").alias("n_stop_words"),
    )
    # A filter on a count stops above this generator.  Pushed further down, it would repeat the
    # expressions that it is made of, each of which uses the one before several times.
    names = [c for c in docs.columns if c not in COUNTS and c not in HELPERS]
    return found.select(*names, F.explode(F.array(counts)).alias("m_")).select(*names, *[F.col(f"m_.{c}").alias(c) for c in COUNTS])


#: The ratios that rules may name.  A ratio over nothing is null, and fails no rule.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "stop_words_share": ("n_stop_words", "n_words"),
}


def verdict(rules=RULES, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> dict[str, Column]:
    """The table of thresholds as columns: base_failed, kept and failed_rules (names)."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    broken = []
    for rule in rules:
        top, bottom = (F.col(c).cast("double") for c in RATIOS[rule.ratio])
        ratio = F.when(bottom > 0, top / bottom)
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (ratio < rule.least)
        if rule.most is not None:
            outside = outside | (ratio > rule.most)
        broken.append(F.when(outside, F.lit(rule.ratio)))
    failed = F.array_compact(F.array(F.when(base, F.lit("base")), *broken))
    return {"base_failed": base, "failed_rules": failed, "kept": F.size(failed) == 0}


def judge(docs: DataFrame, rules=RULES, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``failed_rules`` and ``kept``, row for row.

    Null texts count as texts without words, which fail for their length.  Columns of ``docs``
    that have the name of a result, or of a helper that ends in "_" (w_, n_, l_, h_, s_, dups_, z_, m_),
    are replaced or dropped.  Repeated rows and ties are judged alike; an empty table gives an empty table."""
    return measured(docs).withColumns(verdict(rules, least_words, most_repeated))
