"""A stored substring index of texts: postings of words, and of the trigrams that words have.

A word is a whole run of [a-z0-9] in a lower-cased text.  A term of these characters can only be
inside of runs, so a text holds it as often as its words do.  Terms meet the distinct words by
trigrams, not the texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import fresh, written

#: Fixed value: what separates words.
BETWEEN = "[^a-z0-9]+"
GRAM = 3
#: Characters of a word that are cut into trigrams at a time.
PIECE = 1_024
#: Phrases without a word that a text is searched for at a time.
BLOCK = 1_000


class Postings(NamedTuple):
    words: DataFrame  # word, rel_path, n: how often a file has it
    vocabulary: DataFrame  # word, files: how many have it
    grams: DataFrame  # gram, word


def _grams(word: Column, n: int = GRAM) -> Column:
    """Distinct n-grams of a word; a long one is cut into overlapping pieces first, as a substring
    is found by counting from the start."""
    last = F.greatest(F.floor((F.length(word) - n) / PIECE), F.lit(-1)).cast("int")
    pieces = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(word, k * PIECE + 1, F.lit(PIECE + n - 1)))).otherwise(F.array().cast("array<string>"))
    cut = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n))))
    return F.array_distinct(F.flatten(cut))


def build(files: DataFrame, path: str | None = None) -> Postings:
    """The index of ``files`` (rel_path, content), in Parquet under ``path`` or a new folder of the
    session's shared one.  Null contents have no words; a path that comes twice has the words of both."""
    path = path or fresh(files.sparkSession, "postings")
    found = files.select("rel_path", F.explode(F.split(F.lower("content"), BETWEEN)).alias("word")).where("word <> ''")
    words = written(found.groupBy("word", "rel_path").agg(F.count("*").cast("int").alias("n")), f"{path}/words")
    vocabulary = written(words.groupBy("word").agg(F.count("*").alias("files")), f"{path}/vocabulary")
    grams = written(vocabulary.select(F.explode(_grams(F.col("word"))).alias("gram"), "word"), f"{path}/grams")
    return Postings(words, vocabulary, grams)


def words_with(index: Postings, terms: DataFrame) -> DataFrame:
    """(term, word, times): words that hold a term of [a-z0-9], and how often without overlaps.

    The postings of a term's rarest trigram name the words to look at; looking is cheaper than
    intersecting more of them, as words are short.  A term with a trigram that no word has meets
    none.  Terms of one or two characters have no trigram; they meet the words' own pieces of that
    length."""
    asked = terms.select("term").where("term <> ''").distinct()
    sizes = index.grams.groupBy("gram").agg(F.count("*").alias("size"))  # 36 ** 3 rows at most
    own = asked.where(F.length("term") >= GRAM).select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    rarest = own.join(sizes, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("size", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(index.grams, "gram").where(F.contains(F.col("word"), F.col("term"))).select("term", "word")
    for n in range(1, GRAM):
        pieces = index.vocabulary.select("word", F.explode(_grams(F.col("word"), n)).alias("term"))
        met = met.unionByName(asked.where(F.length("term") == n).join(pieces, "term").select("term", "word"))
    times = (F.length("word") - F.length(F.replace("word", F.col("term"), F.lit("")))) / F.length("term")
    return met.select("term", "word", times.cast("int").alias("times"))


def term_hits(index: Postings, terms: DataFrame, cap: int | None = None) -> DataFrame:
    """(term, rel_path, n): how often each file holds each distinct term (term), without overlaps and
    up to ``cap``.  Not at all gives no row."""
    n = F.sum(F.col("n") * F.col("times"))
    met = words_with(index, terms)
    # Written, or else the occurrences in a word would be counted anew for each file that has it.
    met = written(met, fresh(met.sparkSession, "words-with"))
    found = met.join(index.words, "word").groupBy("term", "rel_path").agg(n.alias("n"))
    return found if cap is None else found.withColumn("n", F.least("n", F.lit(cap)))


def phrase_hits(index: Postings, phrases: DataFrame, files: DataFrame) -> DataFrame:
    """(phrase, rel_path): files (rel_path, content) that hold a distinct phrase (phrase) as it is
    written; empty and null phrases are in none.

    A run inside of a phrase, with both its ends there, is a word of every text that holds the
    phrase: of these the rarest names the files to look at.  A phrase without one is looked for by
    its longest run, as a term; one without any run is compared with all files, in blocks."""
    asked = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("runs", F.split(F.lower("phrase"), BETWEEN))
    inner = F.filter(F.slice("runs", 2, F.greatest(F.size("runs") - 2, F.lit(0))), lambda r: r != "")
    asked = asked.select("phrase", F.array_distinct(inner).alias("inner"), F.filter("runs", lambda r: r != "").alias("runs"))
    known = asked.select("phrase", F.explode("inner").alias("word")).join(index.vocabulary, "word", "left")
    rarest = known.groupBy("phrase").agg(F.min_by("word", F.struct(F.coalesce("files", F.lit(0)), "word")).alias("word"))
    maybe = rarest.join(index.words, "word").select("phrase", "rel_path")
    by_length = F.array_max(F.transform("runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    edged = asked.where("size(inner) = 0 and size(runs) > 0").select("phrase", by_length.alias("term"))
    maybe = maybe.unionByName(edged.join(term_hits(index, edged), "term").select("phrase", "rel_path"))
    looked = files.select("rel_path", "content").join(maybe.groupBy("rel_path").agg(F.collect_set("phrase").alias("asked")), "rel_path")
    bare = asked.where("size(runs) = 0").select("phrase", F.pmod(F.xxhash64("phrase"), F.lit(BLOCK)).alias("b")).groupBy("b").agg(F.collect_set("phrase").alias("asked"))
    looked = looked.unionByName(files.select("rel_path", "content").crossJoin(bare.select("asked")))  # a query set, by the block
    held = F.filter("asked", lambda p: F.contains(F.col("content"), p))
    return looked.select(F.explode(held).alias("phrase"), "rel_path").distinct()
