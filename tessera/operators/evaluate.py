"""Retrieval quality: rankers, fusion and metrics, all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import matching, postings
from tessera.operators.postings import BETWEEN, Postings, term_hits

#: Fixed values.
RRF, MOST_CHARS, PER_FILE, QUERIES = 60, 2_000_000, 3, 40
NOISE = r"(?i)^(merge|bump|release|wip|initial commit|revert|update deps|dependabot|chore\(deps\))"
#: Least letters of a part of a file's name.
LEAST_PART = 4
SKIPPED = r"(?i)(\.lock$|\.map$|(^|/)package-lock\.json$)"


def unranked(files: DataFrame) -> DataFrame:
    """Paths (rel_path) that the keyword ranker leaves out: lock files, maps, and files too long."""
    return files.where(F.col("rel_path").rlike(SKIPPED) | (F.length("content") > MOST_CHARS)).select("rel_path")


def _counted(asked: DataFrame, files: DataFrame, index: Postings) -> DataFrame:
    """(query_id, rel_path, n_terms, n_hits) of all files with a term of ``asked`` (query_id, term)."""
    hits = term_hits(index, asked, T.TERM_CAP).join(unranked(files), "rel_path", "left_anti")
    return hits.join(asked, "term").groupBy("query_id", "rel_path").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_hits"))


def keyword_ranked(queries: DataFrame, files: DataFrame, index: Postings | None, k: int) -> DataFrame:
    """(query_id, rel_path, n_terms, n_hits, rank): ``files`` by distinct terms of the query, then
    hits, then path.  With ``index``, that of all files, it counts by stored postings; without, which
    is cheaper unless an index is kept, in one pass over the texts.  A path that comes twice has the
    words of both: such files, which a listing has none of, are counted by an index of their own."""
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    if index is not None:
        counted = _counted(asked, files, index)
    else:
        repeated = files.groupBy("rel_path").count().where("count > 1").select("rel_path")
        twice = None if repeated.isEmpty() else files.join(repeated, "rel_path", "left_semi")
        once = files if twice is None else files.join(repeated, "rel_path", "left_anti")
        once = once.where(~(F.col("rel_path").rlike(SKIPPED) | (F.length("content") > MOST_CHARS)))
        counted = matching.best_by_terms(asked, once, k, T.TERM_CAP)
        if twice is not None:
            counted = counted.unionByName(_counted(asked, twice, postings.build(twice)))
    order = Window.partitionBy("query_id").orderBy(F.col("n_terms").desc(), F.col("n_hits").desc(), "rel_path")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _begun(word: Column, least: int) -> Column:
    """The beginnings of a word, from ``least`` characters to all."""
    return F.when(F.length(word) >= least, F.transform(F.sequence(F.lit(least), F.length(word)), lambda n: F.substring(word, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def name_ranked(queries: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(query_id, rel_path, rank): files whose name parts begin a term of the query, or the reverse.

    Both are equal joins: a term with the beginnings of the distinct parts, and a part with those of
    the distinct terms, so words meet only where one does begin the other."""
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    named = files.select("rel_path", F.explode(F.array_distinct(F.filter(F.split(F.lower("rel_path"), BETWEEN), lambda p: F.length(p) >= LEAST_PART))).alias("part"))
    terms, parts = asked.select("term").distinct(), named.select("part").distinct()
    met = parts.select("part", F.explode(_begun(F.col("part"), T.LEAST_TERM)).alias("term")).join(terms, "term").select("term", "part")
    met = met.unionByName(terms.select("term", F.explode(_begun(F.col("term"), LEAST_PART)).alias("part")).join(parts, "part").select("term", "part"))
    counted = asked.join(met.distinct(), "term").join(named, "part").groupBy("query_id", "rel_path").agg(F.countDistinct("term").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "rel_path")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rel_path", "rank")


def files_of_hits(hits: DataFrame) -> DataFrame:
    """(query_id, rel_path, rank): files in the order of their first hit (query_id, rel_path, rank)."""
    first = hits.groupBy("query_id", "rel_path").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "rel_path")
    return first.select("query_id", "rel_path", F.row_number().over(order).alias("rank"))


def fused(rankings: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (query_id, rel_path, rank) rows of any number of rankers."""
    scores = rankings.groupBy("query_id", "rel_path").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rel_path")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, recall, rr, ndcg) for each query of ``expected`` (query_id, rel_path).
    Gains are binary; the ideal has min(k, number expected) files."""
    wanted = expected.distinct()
    met = wanted.join(ranked, ["query_id", "rel_path"], "left").groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rank") <= k).alias("found"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return met.select(
        "query_id",
        (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.col("found") / F.col("n"), 9).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("rr"),
        F.round(F.col("gain") / ideal, 9).alias("ndcg"),
    )


def summary(measured: DataFrame) -> DataFrame:
    """Means overall and by type, of (strategy, type, hit, recall, rr, ndcg); type is null overall."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "rr", "ndcg")]
    return measured.groupingSets([["strategy"], ["strategy", "type"]], "strategy", "type").agg(F.count("*").alias("n"), *means)


def commit_queries(commits: DataFrame, per_file: int = PER_FILE, most: int = QUERIES) -> DataFrame:
    """Queries from ``commits`` (seq, subject, files): of one file, not noise, with two content words
    or more; up to ``per_file`` of a file, and ``most`` in all, in the order of ``seq``."""
    fit = commits.where((F.size("files") == 1) & ~F.trim("subject").rlike(NOISE) & (F.size(T.content_words(F.col("subject"))) >= 2))
    fit = fit.select("seq", F.trim("subject").alias("query"), F.col("files")[0].alias("rel_path"))
    nth = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    return fit.withColumn("nth", nth).where(F.col("nth") <= per_file).drop("nth").orderBy("seq").limit(most)


def query_type(query: Column, path: Column) -> Column:
    """identifier if a content word and a part of the file's name, of four letters or more, begin alike."""
    parts = F.filter(F.split(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), "[^a-z0-9]+"), lambda p: F.length(p) >= LEAST_PART)
    named = F.exists(T.content_words(query), lambda w: F.exists(parts, lambda p: F.startswith(p, w) | F.startswith(w, p)))
    return F.when(named, "identifier").otherwise("concept")


def corpus_profile(files: DataFrame, language: str, top: int = 3) -> DataFrame:
    """(language, n_files, n_lines, rank) of the languages with the most files."""
    counted = files.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n_files"), F.sum(F.size(F.split("content", "\n", -1))).alias("n_lines"))
    order = Window.orderBy(F.col("n_files").desc(), "language")  # one row a language
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Fewest queries of a set that counts, a gain that counts, and a hit rate and a reciprocal
#: rank that are found, but not first.
LEAST_QUERIES, GAIN, FOUND, FIRST = 10, 0.02, 0.95, 0.75
#: Rankers in the order in which ties are told.
RANKERS = ("keyword", "names", "semantic", "fusion")


def findings(summaries: DataFrame, least: int = LEAST_QUERIES) -> DataFrame:
    """What stands out in each set of queries: one row a set of ``summaries`` (label, strategy, n,
    hit, rr), of those that have ``least`` queries and two strategies.

    hit_gain and rank_gain say how far fusion is ahead of semantic; ``fusion_beats`` is set if either
    counts, as better can mean finding more, or finding it higher.  semantic_hit and keyword_hit are
    the gap between the two.  ``names_weakest`` is set if ranking by names comes last by hit rate,
    then reciprocal rank; of equal strategies the later one of RANKERS counts as lower.
    ``rank_not_first`` is set if semantic finds nearly all, but not first."""
    place = F.array_position(F.array(*map(F.lit, RANKERS)), F.col("strategy"))
    of = lambda name, c: F.max(F.when(F.col("strategy") == name, F.col(c)))
    usable = summaries.where((F.col("n") >= least) & F.col("strategy").isin(*RANKERS))
    sets = usable.groupBy("label").agg(
        F.max("n").alias("n"),
        F.countDistinct("strategy").alias("strategies"),
        F.min_by("strategy", F.struct("hit", "rr", -place)).alias("weakest"),
        *[of(name, c).alias(f"{name}_{c}") for name in ("semantic", "keyword", "fusion") for c in ("hit", "rr")],
    )
    gains = {f"{kind}_gain": F.round(F.col(f"fusion_{c}") - F.col(f"semantic_{c}"), 6) for kind, c in (("hit", "hit"), ("rank", "rr"))}
    found = sets.where("strategies >= 2").withColumns(gains)
    told = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  a strategy that isn't there stands out in nothing
    return found.select(
        "label", "n", "hit_gain", "rank_gain",
        told((F.col("hit_gain") > GAIN) | (F.col("rank_gain") > GAIN)).alias("fusion_beats"),
        "semantic_hit", "keyword_hit",
        (F.col("weakest") == "names").alias("names_weakest"),
        told((F.col("semantic_hit") >= FOUND) & (F.col("semantic_rr") < FIRST)).alias("rank_not_first"),
    )
