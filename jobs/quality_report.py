"""Measure how well each ranker finds the files that hold a query's passage.

    spark-submit --py-files tessera.zip jobs/quality_report.py --config jobs/quality_report.json \\
        --documents <table> --queries <table> --output <folder>

Documents (doc_id, text, lang, source) are files, queries (item_id, text) passages; a file is right
for a query if it holds the passage as it is written.  Files are ranked by the keywords of a query, by
their names, and by both rankings fused.  The output has three tables: `rankings`, partitioned by
ranker, `measures` of each query, partitioned by ranker, and `summary`, partitioned by strategy: means
over all queries, over short ones and over long ones.  Rankings are written first and all else reads them.

Each partition is overwritten as a whole, so a run that is repeated, or that begins again after a
failure, ends with the same tables.  Queries and documents without an id or a text are left out;
a null source or lang is "_" in the path.  Queries that no file is right for have no measures.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, matching

log = logging.getLogger("quality_report")

DEFAULTS = {"k": 10, "short_words": 12}
#: Files that a partition of the output is dealt over by query.
SPREAD = 8
RANKINGS = "query_id long, rel_path string, rank int, ranker string"
MEASURES = "query_id long, hit int, recall double, rr double, ndcg double, type string, ranker string"
SUMMARY = "type string, n long, hit double, recall double, rr double, ndcg double, strategy string"


def _written(df: DataFrame, output: str, name: str, schema: str) -> DataFrame:
    """Overwrite the partitions of ``df`` by the last column of ``schema``, and read the table back."""
    columns = [c.split()[0] for c in schema.split(", ")]
    df.select(*columns).repartition(columns[-1], F.pmod(F.xxhash64(columns[0]), F.lit(SPREAD))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(columns[-1]).parquet(f"{output}/{name}")
    table = df.sparkSession.read.schema(schema).parquet(f"{output}/{name}")
    log.info("%s/%s was written and has %s rows", output, name, table.count())
    return table


def run(spark: SparkSession, documents: str, queries: str, output: str, config: dict | None = None) -> None:
    """Rank, measure and sum up; each table is written before the next one is made of it."""
    settings = DEFAULTS | (config or {})
    k = settings["k"]
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = spark.read.parquet(documents).where("doc_id is not null and text is not null").select(path.alias("rel_path"), F.col("text").alias("content"))
    asked = spark.read.parquet(queries).where("item_id is not null and text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    log.info("%s files in %s; %s queries in %s", files.count(), documents, asked.count(), queries)

    single = {"keyword": evaluate.keyword_ranked(asked, files, None, k), "names": evaluate.name_ranked(asked, files, k)}
    for ranker, ranked in single.items():
        rankings = _written(ranked.withColumn("ranker", F.lit(ranker)), output, "rankings", RANKINGS)
    both = rankings.where(F.col("ranker").isin(*single))
    rankings = _written(evaluate.fused(both, k).withColumn("ranker", F.lit("fusion")), output, "rankings", RANKINGS)

    passages = asked.withColumnRenamed("query", "phrase")
    right = matching.phrases_in(passages, files).join(passages, "phrase").select("query_id", "rel_path").distinct().persist()
    length = F.when(F.regexp_count("query", F.lit(r"\S+")) <= settings["short_words"], "short").otherwise("long")
    typed = asked.groupBy("query_id").agg(F.max(length).alias("type"))  # an id that comes twice has one length
    try:
        for ranker in (*single, "fusion"):
            measured = evaluate.metrics(rankings.where(F.col("ranker") == ranker), right, k).join(typed, "query_id")
            measures = _written(measured.withColumn("ranker", F.lit(ranker)), output, "measures", MEASURES)
    finally:
        right.unpersist()
    _written(evaluate.summary(measures.withColumnRenamed("ranker", "strategy")), output, "summary", SUMMARY)


def report(spark: SparkSession, output: str) -> DataFrame:
    """The output as it stands: every ranked file with its query's measures, and queries of which
    nothing was ranked."""
    rankings, measures = spark.read.schema(RANKINGS).parquet(f"{output}/rankings"), spark.read.schema(MEASURES).parquet(f"{output}/measures")
    return rankings.join(measures, ["ranker", "query_id"], "full_outer").select("ranker", "query_id", "rel_path", "rank", "type", "hit", "recall", "rr", "ndcg")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "documents", "queries", "output"):
        parser.add_argument(f"--{name}", required=True)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("quality_report").getOrCreate()
    try:
        # The configuration is read through Spark too, as its path may be remote.
        config = json.loads(spark.read.text(given.config, wholetext=True).first()[0])
        run(spark, given.documents, given.queries, given.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
