"""The driver's tables in the roles of the engine: files, points, manifests, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: rel_path, content, size, mtime_ms, source, lang, doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 1000.5).alias("mtime_ms"),
        "source",
        "lang",
        "doc_id",
    )


#: The same in SQL, for oracles.
FILES = "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS rel_path, text AS content, n_chars AS size, doc_id * 1000.5::DOUBLE AS mtime_ms, source, lang, doc_id FROM documents"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state of the files: every eleventh isn't there yet, every seventh has another size,
    every thirteenth another time, every seventeenth another hash; some have gone since."""
    f = files(spark, sf_dir)
    there = f.where("doc_id % 11 <> 0").select(
        "rel_path",
        F.sha2(F.encode(F.when(F.col("doc_id") % 17 == 0, F.lit("other")).otherwise(F.col("content")), "UTF-8"), 256).alias("hash"),
        F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("doc_id") % 13 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"),
        F.lit(0).cast("long").alias("indexed_at"),
    )
    gone = f.where("doc_id % 19 = 0").select(F.concat(F.lit("gone/"), "rel_path").alias("rel_path"), F.lit("0").alias("hash"), "size", "mtime_ms", F.lit(0).cast("long").alias("indexed_at"))
    return there.unionByName(gone)


MANIFEST = f"""SELECT rel_path, sha256(CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE content END) AS hash, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN doc_id % 13 = 0 THEN mtime_ms - 1 ELSE mtime_ms END AS mtime_ms FROM ({FILES}) WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'gone/' || rel_path, '0', size, mtime_ms FROM ({FILES}) WHERE doc_id % 19 = 0"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: id, vector, file_path, file_hash, code_chunk, start_line, end_line."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string"), F.lit("/pkg"), F.col("label").cast("string"), F.lit("/f"), (F.col("vec_id") % 97).cast("string"), F.lit(".py")).alias("file_path"),
        F.when(F.col("vec_id") % 23 != 0, F.md5(F.col("vec_id").cast("string"))).alias("file_hash"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("code_chunk"),
        ((F.col("vec_id") % 40) * 10 + 1).cast("int").alias("start_line"),
        ((F.col("vec_id") % 40) * 10 + 10).cast("int").alias("end_line"),
    )


POINTS = """SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 'src' || (vec_id % 5) || '/pkg' || label || '/f' || (vec_id % 97) || '.py' AS file_path,
  CASE WHEN vec_id % 23 <> 0 THEN md5(vec_id::VARCHAR) END AS file_hash, 'chunk ' || vec_id AS code_chunk,
  ((vec_id % 40) * 10 + 1)::INT AS start_line, ((vec_id % 40) * 10 + 10)::INT AS end_line FROM embeddings"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of point 0, as one query's."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rel_path): files that hold a query's passage."""
    q = queries(spark, sf_dir).withColumnRenamed("query", "phrase")
    return matching.phrases_in(q, files(spark, sf_dir)).join(q, "phrase").select("query_id", "rel_path").distinct()


EXPECTED = f"SELECT DISTINCT item_id AS query_id, rel_path FROM benchmark b JOIN ({FILES}) f ON contains(f.content, b.text)"
