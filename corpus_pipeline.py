"""Corpus preparation: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, jaccard, mixing, packing, quality, tokens
from tessera.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null, empty or blank text has no words, so it goes; rows
    that repeat are judged alike, and all stay.  An empty table gives an empty one, and columns
    other than those of documents are dropped, here and in the next three stages."""
    return quality.judge(docs).where("kept").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, once.  Null counts as empty text; a null id is
    less than all others."""
    rows = exact.dedup(docs).groupBy("doc_id", F.col("text_sha256").alias("text_key"))
    chosen = rows.agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("kept")
    return _taken(docs, chosen.withColumn("copies", F.lit(1)), exact.digest(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, once; of several texts under
    that id one of them.  Texts without words are linked with nothing, and all stay."""
    rows = jaccard.labelled(docs).groupBy("doc_id", "text_key", "label", "n_shingles").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "times"))
    groups = rows.where("n_shingles > 0").groupBy("label").agg(first.alias("f")).select("f.doc_id", "f.text_key", "f.times", F.lit(1).cast("long").alias("copies"))
    blank = rows.where("n_shingles = 0").select("doc_id", "text_key", "times", F.col("times").alias("copies"))
    return _taken(docs, groups.unionByName(blank), F.xxhash64("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat.  A text without words has size 0 and isn't
    taken; a null source is one of its own, the last."""
    rows = mixing.mix(docs).groupBy("doc_id", "text_key")
    chosen = rows.agg(F.sum("copies").alias("copies"), F.count("*").alias("times")).where("copies > 0")
    return _taken(docs, chosen, F.xxhash64("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences.  A row that repeats is packed each time; a null or
    empty text is one piece of the end id.  An empty table gives no pieces."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=0)


def _taken(docs: DataFrame, chosen: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` for ``chosen`` (doc_id, text_key, times, copies): a row with this id and ``key``
    is given ``copies`` times, however many times it is there, which ``times`` says."""
    chosen = stored(chosen.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("times").alias("times_"), F.col("copies").alias("copies_")), "pipeline-chosen")
    rows = docs.select(*COLUMNS).withColumn("of_", key).join(chosen, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("of_") == F.col("key_")))
    again = F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))).alias("again_")
    out = rows.where("times_ = 1")
    if not chosen.where("times_ > 1").isEmpty():
        out = out.unionByName(rows.where("times_ > 1").dropDuplicates(["doc_id", "of_"]))
    return out.select(*COLUMNS, again).select(*COLUMNS)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: The last stage counts tokens of a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
