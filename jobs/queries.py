"""The jobs as queries over the driver's tables, each run twice into one new folder, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import quality_report, refresh_chunks
from tessera.plans import registry
from tessera.sources.shared import fresh


def job1_refresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents after a second run, which finds nothing new."""
    root = fresh(spark, "job1")
    for _ in range(2):  # the pattern fits a table of one file and a folder of files alike
        refresh_chunks.run(spark, f"{sf_dir}/documents.parquet*", f"{root}/output", f"{root}/checkpoint")
    found = refresh_chunks.current(spark, f"{root}/output")
    return found.select("rel_path", "start_line", "end_line", "type", "content", "length", "segment_hash", "source", "file_hash")


def job2_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings and measures of all passages after a second run into the same folder."""
    root = fresh(spark, "job2")
    for _ in range(2):
        quality_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", root)
    return quality_report.report(spark, root)


QUERIES = {"job1_refresh_chunks": job1_refresh_chunks, "job2_quality_report": job2_quality_report}

_RANKERS = {"keyword": "kw", "names": "nm", "fusion": "fu"}
_MEASURES = ", ".join(registry.measured_sql(table, f"me_{table}", expected=not n) for n, table in enumerate(_RANKERS.values()))
_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS ranker, query_id, rel_path, rank FROM {t}" for r, t in _RANKERS.items())
_ALL = " UNION ALL ".join(f"SELECT '{r}' AS ranker, * FROM me_{t}" for r, t in _RANKERS.items())

SQL = {
    "job1_refresh_chunks": f"""WITH RECURSIVE {registry.CHUNKS_SQL}
SELECT file_path AS rel_path, start_line, end_line, type, content, length, segment_hash, source, file_hash FROM (SELECT DISTINCT ON (file_path, segment_hash) * FROM k)
JOIN (SELECT rel_path AS file_path, source, sha256(content) AS file_hash FROM ({registry.FILES})) USING (file_path)""",
    "job2_quality_report": f"""WITH {registry.FUSED_SQL}, {_MEASURES}, rows_ AS ({_ROWS}), all_ AS ({_ALL}),
typed AS (SELECT item_id AS query_id, CASE WHEN len(regexp_extract_all(text, '\\S+')) <= 12 THEN 'short' ELSE 'long' END AS type FROM benchmark)
SELECT ranker, query_id, rel_path, rank, CASE WHEN hit IS NOT NULL THEN type END AS type, hit, recall, rr, ndcg FROM rows_ FULL JOIN all_ USING (ranker, query_id) JOIN typed USING (query_id)""",
}
