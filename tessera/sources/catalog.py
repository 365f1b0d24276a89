"""The catalog of embedding models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provider, model, dimension, threshold, input tokens, request items, request tokens, prefix; - is unset.
MODELS = """
openai text-embedding-3-small 1536 0.4 8192 2048 300000 -
openai text-embedding-3-large 3072 0.4 8192 2048 300000 -
openai text-embedding-ada-002 1536 0.4 8192 2048 300000 -
ollama mxbai-embed-large 1024 0.3 512 - - -
ollama nomic-embed-text 768 0.3 2048 - - search_query:
ollama nomic-embed-text:latest 768 0.3 2048 - - search_query:
ollama all-minilm 384 0.3 512 - - -
ollama bge-m3 1024 0.3 8192 - - -
gemini gemini-embedding-001 3072 0.35 2048 - - -
gemini gemini-embedding-2 3072 0.35 8192 - - -
gemini text-embedding-004 768 0.35 2048 - - -
gemini embedding-001 768 0.35 2048 - - -
mistral codestral-embed-2505 1536 0.35 8192 - - -
mistral codestral-embed 1536 0.35 8192 - - -
mistral mistral-embed 1024 0.35 8192 - - -
voyage voyage-code-4 1024 0.35 32000 1000 120000 -
voyage voyage-code-3 1024 0.35 32000 1000 120000 -
voyage voyage-4-large 1024 0.35 32000 1000 120000 -
voyage voyage-4 1024 0.35 32000 1000 320000 -
voyage voyage-4-lite 1024 0.35 32000 1000 1000000 -
voyage voyage-3 1024 0.35 32000 1000 - -
voyage voyage-3-lite 512 0.35 32000 1000 - -
openrouter openai/text-embedding-3-small 1536 0.4 8192 - 300000 -
openrouter openai/text-embedding-3-large 3072 0.4 8192 - 300000 -
openrouter google/gemini-embedding-2-preview 3072 0.35 8192 - - -
local potion-base-8M-128d 128 0.3 512 64 - -
local potion-multilingual-128M 256 0.3 512 64 - -
"""
DDL = "provider string, model string, dimension int, score_threshold double, max_input_tokens int, max_batch_items int, max_batch_tokens int, query_prefix string"
#: What holds for models without an entry.
FALLBACK_INPUT_TOKENS, FALLBACK_ITEMS, FALLBACK_TOKENS = 512, 64, 100_000


def rows() -> list[tuple]:
    out = []
    for line in MODELS.split("\n"):
        if x := line.split():
            n = [None if v == "-" else int(v) for v in (x[2], *x[4:7])]
            out.append((x[0], x[1], n[0], float(x[3]), *n[1:], None if x[7] == "-" else f"{x[7]} "))
    return out


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), DDL)


def with_limits(profiles: DataFrame, setting_items: int) -> DataFrame:
    """``profiles`` (provider, model) with dimension, threshold and request ceilings; unknown models
    get the fallbacks.  The catalog is a fixed table of a few rows."""
    known = F.broadcast(models(profiles.sparkSession))
    return profiles.join(known, ["provider", "model"], "left").select(
        "provider",
        "model",
        "dimension",
        "score_threshold",
        F.least(F.lit(setting_items), F.coalesce("max_batch_items", F.lit(FALLBACK_ITEMS))).alias("items"),
        F.coalesce("max_batch_tokens", F.lit(FALLBACK_TOKENS)).alias("tokens"),
        F.floor(F.coalesce("max_input_tokens", F.lit(FALLBACK_INPUT_TOKENS)) * 4 * 0.95).alias("input_chars"),
    )
