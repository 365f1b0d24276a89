"""Static embeddings: a vector for each token of a vocabulary, read from a file of tensors, and texts as
the means of their tokens' vectors."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import written

MODEL = "token long, codes array<byte>, scale float"
#: Bytes of a model that is sent to all workers, at most: a vocabulary, whatever the texts are.
MOST_BYTES = 512 << 20
#: Tokens of a row group that a reader hands on at a time.
TOKENS = 4_096


class BadFile(ValueError):
    """A file that isn't one of tensors, or hasn't the tensor that is asked for."""


def place(content: memoryview, name: str, path: str = "") -> tuple[int, int, int]:
    """(first byte, rows, columns) of a two-dimensional tensor of 32-bit floats.

    A file is eight bytes with the length of the header, least first; the header in JSON, with the type,
    shape and byte range of each tensor; then the data."""
    length = int.from_bytes(content[:8], "little") if len(content) >= 8 else 0
    if not 0 < length <= len(content) - 8:
        raise BadFile(f"{path} isn't a file of tensors: its header has {length} bytes")
    try:
        header = json.loads(bytes(content[8 : 8 + length]))
        tensor = header.get(name)
    except (ValueError, AttributeError) as error:
        raise BadFile(f"{path} isn't a file of tensors: its header isn't JSON") from error
    if not tensor:
        raise BadFile(f"{path} has no tensor {name}")
    if tensor.get("dtype") != "F32":
        raise BadFile(f"{name} is {tensor.get('dtype')}, not F32")
    shape, (start, end) = tensor.get("shape") or (), tensor.get("data_offsets") or (0, 0)
    if len(shape) != 2 or end - start != 4 * shape[0] * shape[1] or end > len(content) - 8 - length:
        raise BadFile(f"{name} isn't a whole tensor of two dimensions")
    return 8 + length + start, shape[0], shape[1]


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in one byte a number, and a scale for each row: one for all would round rows of small
    values, those of common tokens, to nothing.  Halves go up, as a zero row's scale is one."""
    most = np.abs(x).max(1) if x.size else np.zeros(len(x), np.float32)
    scale = np.where(most > 0, most / np.float32(127), np.float32(1)).astype(np.float32)
    codes = np.floor(x.astype(np.float64) / scale.astype(np.float64)[:, None] + 0.5)
    return np.clip(codes, -127, 127).astype(np.int8), scale


def read_model(spark: SparkSession, path: str, name: str, to: str) -> DataFrame:
    """The model (token, codes, scale) of a file of tensors, written to ``to`` as Parquet.

    One task reads the file, which has a vocabulary and no texts: 2 GB at most, as Spark's reader of
    whole files takes."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                at, n, dim = place(data, name, path)
                for first in range(0, n, TOKENS):
                    some = min(TOKENS, n - first)
                    codes, scale = quantized(np.frombuffer(data, "<f4", some * dim, at + 4 * first * dim).reshape(some, dim))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, some * dim + 1, dim or 1)[: some + 1], pa.int32()), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + some)), lists, pa.array(scale)], ["token", "codes", "scale"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, MODEL)
    return written(found, to)


def vectors(model: DataFrame) -> DataFrame:
    """The model's tokens as (token, vector), for ``embed.mean_vectors``, which joins them."""
    return model.select("token", F.transform("codes", lambda c: (c * F.col("scale")).cast("float")).alias("vector"))


def token_ids(tokenizer: str) -> Callable[[Column], Column]:
    """A column of token ids, array<long>, from a text column; ``tokenizer`` is a tokenizer's JSON."""

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(tokenizer).encode_batch
        return pd.Series([np.array(e.ids, np.int64) for e in encode(texts.fillna("").tolist(), add_special_tokens=False)], index=texts.index)

    return ids


_BUILT: dict[int, object] = {}


def _tokenizer(source: str):
    """A tokenizer, built once a worker."""
    import tokenizers

    key = hash(source)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = tokenizers.Tokenizer.from_str(source)
    return _BUILT[key]


def embed_column(spark: SparkSession, model: DataFrame, tokenizer_path: str) -> Callable[[Column], Column]:
    """For ``Engine(embed_column=...)``: a vector column, array<float>, from a text column.

    A text's vector is the mean of its tokens' vectors, scaled to length 1.  Tokens that the model
    hasn't are left out; a text without any, or whose mean vanishes, has no vector.  The model is sent
    to all workers as bytes, up to MOST_BYTES."""
    n, dim = model.agg(F.coalesce(F.max("token") + 1, F.lit(0)), F.coalesce(F.max(F.size("codes")), F.lit(0))).first()
    if n * (dim + 4) > MOST_BYTES:
        raise ValueError(f"a model of {n * (dim + 4)} bytes is too large to be sent to all workers; join it with embed.mean_vectors")
    table = model.toArrow()
    codes, scales = np.zeros((n, dim), np.int8), np.zeros(n, np.float32)  # a token without a row has no scale
    at = table["token"].to_numpy()
    codes[at] = pa.concat_arrays([c.flatten() for c in table["codes"].chunks]).to_numpy().reshape(-1, dim) if n else codes
    scales[at] = table["scale"].to_numpy()
    source = spark.read.text(tokenizer_path, wholetext=True).first()[0]
    sent = spark.sparkContext.broadcast((codes, scales, source))

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        codes, scales, source = sent.value
        out = []
        for e in _tokenizer(source).encode_batch(texts.fillna("").tolist(), add_special_tokens=False):
            ids = np.array(e.ids, np.int64)
            ids = ids[ids < len(scales)]
            ids = ids[scales[ids] > 0]
            mean = (codes[ids] * scales[ids, None]).sum(0, dtype=np.float64) / max(1, len(ids))
            length = np.sqrt((mean * mean).sum())
            out.append((mean / length).astype(np.float32) if length > 0 else None)
        return pd.Series(out, index=texts.index)

    return embed
