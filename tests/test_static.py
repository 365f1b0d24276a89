"""Static embeddings: the file of tensors, quantized rows, and vectors in a build, against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.api import Engine, find
from tessera.operators import embed, static
from tessera.sources import shared

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
DIM = 12


def tensors(path, x, name="embeddings", dtype="F32", shape=None, more=0):
    head = json.dumps({"__metadata__": {"format": "pt"}, name: {"dtype": dtype, "shape": shape or list(x.shape), "data_offsets": [0, x.nbytes + more]}}).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + x.astype("<f4").tobytes())
    return f"file://{path}"


@pytest.fixture(scope="module")
def weights():
    x = np.random.default_rng(0).normal(size=(tokenizers.Tokenizer.from_file(PATH).get_vocab_size(), DIM)).astype(np.float32)
    x[100:200] *= 1e-4  # rows of small values keep their directions
    return x


@pytest.fixture(scope="module")
def model(spark, weights, tmp_path_factory):
    return static.read_model(spark, tensors(tmp_path_factory.mktemp("w") / "model", weights), "embeddings", shared.fresh(spark, "model"))


def plain(weights, text):
    codes, scale = static.quantized(weights)
    ids = tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    mean = (codes[ids] * scale[ids, None]).astype(np.float64).mean(0)
    return mean / np.linalg.norm(mean)


TEXTS = ["where are files hashed", "the tokenizer reads a text", "ünïcode \U0001f600 texts", "a"]


def test_quantized_rows(weights, model):
    codes, scale = static.quantized(weights)
    rows = {r["token"]: r for r in model.where("token in (0, 150, 40000)").collect()}
    assert model.count() == len(weights)
    for t, r in rows.items():
        assert list(r["codes"]) == codes[t].tolist() and r["scale"] == scale[t]
        back = codes[t] * scale[t]
        assert back @ weights[t] / np.linalg.norm(back) / np.linalg.norm(weights[t]) > 0.999
    c, s = static.quantized(np.array([[0.0, 0.0], [1.0, -1.0]], np.float32))
    assert c.tolist() == [[0, 0], [127, -127]] and s[0] == 1


def test_vectors_by_a_column_and_by_a_join(spark, weights, model):
    docs = spark.createDataFrame([*enumerate(TEXTS), (8, ""), (9, None)], "id long, text string")
    got = {r["id"]: r["v"] for r in docs.select("id", static.embed_column(spark, model, f"file://{PATH}")(F.col("text")).alias("v")).collect()}
    tokens = docs.select("id", F.explode(static.token_ids(open(PATH).read())(F.col("text"))).alias("token"))
    joined = {r["id"]: r["vector"] for r in embed.mean_vectors(tokens, "id", static.vectors(model), DIM).collect()}
    assert got[8] is None and got[9] is None and set(joined) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert np.allclose(got[i], plain(weights, text), atol=1e-6) and np.allclose(joined[i], plain(weights, text), atol=1e-6)


def test_a_build_with_it(spark, weights, model, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/own", "static:words:12", DIM, static.embed_column(spark, model, f"file://{PATH}"))
    files = [(f"{k}.txt", f"{t} " * 8, 1, 1.0) for k, t in enumerate(TEXTS)]
    report = engine.build(spark.createDataFrame(files, "rel_path string, content string, size long, mtime_ms double"))
    assert report.complete and report.points == 3  # the last text is too short for a chunk
    for r in engine.store.points().collect():
        assert np.allclose(r["vector"], plain(weights, r["code_chunk"]), atol=1e-6)
    assert find(engine, "where are files hashed", min_score=0.5).first()["file_path"] == "0.txt"


def test_files_that_are_not_of_tensors(spark, tmp_path, monkeypatch):
    x = np.ones((4, 3), np.float32)
    read = lambda path, name="embeddings": static.read_model(spark, path, name, shared.fresh(spark, "model")).count()
    assert read(tensors(tmp_path / "good", x)) == 4
    (tmp_path / "short").write_bytes(b"abc")
    (tmp_path / "long").write_bytes((1 << 40).to_bytes(8, "little") + b"{}")
    (tmp_path / "text").write_bytes((4).to_bytes(8, "little") + b"text")
    bad = [f"file://{tmp_path}/{n}" for n in ("short", "long", "text")]
    bad += [tensors(tmp_path / "half", x, dtype="F16"), tensors(tmp_path / "flat", x, shape=[12]), tensors(tmp_path / "cut", x, more=4)]
    for path in bad:
        with pytest.raises(Exception, match="BadFile"):
            read(path)
    with pytest.raises(Exception, match="has no tensor"):
        read(f"file://{tmp_path}/good", "other")
    monkeypatch.setattr(static, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        static.embed_column(spark, static.read_model(spark, f"file://{tmp_path}/good", "embeddings", shared.fresh(spark, "model")), f"file://{PATH}")
