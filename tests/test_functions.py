"""Golden values of hashes, ids, paths and formats."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import embed


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_uuid5(spark):
    name = "7fd49fc5dd708dc47bf278fc3bfbfdbaf4314139faf4fc6f4dae7f7ea3983ee3"
    assert value(spark, T.uuid5(F.lit(name))) == "0001d11f-9c0b-55ce-9682-7b22b71bd41b"
    with pytest.raises(ValueError):
        T.uuid5(F.lit("x"), "short")


def test_workspace_hash(spark):
    assert value(spark, T.sha256_text(F.lit("D:\\Proyectos"))).startswith("43dfc9b3ee33fcfd")


@pytest.mark.parametrize(("n", "want"), [(999, "999"), (12345, "12.3k"), (1_200_000, "1.2M"), (-1, "?"), (None, "?")])
def test_format_points(spark, n, want):
    assert value(spark, T.format_points(F.lit(n).cast("long"))) == want


def test_mask_secret(spark):
    assert value(spark, T.mask_secret(F.lit("12345678"))) == "•" * 8
    assert value(spark, T.mask_secret(F.lit("sk-abcdef-wxyz"))) == "sk-a…wxyz"


def test_extensions(spark):
    assert value(spark, T.extension_of_name(F.lit("a.b/c"))) == ""
    assert value(spark, T.extension_of_path(F.lit("a.b/c"))) == ".b/c"
    assert value(spark, T.extension_of_name(F.lit("x/.gitignore"))) == ""
    assert value(spark, T.normalized_extensions(F.array(*map(F.lit, [" PY", ".py", "", "Ts"])))) == [".py", ".ts"]


def test_prefixes(spark):
    under = lambda p, x: value(spark, T.under_segments(F.lit(p), x))
    assert under("src/a.ts", "src") and under("src\\a.ts", "src\\") and under("lib/b.ts", ".")
    assert not under("src2/a.ts", "src")
    assert value(spark, T.under_string(F.lit("src2/a.ts"), "src"))
    assert T.normalized_prefix("./a/../b//c") == ["b", "c"]


def test_terms(spark):
    assert value(spark, T.query_terms(F.lit("How is the Vector-Index built? vector"))) == ["vector", "index", "built"]
    assert value(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(spark, T.occurrences(F.lit("ab" * 50), F.lit("ab"))) == 20


def test_quantize(spark):
    q = value(spark, V.quantize(F.array(*map(F.lit, [1.0, -0.5, 0.0, 0.25]))))
    assert q["codes"] == [127, -63, 0, 32]
    zero = value(spark, V.quantize(F.array(F.lit(0.0), F.lit(0.0))))
    assert (zero["scale"], zero["codes"]) == (1.0, [0, 0])


def test_cosine_of_nothing(spark):
    assert value(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_request_batches():
    texts = ["x" * 8000] * 400
    batches = embed.request_batches(texts, 2048, 300_000)
    assert len(batches) >= 3 and sum(map(len, batches)) == 400
    assert all(sum(len(t) // 4 for t in b) <= 300_000 for b in batches)
    assert embed.request_batches(["x" * 100], 64, 1) == [["x" * 100]]


def test_embedder_counts(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    good = embed.embedder(lambda texts: [[float(len(t))] for t in texts])
    assert [r["v"] for r in df.select(good("t").alias("v")).collect()] == [[1.0], [0.0]]
    bad = embed.embedder(lambda texts: [])
    with pytest.raises(Exception, match="vectors"):
        df.select(bad("t")).collect()


def test_embedding_forms_agree(spark):
    df = spark.createDataFrame([(1, "one two three two"), (2, "---")], "k long, t string")
    long = {r["dim"]: r["weight"] for r in embed.hashed_dimensions(df, "k", "t").where("k = 1").collect()}
    array = df.where("k = 1").select(embed.hashed_vector(F.col("t")).alias("v")).first()["v"]
    assert {k: round(x, 6) for k, x in enumerate(array) if x} == pytest.approx(long, abs=1e-6)
    assert df.where("k = 2").select(embed.hashed_vector(F.col("t")).alias("v")).first()["v"] is None


def test_terms_are_summed_where_texts_are_read(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, None), (3, "- "), (4, "alpha"), (1, "gamma")], "k long, t string")
    found = embed.hashed_dimensions(df, "k", "t", 16)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    one = embed.hashed_dimensions(df.where("k = 1").limit(0).union(spark.createDataFrame([(1, "alpha beta alpha gamma")], df.schema)), "k", "t", 16)
    assert sorted(map(tuple, found.where("k = 1").collect())) == sorted(map(tuple, one.collect())) and {r["k"] for r in found.collect()} == {1, 4}
