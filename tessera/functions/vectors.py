"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def quantize(a: Column) -> Column:
    """(scale, codes): a scale for the whole vector, its largest magnitude / 127 or 1 for zeros, and
    codes from -127 to 127, halves rounded up."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    codes = F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + 0.5))).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def dequantize(scale: Column, codes: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)
