"""Places in a total order, and requests packed along it, without one task for a whole order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import fresh, written

#: Rows of a block that one task packs, and blocks whose tables one task joins.
BLOCK, FAN = 65_536, 1_024


def placed(rows: DataFrame, group: str | None, *order: str) -> DataFrame:
    """``rows`` with pos, their place from 0 by ``order`` (nulls first), in all or in each ``group``.

    One range sort over all rows, so a group of any size is spread over tasks; places are counted by
    range, of which a group has no more than the shuffle has tasks.  Rows that are equal in the whole
    order come in any order."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ((group,) if group else ()) + order]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", 33))
    kept = written(dealt, fresh(spark, "placed"))
    by = F.col(group) if group else F.lit(0)
    runs = kept.groupBy(by.alias("g_"), F.col("part_").alias("p_")).agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.sum("n_").over(Window.partitionBy("g_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("g_", "p_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"))
    met = kept.join(runs, by.eqNullSafe(F.col("g_")) & (F.col("part_") == F.col("p_")))
    return met.withColumn("pos", F.col("at_") + F.col("shift_")).drop("at_", "part_", "g_", "p_", "n_", "shift_")


def _next(tokens: np.ndarray, max_items: int, max_tokens: int) -> np.ndarray:
    """For each text the place of the first one that its request hasn't room for, if it begins one."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    fits = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    here = np.arange(len(tokens))
    return np.minimum(np.maximum(fits, here + 1), here + max_items)


def _through(tokens: np.ndarray, n: int, max_items: int, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For each way into a block of ``n`` texts, with the texts after it: how far into the next block
    the requests lead, and how many begin in this one."""
    to = _next(tokens, max_items, max_tokens)
    out, count = np.empty(len(tokens) + 1, np.int64), np.zeros(len(tokens) + 1, np.int64)
    out[n:] = np.arange(len(tokens) + 1 - n)
    for i in range(n - 1, -1, -1):
        j = min(to[i], len(tokens))
        out[i], count[i] = out[j], count[j] + 1
    ways = np.minimum(np.arange(max_items), len(tokens))
    return out[ways], count[ways]


def packed(texts: DataFrame, order: str, tokens: str, max_items: int, max_tokens: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``texts`` with request, the number of the request that a text goes in: texts in ``order``, each
    in the same request as the one before while that has room for ``max_items`` texts and
    ``max_tokens``; a text above the ceiling has a request to itself.

    The order is cut into blocks.  As a request has ``max_items`` texts at most, it leads that far into
    the next block at most: a block is a small table of where each way in leads out, and how many
    requests begin.  Tables are joined ``fan`` at a time until one is left, then each block is
    told its own way in and numbers its texts.  A null count of tokens is none."""
    if not 0 < max_items <= block:
        raise ValueError("a request has at least one text, and no more than a block")
    rows = placed(texts.withColumn("size_", F.coalesce(F.col(tokens).cast("long"), F.lit(0))), None, order)
    rows = written(rows.withColumn("block", F.expr(f"pos div {block}")), fresh(texts.sparkSession, "ordered"))
    # The first texts of a block go to the one before it too, which looks that far ahead.
    ahead = rows.where(F.col("block") > 0).where(F.col("pos") - F.col("block") * block < max_items)
    seen = rows.select("block", "pos", "size_").unionByName(ahead.select((F.col("block") - 1).alias("block"), "pos", "size_"))

    def lead(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int((pdf["pos"] < (key[0] + 1) * block).sum())
        out, count = _through(pdf["size_"].to_numpy(), n, max_items, max_tokens)
        return pd.DataFrame({"node": [key[0]], "out": [out.tolist()], "count": [count.tolist()]})

    kind = "node long, out array<long>, count array<long>"
    levels = [written(seen.groupBy("block").applyInPandas(lead, kind), fresh(texts.sparkSession, "leads"))]

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        way, total = np.arange(max_items), np.zeros(max_items, np.int64)
        for out, count in zip(*(pdf.sort_values("node")[c] for c in ("out", "count")), strict=True):
            # A way that is beyond a short last block leads out of it as it is.
            total, way = total + np.asarray(count)[way], np.asarray(out)[way]
        return pd.DataFrame({"node": [key[0]], "out": [way.tolist()], "count": [total.tolist()]})

    n = levels[0].count()
    while n > 1:
        levels.append(written(levels[-1].groupBy(F.expr(f"node div {fan}").alias("up")).applyInPandas(join, kind), fresh(texts.sparkSession, "leads")))
        n = -(-n // fan)

    def tell(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        way, number, told = int(above["way"].iloc[0]), int(above["number"].iloc[0]), []
        for node, out, count in nodes.sort_values("node")[["node", "out", "count"]].itertuples(index=False):
            told.append((node, way, number))
            way, number = int(out[way]), number + int(count[way])
        return pd.DataFrame(told, columns=["node", "way", "number"])

    ways = levels[-1].select("node", F.lit(0).cast("long").alias("way"), F.lit(0).cast("long").alias("number"))
    for level in levels[-2::-1]:
        ways = level.groupBy(F.expr(f"node div {fan}").alias("up")).cogroup(ways.groupBy("node")).applyInPandas(tell, "node long, way long, number long")

    def number(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = (pdf["pos"] < (key[0] + 1) * block).to_numpy()
        to, starts = _next(pdf["size_"].to_numpy(), max_items, max_tokens), np.zeros(len(pdf), np.int64)
        i = int(above["way"].iloc[0])
        while i < own.sum():
            starts[i], i = 1, to[i]
        requests = int(above["number"].iloc[0]) - 1 + np.cumsum(starts)
        return pd.DataFrame({"pos": pdf["pos"].to_numpy()[own], "request": requests[own]})

    numbered = seen.groupBy("block").cogroup(ways.groupBy("node")).applyInPandas(number, "pos long, request long")
    return rows.drop("size_", "block").join(numbered, "pos").drop("pos")
