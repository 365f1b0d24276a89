"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import count_words, partitions, stored

#: Production parameters of the mix.
WEIGHTS, TOTAL_SHARE, MOST = (5, 2, 1), 1.5, 2


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST) -> DataFrame:
    """Target of each source from ``sizes`` (source, source_size): the sources by code point, null
    last, get the repeating weights and share ``share`` of all sizes; none gets over ``most`` times
    its own size, and what it can't take is shared again by weight.

    Water filling in closed form: sources in the order of limit by weight reach their limits first,
    so running sums tell at which of them the level stops.  One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(w, (F.col("rank") % len(weights)).cast("int")).cast("long")
    )
    limit = F.col("source_size") * most
    level = Window.orderBy((limit / F.col("weight")).asc(), F.col("rank").asc())
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    spread = ranked.withColumns(
        {
            "limit_": limit,
            "all_": F.sum("source_size").over(whole),
            "used": F.coalesce(F.sum(limit).over(before), F.lit(0)),
            "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    rest = F.col("all_") * F.lit(share) - F.col("used")
    full = F.col("weight") * rest >= F.col("limit_") * F.col("weights")
    # The limits are reached by a first run of the order; the first that isn't full sets the level.
    level_rest = F.min(F.when(~full, F.struct("pos", (rest.alias("r")), F.col("weights").alias("ws")))).over(whole)
    return (
        spread.withColumn("pos", F.row_number().over(level))
        .withColumn("open", level_rest)
        .withColumn(
            "target",
            F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("limit_").cast("double")).otherwise(
                F.col("weight") * F.col("open.r") / F.col("open.ws")
            ),
        )
        .select("source", "source_size", "target")
    )


def shuffle_key(doc_id: Column) -> Column:
    """A place in the shuffled order that depends on the id only: 60 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``keys`` in the given order: rows are dealt by a range sort of
    keys and order, summed within each range, and the sums of the ranges before are added.  A
    range has about as many rows as any other, whatever the keys; a key has one sum a range."""
    ranged = stored(df.repartitionByRange(2 * partitions(df.sparkSession), *keys, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    within = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "range").agg(F.sum(value).alias("sum_"))
    bases = sums.select(*keys, "range", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    return ranged.withColumn(name, F.sum(value).over(within)).join(bases, [*keys, "range"]).withColumn(name, F.col(name) + F.col("base_")).drop("base_", "range")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST) -> DataFrame:
    """Rows (doc_id, source, row_, text_key (a hash of the text), key, size, source_size, target, taken, copies) for each row of ``docs``.

    Each of ``most`` passes over a source puts its documents in a shuffled order.  A document's
    virtual finish time is the running sum of its source's words divided by the source's target,
    so all sources are served at the pace of their targets.  The queue of all sources is sorted
    by ranges of these times and cut where its words reach the total of the targets.

    Whole documents only: a source may miss its target by less than about one document.  Null
    texts and texts without words have size 0 and are never taken; a null source is a source of
    its own; null ids all share one place in the shuffled order, where ties go by size.  Rows that
    repeat an id count on their own.  An empty table gives no rows; other columns are ignored.

    No key is brought together in one task, see running(); what one task adds up over all ranges
    is one row a range."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of"),  # a null source too
        shuffle_key(F.col("doc_id")).alias("key"),
        count_words(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row_"),
        F.xxhash64("text").alias("text_key"),
    )
    base = stored(sized, "mix-sizes")
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = stored(goal.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("of"), "source_size", "target"), "mix-targets")
    served = running(base.where("size > 0").select("of", "key", "size", "row_"), ["of"], ["key", "size", "row_"], "size", "sum_1")
    passes = served.join(goal.where("target > 0"), "of").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    finish = (F.col("sum_1") + F.col("pass") * F.col("source_size")) / F.col("target")
    queue = stored(passes.select(finish.alias("finish"), "key", "size", "row_", "pass"), "mix-queue")
    placed = running(queue, [], ["finish", "key", "size", "row_", "pass"], "size", "sum_all")
    budget = goal.agg(F.sum("target").alias("budget"))
    taken = (
        placed.crossJoin(F.broadcast(budget))  # one row
        .where(F.col("sum_all") <= F.col("budget"))
        .groupBy("row_")
        .agg(F.count("*").alias("copies"))
    )
    return (
        base.join(goal, "of")
        .join(taken, "row_", "left")
        .withColumn("copies", F.coalesce("copies", F.lit(0)))
        .select("doc_id", "source", "row_", "text_key", "key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )
