"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

#: Turns of a conversation that one task sorts together.
BUCKET_TURNS = 256


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, bucket, place, role, text, piece hashes): turns numbered from 1 in each conversation,
    in buckets of turn numbers, so that a conversation of any length is spread over tasks."""
    exact = turns.select("conv_id", "turn", "role", "text").distinct()
    exact = exact.withColumn("bucket", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BUCKET_TURNS).cast("long"))
    inner = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    counts = exact.groupBy("conv_id", "bucket").count()
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("conv_id").alias("c_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = exact.withColumn("rank", F.row_number().over(inner)).join(bases, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("bucket") == F.col("b_")))
    return placed.withColumn("place", F.col("base") + F.col("rank")).drop("c_", "b_", "base", "rank")


def told(column: str) -> Column:
    """A value after its length, or a dash for null: no two rows of values are written alike."""
    return F.coalesce(F.concat(F.length(column).cast("string"), F.lit(":"), F.col(column)), F.lit("-"))


def prefixes(placed: DataFrame) -> DataFrame:
    """``placed`` with ``rolled``, the rolling hash of the conversation up to each turn.

    A turn's hash covers its place, role and text, each told apart from the next and from null; rolling sums of its four 32-bit words make
    the hash of a prefix.  Sums can be split at any turn, so buckets are summed apart."""
    h = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), told("role"), told("text")))
    words = {f"w{k}": F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    hashed = placed.withColumns(words)
    inner = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "bucket").agg(*[F.sum(w).alias(w) for w in words])
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c_"), F.col("bucket").alias("b_"), *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_") for w in words])
    rolled = hashed.withColumns({f"r{k}": F.sum(w).over(inner) for k, w in enumerate(words)})
    rolled = rolled.join(bases, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("bucket") == F.col("b_")))
    whole = F.concat_ws(":", *[(F.col(f"r{k}") + F.col(f"{w}_")).cast("string") for k, w in enumerate(words)])
    return rolled.withColumn("rolled", whole).select("conv_id", "bucket", "place", "role", "text", "rolled")


def collapse(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, bucket, place, role, text) of the conversations that stay.

    A conversation whose turns are the first turns of a longer one is a snapshot of it and goes.
    Of conversations with the same turns the smallest id stays, a null id last.  Exactly repeated
    rows of a conversation count once; turns with the same number are put in the order of role
    and text, nulls first; a null turn number comes first.  Null roles and texts are values of
    their own.  An empty table gives no rows; other columns are ignored."""
    placed = stored(prefixes(numbered(turns)), "chat-prefixes", codec="zstd")
    ends = placed.groupBy("conv_id").agg(F.max(F.struct("place", "rolled")).alias("end")).select("conv_id", "end.place", "end.rolled")
    sized = ends.select(F.col("conv_id").alias("c_"), F.col("place").alias("n_turns"))
    inner = placed.join(sized, F.col("conv_id").eqNullSafe(F.col("c_"))).where(F.col("place") < F.col("n_turns")).select("place", "rolled").distinct()
    longest = ends.join(inner, ["place", "rolled"], "left_anti")
    first = longest.groupBy("place", "rolled").agg(F.min("conv_id").alias("keep"))
    return placed.join(first.select("keep"), F.col("conv_id").eqNullSafe(F.col("keep")), "left_semi").select("conv_id", "bucket", "place", "role", "text")


def escaped(text: Column, *marks: tuple[str, str]) -> Column:
    """``text`` with one more backslash inside of each mark, which two characters make, whatever
    backslashes are there: so no mark is left, two texts stay two, and others stay as they are."""
    for left, right in marks:
        text = F.regexp_replace(text, f"{re.escape(left)}(\\\\*){re.escape(right)}", f"{left}\\\\$1{right}")
    return text


OPEN, CLOSE = ("<", "|"), ("|", ">")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): each conversation as one text of ``<|role|>`` heads, texts
    and ``<|end|>`` lines.  Null roles are called unknown; null texts are empty.

    ``<|`` is written ``<\\|`` in texts and roles, and ``|>`` is ``|\\>`` in roles, so a text can't
    pass for turns of its own: what is rendered can be cut into its turns in one way."""
    role, said = escaped(F.coalesce("role", F.lit("unknown")), OPEN, CLOSE), escaped(F.coalesce("text", F.lit("")), OPEN)
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"), said, F.lit("\n<|end|>\n"))
    piece = F.struct("place", head.alias("said"))
    parts = turns.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["said"]), "").alias("said"))
    return parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "said"))), lambda x: x["said"]), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse, then render; see both."""
    return render(collapse(turns))
