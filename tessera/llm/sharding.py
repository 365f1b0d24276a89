"""Sharding through a permutation-filled lookup table, in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: a prime number of slots, over 100 times the number of shards.
SLOTS, SHARDS = 65537, 64


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard.

    Each shard prefers the slots in an order of its own: from a start, in steps that a prime
    ``slots`` makes visit every slot once.  The shards take turns; each claims the first slot of
    its order that is still free.  So every shard gets slots / shards of them but for one, and a
    shard that joins or leaves moves few other slots.  Raises ValueError if there is no shard,
    a name twice, fewer slots than shards, or ``slots`` isn't prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, not below the number of shards")
    places, steps = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        places.append(int.from_bytes(digest[:8], "big") % slots)
        steps.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while free:
        for shard, step in enumerate(steps):
            place = places[shard]
            while table[place] >= 0:
                place = (place + step) % slots
            table[place] = shard
            places[shard] = (place + step) % slots
            free -= 1
            if not free:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key, from 60 bits of the md5 of its text; null keys are taken as empty texts."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: Column, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (index) added, replacing columns of these names.

    Rows with the same key share a shard; so do all rows with a null key.  The table has ``slots``
    rows, whatever the data, so it is broadcast: no row is shuffled.  To keep a hot key from
    filling one shard, give a key with more in it, such as the document's id, not its source."""
    names = [f"shard-{i:05d}" for i in range(SHARDS)] if shards is None else shards
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot int, shard int")
    return df.drop("shard").withColumn("slot", slot(key, slots)).join(F.broadcast(table), "slot")


def write(df: DataFrame, key: Column, path: str, shards: list[str] | None = None) -> None:
    """Write ``df`` as Parquet under ``path``, in a folder for each shard.  Tasks are dealt by
    shard and a salt, so that a shard's rows are spread over several files and tasks."""
    placed = place(df, key, shards)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(key.cast("string")), F.lit(max(1, n // 16)))
    placed.withColumn("salt_", salt).repartition(n, "shard", "salt_").drop("salt_").write.partitionBy("shard").parquet(path)
