"""Best-fit packing of documents into sequences by a configuration linear program."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored, tidy
from tessera.llm.tokens import Encoder, encoded, tokenizer_path

#: Production parameters: tokens of a sequence; step of the multiplicative weights.
CAPACITY, STEP = 2048, 0.25

#: A configuration is used when it's worth the best one's value less this share, as one pricing then serves
#: many lengths; how much of a length's demand, as a share, counts as none; how far a STEP of the demand lowers
#: a length's weight.  The lower it is, the nearer to full are the configurations that a pricing finds.
NEAR, NONE, RATE = 0.02, 1e-9, 0.02

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"


class Config(NamedTuple):
    """A way to fill a sequence, ((length, how many), ...), and how many sequences take it."""

    items: tuple[tuple[int, int], ...]
    count: int


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each space up to ``capacity``, and a length that begins such a filling or 0
    where one less space is worth as much: an unbounded knapsack, by dynamic programming over the
    space.  values[k] is what a piece of length k is worth."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    kinds = np.flatnonzero(values)
    worths, until = values[kinds], np.searchsorted(kinds, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := until[c]:
            worth = worths[:n] + best[c - kinds[:n]]
            k = int(worth.argmax())
            if worth[k] > best[c]:
                best[c], pick[c] = worth[k], kinds[k]
    return best, pick


def filling(pick: np.ndarray, space: int) -> Counter[int]:
    """How many pieces of each length a filling of ``space`` has, from knapsack's lengths."""
    used: Counter[int] = Counter()
    while space > 0:
        if pick[space]:
            used[int(pick[space])] += 1
        space -= int(pick[space]) or 1
    return used


def price(values: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length fill a sequence of the largest value."""
    used = np.zeros(capacity + 1, np.int64)
    for k, n in filling(knapsack(values, capacity)[1], capacity).items():
        used[k] = n
    return used


def fractional(demand: np.ndarray, capacity: int, rounds: int | None = None, step: float = STEP) -> dict[tuple[tuple[int, int], ...], float]:
    """An approximate solution of the configuration linear program: how often each configuration is
    taken so that all of ``demand`` (pieces by length) is filled with the fewest sequences.  Each
    round prices the lengths by their weights, uses the best configuration, and the best ones with
    each other length as far as they are NEAR it, as often as a share ``step`` of the demand
    allows, and lowers the weights of what it covered.  Weights start at the lengths, the dual of a
    perfect filling; a touch more for long ones, as ties otherwise go to the shortest.

    It ends when the demand is covered.  The best configuration binds a length in each round, which for
    one length happens 1 / step times and once for what is left, so there are no more rounds
    than that times the number of lengths.  ``rounds`` ends it earlier."""
    weights = np.arange(capacity + 1) / capacity * (demand > 0)
    weights *= 1 + 1e-6 * weights
    uncovered = demand.astype(float)
    chosen: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in repeat(None) if rounds is None else range(rounds):
        if not weights.any():
            break
        best, pick = knapsack(weights, capacity)
        kinds = np.flatnonzero(weights)[::-1]
        worth = weights[kinds] + best[capacity - kinds]
        before = np.minimum(step * demand, uncovered)
        room, least = before.copy(), NONE * demand
        for k in kinds[worth >= (1 - NEAR) * worth.max()].tolist():
            if room[k] <= least[k]:
                continue
            used = filling(pick, capacity - k)
            used[k] += 1
            if any(room[j] <= least[j] for j in used):
                continue
            times = min(room[j] / n for j, n in used.items())
            for j, n in used.items():
                room[j] -= times * n
            items = tuple(sorted(used.items(), reverse=True))
            chosen[items] = chosen.get(items, 0.0) + times
        some = np.flatnonzero(before > room)
        uncovered[some] -= (before - room)[some]
        weights[some] *= np.exp(-(before - room)[some] / demand[some] / step * RATE)
        weights[uncovered <= 2 * least] = 0
    return chosen


def rounded(chosen: dict[tuple[tuple[int, int], ...], float], left: np.ndarray) -> list[Config]:
    """Whole numbers of the configurations of ``chosen``, which are taken from ``left``: first rounded
    down, then those with the largest fractions once more while their pieces are there."""
    times = {items: 0 for items in chosen}
    whole = {items: int(t + NONE) for items, t in chosen.items()}
    some = [(items, n) for items, n in whole.items() if n]
    once = [(items, 1) for items in sorted(chosen, key=lambda x: whole[x] - chosen[x])]
    for items, n in some + once:
        n = min(n, *(int(left[k]) // m for k, m in items))
        times[items] += n
        for k, m in items:
            left[k] -= n * m
    return [Config(items, n) for items, n in times.items() if n]


def best_fit(left: np.ndarray, capacity: int, begun: Iterable[Config] = ()) -> list[Config]:
    """Pack what is left, longest first, each piece where it leaves the least space, also in the
    sequences ``begun``.  Sequences that look alike are handled together."""
    spaces: dict[int, list[list]] = {}
    done: list[Config] = []
    for items, count in begun:
        spaces.setdefault(capacity - sum(k * n for k, n in items), []).append([list(items), count])
    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            space = min((s for s in spaces if s >= length), default=None)
            if space is None:
                most = capacity // length
                new = [[[], -(-rest // most)]]
                space = capacity
            else:
                new = spaces.pop(space)
            kept = []
            for items, count in new:
                most = space // length
                full, extra = divmod(rest, most)
                full = min(full, count)
                if full:
                    spaces.setdefault(space - most * length, []).append([[*items, (length, most)], full])
                    rest, count = rest - full * most, count - full
                if count and rest and extra and rest < most:
                    spaces.setdefault(space - rest * length, []).append([[*items, (length, rest)], 1])
                    rest, count = 0, count - 1
                if count:
                    kept.append([items, count])
            for group in kept:
                if group[0]:
                    spaces.setdefault(space, []).append(group)
    for groups in spaces.values():
        done += [Config(tuple(items), count) for items, count in groups]
    return done


def plan(demand: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None, step: float = STEP) -> list[Config]:
    """Configurations that hold exactly ``demand``: the program's solution in whole numbers, never over
    what is there, then best fit for what rounding leaves."""
    left = demand.astype(np.int64).copy()
    configs = []
    if left[capacity]:
        configs.append(Config(((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    configs += rounded(fractional(left.astype(float), capacity, rounds, step), left)
    return best_fit(left, capacity, configs)


class Slots:
    """Where the n-th piece of a length goes."""

    def __init__(self, configs: list[Config]):
        rows, following, first = [], {}, 0
        for items, count in configs:
            offset = 0
            for length, many in items:
                rows.append((length, following.get(length, 0), first, many, offset))
                following[length] = following.get(length, 0) + count * many
                offset += length * many
            first += count
        self.sequences = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.table = (table[:, 0] << 48) + table[:, 1], table

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.table[np.searchsorted(self.key, (length << 48) + rank, "right") - 1]
        n = rank - at[:, 1]
        return at[:, 2] + n // at[:, 3], at[:, 4] + n % at[:, 3] * length


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs``: their ids with the end id, cut only beyond ``capacity``.  ``nth`` numbers
    the pieces of a length within ``block``, a task of the write that follows."""
    read, tail = encoded(path), np.array([end_id], "<u4").tobytes()

    def cut(batches):
        block, seen = TaskContext.get().partitionId(), {}
        rows = []

        def made():
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for doc_id, ids in read(batches):
            ids += tail
            for k in range(0, len(ids), 4 * capacity):
                part = ids[k : k + 4 * capacity]
                length = len(part) // 4
                nth = seen.get(length, 0)
                seen[length] = nth + 1
                rows.append((doc_id, k // (4 * capacity), k // 4, length, zlib.crc32(part), block, nth))
            if len(rows) >= 10_000:
                yield made()
                rows.clear()
        if rows:
            yield made()
        tidy()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """For each piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver, and only
    configurations return, whose number depends on ``capacity``, not on the
    documents.  Pieces are numbered by length from counts by block, so no length is brought together.

    Null and blank texts are one piece of the end id.  Null ids and ids that repeat are pieces like
    others.  An empty table gives no rows.  Columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or tokenizer_path(), end_id, capacity), "pack-pieces")
    by_block = stored(cut.groupBy("block", "length").count(), "pack-counts")
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in by_block.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        demand[length] = n
    slots = spark.sparkContext.broadcast(Slots(plan(demand, capacity)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.select("block", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def placed(batches):
        Encoder.forget()
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
