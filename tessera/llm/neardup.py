"""Near-duplicate vectors by an inverted multi-index: a grid of two codebooks, visited from near to far."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import graph
from tessera.llm.common import stored

#: Vectors that codebooks are fitted on, at most, and pairs that the number of visits is fitted on.
SAMPLE, PAIRS = 16_384, 2_048
#: Most numbers that a sample brings to the driver: 32 MB.
SAMPLE_NUMBERS = 1 << 22
#: Vectors of a cell on average, and most centroids of a half: 1,048,576 cells.
CELL, MOST_CENTROIDS = 256, 1_024
#: Share of the pairs at the threshold that visits are to find.
RECALL = 0.97
#: Residents or visitors of a cell that one group has, about.
BLOCK = 1_024


class Codebooks(NamedTuple):
    """Centroids of the first and of the second half of unit vectors, and the cells that each visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def cells(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """For each vector the numbers of its nearest cells, from near to far: its home first.

        Multi-sequence traversal: each half's centroids are sorted by distance; of the cells (row,
        column) next to those taken the nearest is taken, and its row's next column is open then.
        All vectors take one step at a time."""
        half, n = self.left.shape[1], len(unit)
        k = min(visits or self.visits, len(self.left) * len(self.right))
        (ia, a), (ib, b) = _sorted_distances(unit[:, :half], self.left, k), _sorted_distances(unit[:, half:], self.right, k)
        b = np.concatenate([b, np.full((n, 1), np.inf)], axis=1)
        each, column, cost = np.arange(n), np.zeros(a.shape, np.int64), a + b[:, :1]
        out = np.empty((n, k), np.int32)
        for step in range(k):
            row = cost.argmin(1)
            out[:, step] = ia[each, row] * len(self.right) + ib[each, column[each, row]]
            column[each, row] += 1
            cost[each, row] = a[each, row] + b[each, column[each, row]]
        return out


def _sorted_distances(x: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    d = (centroids * centroids).sum(1) - 2 * x @ centroids.T
    order = np.argsort(d, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(d, order, 1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centroids of the rows of ``x`` by Lloyd's rounds; one that no row is near stays as it is."""
    found = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = _sorted_distances(x, found, 1)[0][:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def fit(sample: np.ndarray, total: int, threshold: float, recall: float = RECALL) -> Codebooks | None:
    """Codebooks for ``total`` vectors from a ``sample`` of them; None where one cell holds all.

    How many cells to visit is measured: vectors of the sample are turned in random directions until
    their cosine is the threshold, and the fewest visits are taken with which ``recall`` of these
    pairs meet in the home of either.  Closer pairs meet more often."""
    k = int(min(np.sqrt(total / CELL), MOST_CENTROIDS, len(sample)))
    if k < 2 or sample.shape[1] < 2:
        return None
    rng, half = np.random.default_rng(42), sample.shape[1] // 2
    books = Codebooks(_means(sample[:, :half], k, rng), _means(sample[:, half:], k, rng), 1)
    x = sample[rng.permutation(len(sample))[:PAIRS]]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * turn
    home_x, home_y, tried = books.cells(x, 1), books.cells(y, 1), 8
    while True:
        tried = min(2 * tried, k * k)
        met = (books.cells(x, tried) == home_y) | (books.cells(y, tried) == home_x)
        found = np.logical_or.accumulate(met, axis=1).mean(0)
        if found[-1] >= recall or tried == k * k:
            return books._replace(visits=int(np.argmax(found >= recall)) + 1 if found[-1] >= recall else tried)


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: components, all of them finite numbers, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square
    overflows or vanishes."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components in one byte each, the scale of each vector, and the length of what rounding loses."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(unit - code * scale[:, None], axis=1)


def codebooks(vectors: DataFrame, threshold: float) -> dict[int, Codebooks]:
    """Codebooks for each length of ``vectors`` (vector, dim) that has enough of them.  The sample is
    the vectors with the smallest hashes, about as many as are wanted; all vectors are counted."""
    found = {}
    counts = vectors.groupBy("dim").count().where(F.col("count") >= 4 * CELL).collect()  # lengths, not rows
    for dim, total in sorted(map(tuple, counts)):
        wanted = max(2, min(SAMPLE, SAMPLE_NUMBERS // dim))
        share = int(min(1.0, wanted / total) * 2**31)
        picked = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit("sample"), "vector"), F.lit(2**31)) <= share)).limit(2 * wanted)
        fitted = fit(units(picked.select("vector").toArrow()["vector"], dim), total, threshold)
        if fitted is not None:
            found[dim] = fitted
    return found


def placed(vectors: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """``vectors`` (node, vector, dim) as (node, dim, visits, code, scale, lost): the cells that each
    visits, its home first, and its components in bytes."""

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims):
                rows = table.filter(pa.array(dims == dim))
                unit = units(rows["vector"], int(dim))
                book = books.get(int(dim))
                visits = book.cells(unit) if book else np.zeros((len(unit), 1), np.int32)
                code, scale, lost = _codes(unit)
                each = visits.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, each * len(unit) + 1, each), pa.int32()), pa.array(visits.ravel()))
                raw = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([rows["node"].combine_chunks(), rows["dim"].combine_chunks(), lists, raw, pa.array(scale), pa.array(lost)], ["node", "dim", "visits", "code", "scale", "lost"])

    return vectors.select("node", "vector", "dim").mapInArrow(place, "node long, dim int, visits array<int>, code binary, scale double, lost double")


KEY = ("dim", "cell", "rb", "vb")


def grouped(index: DataFrame) -> DataFrame:
    """Residents and visitors (dim, cell, rb, vb, guest, node) of each cell that has a resident.

    A cell with many of either is split: each block of its residents meets each block of its
    visitors, in groups of about BLOCK rows of either, however full the cell is."""
    calls = index.select("dim", "node", F.posexplode("visits").alias("turn", "cell"))
    full = calls.groupBy("dim", "cell").agg(F.count_if(F.col("turn") == 0).alias("r"), F.count("*").alias("v")).where("r > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    full = full.select("dim", "cell", blocks("r").alias("nr"), blocks("v").alias("nv"))
    rows = calls.join(full, ["dim", "cell"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = rows.select("dim", "cell", every("nr").alias("rb"), own("nv").alias("vb"), F.lit(True).alias("guest"), "node")
    hosts = rows.where("turn = 0").select("dim", "cell", own("nr").alias("rb"), every("nv").alias("vb"), F.lit(False).alias("guest"), "node")
    return guests.unionByName(hosts)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    guest = table["guest"]
    return table.filter(guest), table.filter(pc.invert(guest))


def screened(index: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``grouped`` that one of the other side may be linked with, by their codes.

    Rounding moves a product by no more than what it loses of either vector, and that much is
    allowed, so no pair at the threshold is turned away."""

    def near(a: tuple, b: tuple) -> np.ndarray:
        (x, lost_x), (y, lost_y) = a, b
        slack = lost_x[:, None] * (1 + lost_y) + lost_y * (1 + lost_x[:, None]) + lost_x[:, None] * lost_y
        return x @ y.T >= threshold - slack - 1e-5

    def screen(key: tuple, table: pa.Table) -> pa.Table:
        guests, hosts = _sides(table)
        dim = key[0].as_py()

        def read(side: pa.Table) -> tuple:
            code = np.frombuffer(b"".join(side["code"].to_pylist()), np.int8).reshape(-1, dim)
            return code.astype(np.float32) * side["scale"].to_numpy().astype(np.float32)[:, None], side["lost"].to_numpy()

        if not len(guests) or not len(hosts):
            return table.select([*KEY, "guest", "node"]).slice(0, 0)
        met = near(read(guests), read(hosts))
        met &= guests["node"].to_numpy()[:, None] != hosts["node"].to_numpy()
        keep = pa.concat_tables([guests.filter(pa.array(met.any(1))), hosts.filter(pa.array(met.any(0)))])
        return keep.select([*KEY, "guest", "node"])

    rows = grouped(index).join(index.select("node", "code", "scale", "lost"), "node")
    return rows.groupBy(*KEY).applyInArrow(screen, "dim int, cell int, rb int, vb int, guest boolean, node long")


def linked(vectors: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(node, times, a): links of vectors found in each group, weighted by how often the other vector
    is there; and a, the smallest node of those that the group links it with, directly or not.

    Cosines are of unit vectors in double precision.  A pair that meets in the homes of both is
    counted for the guest in each, one that meets once for both; so each link counts once for each
    of its ends.  Only the pairs' sums and one link a vector leave a group."""

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        guests, hosts = _sides(table)
        dim = key[0].as_py()
        if not len(guests) or not len(hosts):
            return pa.table({"node": pa.array([], pa.int64()), "times": pa.array([], pa.int64()), "a": pa.array([], pa.int64())})
        gn, hn = guests["node"].to_numpy(), hosts["node"].to_numpy()
        met = (units(guests["vector"], dim) @ units(hosts["vector"], dim).T >= threshold) & (gn[:, None] != hn)
        homes, which = np.unique(guests["home"].to_numpy(), return_inverse=True)
        back = np.stack([np.isin(homes, v) for v in hosts["visits"].to_pylist()])  # host calls at the guest's home
        once = met & ~back[:, which].T
        nodes, place = np.unique(np.concatenate([gn, hn]), return_inverse=True)
        g, h = place[: len(gn)], place[len(gn) :]
        times, least = np.zeros(len(nodes), np.int64), nodes.copy()
        np.add.at(times, g, met @ hosts["n"].to_numpy())
        np.add.at(times, h, once.T @ guests["n"].to_numpy())
        while True:  # the smallest node that links reach within the group
            before = least.copy()
            np.minimum.at(least, g, np.where(met, least[h], np.iinfo(np.int64).max).min(1))
            np.minimum.at(least, h, np.where(met, least[g][:, None], np.iinfo(np.int64).max).min(0))
            if (before == least).all():
                break
        found = np.zeros(len(nodes), bool)
        found[g], found[h] = found[g] | met.any(1), found[h] | met.any(0)
        return pa.table({"node": nodes[found], "times": times[found], "a": least[found]})

    kept = stored(screened(index, threshold), "neardup-screened")
    known = vectors.join(kept.select("node").distinct(), "node", "left_semi").select("node", "vector", "n")
    known = stored(known.join(index.select("node", "visits", F.element_at("visits", 1).alias("home")), "node"), "neardup-vectors")
    return kept.join(known, "node").groupBy(*KEY).applyInArrow(verify, "node long, times long, a long")


def _component(rows: DataFrame) -> str:
    """The type of a vector's components, doubles unless they are floats."""
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    return element if element in ("float", "double") else "double"


def near_duplicates(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row for each row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine is ``threshold`` or more and an inverted multi-index
    brings them together; links that are found are exact, and those that are missed are few (RECALL).
    Vectors are cut in halves with a codebook each, whose product is a grid of cells.  Each vector
    lies in its nearest cell and calls at the nearest ones, as many as pairs at the threshold need to meet
    in ``RECALL`` of cases.  In a cell, callers meet residents: first as bytes, then as doubles.

    Equal vectors are one until the end, so copies cost nothing and are linked with each other.
    Vectors that are null, empty, zero, or have null or non-finite components link with nothing.
    Vectors of different lengths aren't compared; a length that few vectors have is one cell.  Rows
    with equal or null ids are vectors each; the smallest id of a component isn't null unless all
    are; several rows may have it.  An empty table gives no rows; other columns are ignored."""
    told = rows.select("vec_id", F.when(valid(F.col("embedding")), F.col("embedding")).alias("vector"))
    told = told.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(_component(rows))))
    lone = told.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = told.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    vectors = stored(distinct.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}), "neardup-distinct")
    index = stored(placed(vectors, codebooks(vectors, threshold)), "neardup-index")
    found = stored(linked(vectors, index, threshold), "neardup-links")
    links = found.groupBy("node").agg(F.sum("times").alias("times"))
    groups = graph.components(found.select("node", "a").toDF("a", "b"))
    named = vectors.join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select("vector", (F.coalesce("times", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "neardup-named")
    out = told.where("vector is not null").join(named, "vector").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
