"""N-gram Jaccard join by prefixes under several global orders of the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, stored, tidy
from tessera.llm.graph import components as connected

#: Production parameters: words of a shingle, and the similarity as a fraction.
WORDS, TOP, BOTTOM = 5, 80, 100
#: Tokens that two linked documents share within their prefixes of an order, as a share of the
#: smaller set (1/10): prefixes are longer by as much.
SHARED = 10
#: Leaders of a token's sets in the first round after the most central ones; then 8 times as many.
LEADERS = 8
#: Tokens with so many documents in one chunk are dealt out by chunk.
HOT, CHUNK = 64, 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Another order of 64-bit tokens: a bijection, so orders have no ties."""
    x = x ^ np.uint64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit tokens of texts: the distinct shingles of lower-cased (A-Z) words; with fewer
    words than a shingle has, the whole sequence is the one token; without words none.  Words and
    shingles are told apart by 64-bit hashes."""

    MOST = 150_000

    def __init__(self, n: int = WORDS):
        self.n, self.words = n, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        found = (text or b"").lower().split()  # bytes: A-Z alone, and splits at [\x20\x09-\x0D]
        known = self.words
        if len(known) > self.MOST:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if not len(ids):
            return ids
        n = min(self.n, len(ids))
        token = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            token = mixed(token * _A + ids[k : len(ids) - n + 1 + k])
        token.sort()
        return token[np.r_[True, token[1:] != token[:-1]]]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever the order of its tokens."""
    n = np.uint64(len(tokens))
    both = np.bitwise_xor.reduce(mixed(tokens, 7), keepdims=True) * _B + n, tokens.sum(keepdims=True) * _C + n
    node, more = (int(mixed(x).view(np.int64)[0]) for x in both)
    return node, more


def least_overlap(n, top: int = TOP, bottom: int = BOTTOM):
    """Tokens that a set of n shares at least with any set that it is linked with."""
    return -(-n * top // bottom)


def assured(n):
    """Tokens within their prefixes that a set of n shares at least with any set it is linked with.

    Sets of n and m share 4/9 (n + m) tokens, at 80 %, and all but the rest of the longer one lie in
    both prefixes.  That is least for the smallest partner, 4/5 n, where n // SHARED are left; one
    is taken off for what is rounded."""
    return np.maximum(n // SHARED - 1, 1)


def prefix_length(n, top: int = TOP, bottom: int = BOTTOM):
    """Linked sets share max(1, n // SHARED) of their first so many tokens, under any order; n is
    the smaller size.  A larger set's prefix is the longer one, so it holds for both."""
    return np.minimum(n, n - least_overlap(n, top, bottom) + np.maximum(n // SHARED, 1))


DOC, POSTING, COUNT, HOT_POSTING = range(4)
ROW = "kind tinyint, deal long, token long, node long, n int, doc_id long, more long"


def first_order(batches: Iterator[pa.RecordBatch], words: int, top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """For each document a DOC row, and for each set of a chunk POSTING rows of its prefix under
    the order of hashes.  A token of many sets of a chunk is dealt out by chunk, as HOT_POSTING
    rows, with a COUNT row that says how many.  ``node`` and ``more`` name a set."""
    shingle = Shingler(words)
    docs: list[tuple] = []
    prefixes: list[np.ndarray] = []
    nodes: dict[tuple[int, int, int], int] = {}
    held, salt = 0, 0

    def rows():
        nonlocal salt
        doc_ids, sigs, mores, sizes, keys = zip(*docs, strict=True)
        m = len(docs)
        seed = np.uint64(hash((doc_ids[0], sigs[0], m)) & 0xFFFFFFFF)
        anywhere = mixed(np.arange(m, dtype=np.uint64) + (seed << np.uint64(32)), 5).view(np.int64)  # equal sets too are spread
        yield _rows(np.full(m, DOC), anywhere, np.array(keys, np.int64), np.array(sigs, np.int64), np.array(sizes), pa.array(doc_ids, pa.int64()), pa.array(mores, pa.int64()))
        if not prefixes:
            return
        sets = list(nodes)
        lengths = [len(p) for p in prefixes]
        token = np.concatenate(prefixes).view(np.int64)
        node = np.repeat(np.array([x for x, _, _ in sets], np.int64), lengths)
        size = np.repeat(np.array([k for _, _, k in sets]), lengths)
        kinds, where, counts = np.unique(token, return_inverse=True, return_counts=True)
        often = counts[where] >= HOT
        salt += 1
        spread = mixed(token.view(np.uint64) + np.uint64(hash((doc_ids[0], sigs[0], salt)) & 0xFFFFFFFF), 3).view(np.int64)
        yield _rows(np.where(often, HOT_POSTING, POSTING), np.where(often, spread, token), token, node, size)
        if often.any():
            hot = counts >= HOT
            yield _rows(np.full(hot.sum(), COUNT), kinds[hot], kinds[hot], np.zeros(hot.sum(), np.int64), counts[hot])

    for batch in batches:
        for doc_id, text, text_key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tokens = shingle(text)
            n = len(tokens)
            name = *signature(tokens), n
            docs.append((doc_id, *name, text_key))
            if n and name not in nodes:
                nodes[name] = 1
                prefixes.append(tokens[: int(prefix_length(n, top, bottom))])
                held += len(prefixes[-1])
            if held > CHUNK or len(docs) > CHUNK // 4:
                yield from rows()
                docs.clear(), prefixes.clear(), nodes.clear()
                held = 0
    if docs:
        yield from rows()
    docs.clear(), prefixes.clear(), nodes.clear()
    tidy()


def _rows(kind, deal, token, node, n, doc_id=None, more=None) -> pa.RecordBatch:
    none = pa.nulls(len(kind), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int8()), pa.array(deal), pa.array(token), pa.array(node), pa.array(n, pa.int32()), none if doc_id is None else doc_id, none if more is None else more],
        ["kind", "deal", "token", "node", "n", "doc_id", "more"],
    )


def whole_keys(batches: Iterator[pa.RecordBatch], column: int, least: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``column`` in batches of ``least`` rows or more that split no key."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least or not batch.num_rows:
            continue
        one = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = one.column(column).to_numpy()
        end = int(np.searchsorted(key, key[-1], "left"))
        if end:
            yield one.slice(0, end)
        held, rows = [one.slice(end)], one.num_rows - end
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``deal`` and ``node``, the documents, and the postings of tokens that
    several sets have; a token that is hot anywhere is one of several sets."""
    for batch in whole_keys(batches, 1):
        kind, deal, _, node = (batch.column(k).to_numpy() for k in range(4))
        new = np.r_[True, deal[1:] != deal[:-1]]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        posting = kind == POSTING
        seen = np.minimum.reduceat(np.where(posting, node, np.iinfo(np.int64).max), start)[group], np.maximum.reduceat(np.where(posting, node, np.iinfo(np.int64).min), start)[group]
        several = (np.add.reduceat((kind == COUNT).astype(np.int64), start)[group] > 0) | (seen[0] < seen[1])
        once = np.r_[True, ~((deal[1:] == deal[:-1]) & (node[1:] == node[:-1]) & posting[1:] & posting[:-1])]
        yield batch.filter(pa.array((kind == DOC) | (kind == HOT_POSTING) | (posting & several & once)))


def set_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, more, n, tokens) of the documents (text, node, more), whose sets these are."""
    shingle = Shingler(words)
    for batch in batches:
        for text, node, more in zip(batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
            tokens = shingle(text)
            if signature(tokens) == (node, more):
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([more]), pa.array([len(tokens)], pa.int32()), pa.array([tokens.tobytes()], pa.binary())], ["node", "more", "n", "tokens"])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, n) of sets (id, n, tokens)."""
    for batch in batches:
        ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = np.cumsum(n, dtype=np.int64)
        at = 0
        while at < len(ids):  # of a few million tokens at a time, or one set
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * CHUNK, "right")))
            token = np.frombuffer(b"".join(batch.column(2).slice(at, to - at).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(ids[at:to], n[at:to])), pa.array(np.repeat(n[at:to], n[at:to]))], ["token", "id", "n"])
            at = to


PREFIX, SET = range(2)
ORDERED = "kind tinyint, id long, n int, token long, left int, weight long, beyond int, third array<long>, fourth array<long>"


def orders(batches: Iterator[pa.RecordBatch], top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """Of (id, n, token, df) rows sorted by set, for each set that shares enough tokens with others:
    PREFIX rows of its prefix under the rarest-first order, with the number of shared tokens that
    are ``left`` from there on, and a SET row with its prefixes under two more orders and the
    number of shared tokens ``beyond`` those."""
    for batch in whole_keys(batches, 0, 2 * CHUNK):
        ids, n, token, df = (batch.column(k).to_numpy() for k in range(4))
        new = np.r_[True, ids[1:] != ids[:-1]]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        have = np.diff(np.r_[start, len(ids)])
        keep = (have >= least_overlap(n[start], top, bottom))[group]
        if not keep.any():
            continue
        ids, n, token, df = ids[keep], n[keep].astype(np.int64), token[keep].view(np.uint64), df[keep]
        new = np.r_[True, ids[1:] != ids[:-1]]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        have = np.diff(np.r_[start, len(ids)])
        place = np.arange(len(ids)) - start[group]
        least = least_overlap(n[start], top, bottom)
        weight = np.add.reduceat(df, start)
        by = np.lexsort((mixed(token, 1), df, group))
        low = np.flatnonzero(have[group] - place >= least[group])
        yield _ordered(PREFIX, ids[low], n[low], token[by][low].view(np.int64), (have[group] - place)[low], weight[group][low])
        length = np.minimum(have, have - least + 1 + n[start] // SHARED)
        lists = []
        for seed in (11, 12):
            by = np.lexsort((mixed(token, seed), group))
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(token[by][place < length[group]].view(np.int64))))
        yield _ordered(SET, ids[start], n[start], beyond=have - length, lists=lists)


def _ordered(kind, ids, n, token=None, left=None, weight=None, beyond=None, lists=None) -> pa.RecordBatch:
    none = lambda x, t: pa.nulls(len(ids), t) if x is None else pa.array(x, t)
    third, fourth = lists or [pa.nulls(len(ids), pa.list_(pa.int64()))] * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), kind), pa.int8()), pa.array(ids), pa.array(n, pa.int32()), none(token, pa.int64()), none(left, pa.int32()), none(weight, pa.int64()), none(beyond, pa.int32()), third, fourth],
        ["kind", "id", "n", "token", "left", "weight", "beyond", "third", "fourth"],
    )


def compared(batches: Iterator[pa.RecordBatch], top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, tokens of a, tokens of b) that are linked."""
    for batch in batches:
        links = []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if bottom * both >= top * (len(x) + len(y) - both):
                links.append((a, b))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def fits(left_a, left_b, n_a, n_b, top: int, bottom: int):
    """Whether sets whose first common token has so many tokens left can share what a link takes."""
    return (top + bottom) * F.least(left_a, left_b) >= top * (n_a + n_b)


def centres(postings: DataFrame, top: int, bottom: int) -> DataFrame:
    """Pairs (a, b) of each set of a token with the token's most central set of about its size: the one
    whose tokens are in the most other sets.  The base of a group of near copies is such a set,
    and is linked with all that are linked with any other."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(bottom / top)))
    sized = postings.withColumn("band", band)
    first = sized.groupBy("token", "band").agg(F.max(F.struct("weight", "id", "n", "left")).alias("c"))
    near = first.select("token", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"), F.col("c.id").alias("id_c"), F.col("c.n").alias("n_c"), F.col("c.left").alias("left_c"))
    both = sized.join(near, ["token", "band"]).where((F.col("id") != F.col("id_c")) & fits(F.col("left"), F.col("left_c"), F.col("n"), F.col("n_c"), top, bottom))
    return both.select(F.least("id", "id_c").alias("a"), F.greatest("id", "id_c").alias("b")).distinct()


def between(open_: DataFrame, turn: int, top: int, bottom: int) -> DataFrame:
    """Pairs (a, b) of each set of an open token with the token's leaders of other components."""
    told = open_.withColumn("leads", leads(turn))
    one = told.where("leads").select("token", *(F.col(k).alias(f"{k}_c") for k in ("id", "n", "left", "label")))
    both = told.join(one, "token").where((F.col("label") != F.col("label_c")) & (~F.col("leads") | (F.col("id") > F.col("id_c"))) & fits(F.col("left"), F.col("left_c"), F.col("n"), F.col("n_c"), top, bottom))
    return both.select(F.least("id", "id_c").alias("a"), F.greatest("id", "id_c").alias("b")).distinct()


def leads(turn: int) -> Column:
    """A share of a token's ``many`` sets that makes about LEADERS * 8**turn; all, if there are fewer."""
    chance = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return chance * F.col("many") < LEADERS * 8**turn


def linked(ordered: DataFrame, sets: DataFrame, top: int, bottom: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all sets that links connect, and the (node, component) they make."""
    postings = ordered.where(F.col("kind") == PREFIX).select("token", "id", "n", "left", "weight")
    # Of a token's sets, those that fit the least size and the greatest reach among them.
    reach = lambda left: F.floor(left * (top + bottom) / top) - F.col("n")
    told = postings.groupBy("token").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max(reach(F.col("left"))).alias("reach"))
    some = postings.join(told.where("many > 1"), "token").where((F.col("least") <= reach(F.col("left"))) & (F.col("n") <= F.col("reach")))
    postings = stored(some.drop("many", "least", "reach"), "jaccard-postings")
    lists = ordered.where(F.col("kind") == SET)
    u, v = (lists.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "beyond", "third", "fourth"))) for k in "ab")
    x, y = (sets.select(F.col("id").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "ab")
    # What two sets share lies in both prefixes, or beyond the one that ends first.
    least = F.ceil((F.col("n_a") + F.col("n_b")) * top / (top + bottom)) - F.greatest("beyond_a", "beyond_b")
    meet = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b")) >= F.greatest(F.lit(1), least)
    pairs, links, tried, turn = centres(postings, top, bottom), None, None, 0
    while True:
        made = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        tried = made if tried is None else tried.unionByName(made)
        kept = made.join(u, "a").join(v, "b").where(meet("third") & meet("fourth")).select("a", "b")
        found = kept.join(x, "a").join(y, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(lambda b: compared(b, top, bottom), "a long, b long")
        found = stored(found, "jaccard-links")
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = stored(connected(links), "jaccard-labels")
        if turn:
            postings = rest.where(~leads(turn)).drop("many", "label")
        rest = postings.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        split = rest.groupBy("token").agg(F.count("*").alias("many"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token", "many")
        rest = stored(rest.join(split, "token"), "jaccard-groups")
        if rest.isEmpty():
            return links, labels
        turn += 1
        pairs = between(rest, turn, top, bottom)


def components(docs: DataFrame, words: int = WORDS, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles (size of its set) and component_id, the smallest
    id that can be reached by links.  See labelled()."""
    return labelled(docs, words, top, bottom).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, words: int = WORDS, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """The same with text_key, a hash of the row's text, and label, which names a component even
    where ids are null or repeat.  Sets are linked when bottom * intersection >= top * union.

    1.  First order, by hash: each set's prefix is dealt out by token.  Linked sets share a given
        number of the tokens there (see prefix_length), so a set with fewer tokens that others
        have too is linked with nothing but equal sets, and most sets go.
    2.  Of the sets that are left, all tokens are counted.  A set that shares less than 80 % of its
        tokens with others goes: sets with a passage in common that aren't alike end here.
    3.  Second order, rarest first, over the shared tokens: two sets are candidates by a token
        only if the tokens that both have left from there on suffice for both sizes.
    4.  Candidates must share enough tokens of the prefixes under a third and a fourth order, by
        hash, before their whole sets are compared.
    5.  First each set of a token meets the most central one of about its size; components of these
        links are made.  Then, in tokens whose sets lie in several components, sets of different
        components meet, by a growing number of leaders, until all have met or are in one
        component: no link between components is missed, and no pairs are made within one.

    What is quadratic: sets of one token that fit by size and by shared tokens, but aren't linked
    even through others.  Documents with equal sets are one node from the start, told apart by
    128 bits.  Texts without words, null ones too, have size 0 and are linked with nothing;
    their component is their own id.  Null ids count only if a component has no other, which is
    then null.  Repeated rows are equal sets.  An empty table gives no rows; other columns are
    ignored."""
    n_parts = partitions(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    dealt = keyed.mapInArrow(lambda b: first_order(b, words, top, bottom), ROW).repartition(n_parts, "deal").sortWithinPartitions("deal", "node").mapInArrow(shared_only, ROW)
    rows = stored(dealt.drop("deal"), "jaccard-first", "kind")
    each = rows.where(F.col("kind") == DOC).select("doc_id", "node", "more", "n", F.col("token").alias("text_key"))
    need = F.greatest(F.floor(F.col("n") / SHARED) - 1, F.lit(1))  # as assured()
    have = rows.where(F.col("kind").isin(POSTING, HOT_POSTING)).groupBy("node", "n").agg(F.count("*").alias("have")).where(F.col("have") >= need)
    first = each.where("n > 0").join(have, ["node", "n"], "left_semi").groupBy("node", "more").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    wanted = first.select("node", "more", F.col("first.doc_id").alias("id_"), F.col("first.text_key").alias("key_"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).select("text", "node", "more")
    sets = texts.mapInArrow(lambda b: set_rows(b, words), "node long, more long, n int, tokens binary").dropDuplicates(["node", "more"])
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "jaccard-sets", codec="none")
    tokens = sets.select("id", "n", "tokens").mapInArrow(token_rows, "token long, id long, n int")
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token").select("id", "n", "token", "df")
    ordered = stored(shared.repartition(n_parts, "id").sortWithinPartitions("id").mapInArrow(lambda b: orders(b, top, bottom), ORDERED), "jaccard-ordered", "kind")
    _, nodes = linked(ordered, sets, top, bottom)
    of_set = sets.join(nodes.withColumnRenamed("node", "id"), "id").select("node", "more", "component")
    named = each.where("n > 0").groupBy("node", "more").agg(F.min("doc_id").alias("least")).join(of_set, ["node", "more"], "left")
    reached = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(reached, "component", "left").select(
        "node",
        "more",
        F.coalesce(F.concat(F.lit("c"), F.col("component")), F.concat_ws("/", "node", "more")).alias("label"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"),
    )
    named = stored(named, "jaccard-named")
    full = each.where("n > 0").join(named, ["node", "more"]).select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "label")
    return full.unionByName(each.where("n = 0").select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("label")))
