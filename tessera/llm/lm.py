"""Language-model scoring with a weighted backoff automaton whose states are n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, stored, sweep

#: Production parameters: words that the failure arcs of word states and of pair states weigh as
#: much as; how often a pair comes in training to be a state; and the bytes of text after which
#: a block of documents ends.
STRENGTHS, LEAST_PAIR, BLOCK_BYTES = (400.0, 50.0), 2, 8 << 20
#: Tokens of a text that are read one after another; longer texts are read in several runs, each from the
#: state that the words before it lead to.
RUN = 256
#: One document in so many is held out of training.
HELD_OUT = 10
#: The token after a text's last word, and the state that a text starts in.  No word is empty.
END = b""

BLOCK, WORDS, STATS, PAIRS, TRIPLES = range(5)
ROW = "kind tinyint, part int, block long, data binary"
NAMES = ["kind", "part", "block", "data"]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers below 2**63, small once compressed: byte planes of 64-bit numbers."""
    import zstandard

    out = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    out += [np.ascontiguousarray(np.asarray(a, "<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    lengths, at, out = raw[4 : 4 + 4 * n].view("<u4").tolist(), 4 + 4 * n, []
    for k in lengths:
        out.append(np.ascontiguousarray(raw[at : at + 8 * k].reshape(8, k).T).view("<u8").reshape(-1).astype(np.int64))
        at += 8 * k
    return out


def _row(kind: int, part: int, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], NAMES)


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is a multiple of HELD_OUT; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, text), as numbers of the block's own words, and for each part
    of the vocabulary the block's words with their counts in training."""
    import xxhash
    import zstandard

    number = TaskContext.get().partitionId() << 24
    ids: list = []
    tokens: list[np.ndarray] = []
    words: dict[bytes, int] = {END: 0}  # and where each is found first among the block's tokens, from 1 on
    size, at = 0, 1

    def rows():
        lengths = np.array([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        found = np.fromiter(words.values(), np.int64, len(words))
        often = np.argsort(-np.bincount(flat)[found], kind="stable")  # small numbers for frequent words
        renamed = np.empty(at, np.int64)
        renamed[found[often]] = np.arange(len(words))
        flat, names = renamed[flat], np.array(list(words), object)[often]
        part = (np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(parts)).astype(np.int64)
        listed = np.argsort(part, kind="stable")
        held = np.array([held_out(i) for i in ids])
        counts = np.bincount(flat[~np.repeat(held, lengths)], minlength=len(names))[listed]
        sizes = np.bincount(part, minlength=parts)
        null = np.array([i is None for i in ids])
        known = np.array([i or 0 for i in ids], np.int64)
        yield _row(BLOCK, 0, number, packed(known.view(np.uint64), null, held, lengths, flat, listed, [renamed[0]]))
        ends = np.cumsum(sizes)
        press = zstandard.ZstdCompressor(level=1)
        for k in np.flatnonzero(sizes).tolist():
            mine = slice(ends[k] - sizes[k], ends[k])
            said = press.compress(b"\n".join(names[listed[mine]]))
            yield _row(WORDS, k, number, len(said).to_bytes(4, "little") + said + packed(counts[mine]))

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found = (text or b"").lower().split()  # bytes: A-Z alone, and splits at [\x20\x09-\x0D]
            ids.append(doc_id)
            found.append(END)
            tokens.append(np.fromiter(map(words.setdefault, found, count(at)), np.int64, len(found)))
            at += len(found)
            size += len(text or b"") + 16
            if size >= BLOCK_BYTES:
                yield from rows()
                ids.clear(), tokens.clear()
                words, size, at, number = {END: 0}, 0, 1, number + 1
    if ids:
        yield from rows()


def _by(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows of one value of a column, by which they are sorted, together."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][column] != row[column]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def count_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each block's words of a part: their counts in all blocks and their numbers.  And a row
    of sums: tokens, words, words that came once, and twice, and the number of words listed."""
    import zstandard

    for rows in _by(batches, 1):
        known: dict[bytes, int] = {}
        seen, counted = [], []
        for _, _, _, data in rows:
            n = int.from_bytes(data[:4], "little")
            names = zstandard.ZstdDecompressor().decompress(data[4 : 4 + n]).split(b"\n")
            for w in names:
                if w not in known:
                    known[w] = len(known)
            seen.append(np.fromiter(map(known.__getitem__, names), np.int64, len(names)))
            counted.append(unpacked(data[4 + n :])[0])
        totals = np.bincount(np.concatenate(seen), weights=np.concatenate(counted), minlength=len(known)).astype(np.int64)
        for (_, part, block, _), at in zip(rows, seen, strict=True):
            yield _row(WORDS, part, block, packed(totals[at], at * parts + part))
        yield _row(STATS, rows[0][1], -1, np.array([totals.sum(), (totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum(), len(known)], "<i8").tobytes())


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of these numbers is found first, in the order of the pairs, and which of
    these each pair is.  Where pair and place fit in 63 bits they are sorted as one number."""
    span, bits = int(two.max(initial=0)) + 1, len(one).bit_length()
    key = one * span + two
    if (int(one.max(initial=0)) + 1) * span << bits >> 63:
        return np.unique(key, return_index=True, return_inverse=True)[1:]
    key = np.sort(key << bits | np.arange(len(key)))
    at = key & (1 << bits) - 1
    key >>= bits
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    which = np.empty(len(key), np.int64)
    which[at] = np.cumsum(new) - 1
    return at[new], which


class Arcs:
    """Arcs that the tokens of a block may take, of states and words with these numbers, -1 for
    none, and the block's own numbers for both, ``near``: distinct keys in the order of (part, key),
    their parts and counts in training, the first token that takes each, and each token's arc or -1.
    ``width`` is above all numbers of words."""

    def __init__(self, states: np.ndarray, words: np.ndarray, near: tuple[np.ndarray, np.ndarray], train: np.ndarray, width: int, parts: int):
        may = (states >= 0) & (words >= 0)
        if may.any() and (int(states.max()) + 1) * width >> 63:
            raise ValueError("more states and words than an arc's key holds")
        taken = np.flatnonzero(may)
        first, at = distinct(near[0][taken], near[1][taken])
        kinds = states[taken[first]] * width + words[taken[first]]
        # The remainder of a sum that depends on both; a frequent state's arcs are spread.
        part = (kinds // width * 1_000_003 % parts + kinds % width) % parts
        order = np.argsort(kinds)
        order = order[np.argsort(part[order].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
        place = np.empty(len(kinds), np.int64)
        place[order] = np.arange(len(kinds))
        self.token = np.full(len(states), -1)
        self.token[taken] = place[at]
        self.first = taken[first[order]]
        self.keys, self.part = kinds[order], part[order]
        self.counts = np.bincount(self.token[may & train], minlength=len(kinds))
        self.totals = self.numbers = np.zeros(0, np.int64)

    def learn(self, told: list[tuple[int, bytes]], parts: int) -> Arcs:
        """Take over what count_arcs() says of each part: counts in all blocks, and the numbers of
        the arcs that are states themselves."""
        totals, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, data in sorted(told):
            own, steps = unpacked(data)
            number = np.full(len(own), -1)
            if len(steps):
                number[own >= LEAST_PAIR] = np.cumsum(steps) * parts + part
            totals.append(own), numbers.append(number)
        self.totals, self.numbers = np.concatenate(totals), np.concatenate(numbers)
        assert len(self.totals) == len(self.keys)
        return self


class Block:
    """A block of documents with what is known of its words, pairs and triples."""

    def __init__(self, rows: list[tuple], width: int, parts: int):
        data = next(d for kind, _, _, d in rows if kind == BLOCK)
        known, null, held, self.lengths, self.tokens, listed, (self.end,) = unpacked(data)
        self.doc_ids, self.held = pa.array(known, pa.int64(), mask=null.astype(bool)), held.astype(bool)
        told = {k: [(part, d) for kind, part, _, d in rows if kind == k] for k in (WORDS, PAIRS, TRIPLES)}
        self.counts, self.numbers = np.empty(len(listed), np.int64), np.empty(len(listed), np.int64)
        for to, x in zip((self.counts, self.numbers), zip(*(unpacked(d) for _, d in sorted(told[WORDS])), strict=True), strict=True):
            to[listed] = np.concatenate(x)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # The word before each token, END before a text's first word.
        self.before = np.r_[0, self.tokens[:-1]]
        self.before[self.starts] = self.end
        train = ~np.repeat(self.held, self.lengths)
        number = np.where(self.counts > 0, self.numbers, -1)
        self.pairs = Arcs(number[self.before], number[self.tokens], (self.before, self.tokens), train, width, parts)
        if told[PAIRS] or not len(self.pairs.keys):
            self.pairs.learn(told[PAIRS], parts)
            ended = np.r_[-1, np.append(self.pairs.numbers, -1)[self.pairs.token][:-1]]
            ended[self.starts] = -1
            near = np.r_[-1, self.pairs.token[:-1]], self.tokens
            self.triples = Arcs(ended, number[self.tokens], near, train, width, parts)
            if told[TRIPLES] or not len(self.triples.keys):
                self.triples.learn(told[TRIPLES], parts)


def block_arcs(batches: Iterator[pa.RecordBatch], kind: int, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """For each part of the arcs those of each block, with their counts."""
    for rows in _by(batches, 2):
        block = Block(rows, width, parts)
        arcs = block.pairs if kind == PAIRS else block.triples
        cuts = np.flatnonzero(np.r_[True, arcs.part[1:] != arcs.part[:-1], True]) if len(arcs.keys) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _row(kind, int(arcs.part[a]), rows[0][2], packed(np.diff(arcs.keys[a:b], prepend=0), arcs.counts[a:b]))


def count_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's arcs of a part: their counts in all blocks and, of pairs that come often
    enough to be states, their numbers, as steps."""
    for rows in _by(batches, 1):
        told = [unpacked(d) for *_, d in rows]
        keys = [np.cumsum(k) for k, _ in told]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate([c for _, c in told])).astype(np.int64)
        number = np.cumsum(totals >= LEAST_PAIR) - 1
        for (kind, part, block, _), own in zip(rows, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            states = number[own][totals[own] >= LEAST_PAIR] if kind == PAIRS else []
            yield _row(kind, part, block, packed(totals[own], np.diff(states, prepend=0) if len(states) else states))


class Model:
    """Smoothed weights, as logarithms to the base of ten.

    Word: (count - d) / N, with d = (n1 + 1/2) / (n1 + 2 n2 + 1); all unknown words share d V / N.
    After a state: (count of the longer n-gram + s * weight after the shorter state) / (count of
    the state + s); without that n-gram it is the failure arc's s / (count + s) times the
    weight after the shorter state.  So each state's arcs sum to 1."""

    def __init__(self, tokens: int, words: int, once: int, twice: int, strengths: tuple[float, float] = STRENGTHS):
        self.tokens, self.words, self.strengths = tokens, words, strengths
        self.discount = (once + 0.5) / (once + 2 * twice + 1)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Weights of the root's arcs for words of these counts."""
        if not self.tokens:
            return np.zeros(len(counts))
        return np.log10(np.where(counts > 0, counts - self.discount, self.discount * self.words) / self.tokens)

    def fail(self, counts: np.ndarray, order: int) -> np.ndarray:
        """Weights of the failure arcs of states of ``order`` words and these counts."""
        return np.log10(self.strengths[order - 1] / (counts + self.strengths[order - 1]))

    def arc(self, longer: np.ndarray, states: np.ndarray, shorter: np.ndarray, order: int) -> np.ndarray:
        """Weights of arcs to n-grams of these counts, from states of ``order`` words and these counts,
        where the same word weighs ``shorter`` after the shorter state."""
        s = self.strengths[order - 1]
        return np.log10((longer + s * 10**shorter) / (states + s))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The plain smoothed unigram that scores are compared with."""
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States: 0 is the root; 1 + w the word w of the block, if training has it; then the pairs that
    training has LEAST_PAIR times.  An arc is kept by (state, word), with its weight and the state
    that it leads to: the longest stored one that the words read so far end with.  The failure
    arc of a pair leads to its second word, that of a word to the root, which has an arc for
    every word."""

    def __init__(self, block: Block, model: Model):
        counts, pairs, triples = block.counts, block.pairs, block.triples
        self.n_words, n_pairs = len(counts), len(pairs.keys)
        self.root = model.root(counts)
        word_state = np.where(counts > 0, 1 + np.arange(self.n_words), 0)
        self.word_state, self.begin = word_state, int(word_state[block.end])
        at = pairs.first
        one, two = block.before[at], block.tokens[at]
        pair_state = np.where(pairs.totals >= LEAST_PAIR, 1 + self.n_words + np.arange(n_pairs), word_state[two])
        self.fail_state = np.r_[np.zeros(1 + self.n_words, np.int64), word_state[two]]
        self.fail_weight = np.r_[0.0, model.fail(counts, 1), model.fail(pairs.totals, 2)]
        after_word = np.where(pairs.totals > 0, model.arc(pairs.totals, counts[one], self.root[two], 1), model.fail(counts[one], 1) + self.root[two])
        stored_pairs = pairs.totals > 0
        up = triples.first
        context, last = pairs.token[up - 1], pairs.token[up]
        stored_triples = triples.totals > 0
        after_pair = model.arc(triples.totals, pairs.totals[context], after_word[last], 2)
        self.key = np.r_[((1 + one) * self.n_words + two)[stored_pairs], ((1 + self.n_words + context) * self.n_words + block.tokens[up])[stored_triples], -1]
        self.weight = np.r_[after_word[stored_pairs], after_pair[stored_triples]]
        self.target = np.r_[pair_state[stored_pairs], pair_state[last][stored_triples]]
        self.slots = np.full(1 << (2 * len(self.key)).bit_length(), -1, np.int32)
        todo = np.arange(len(self.key) - 1)
        at = self.slot(self.key[:-1])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of those that want one slot, one gets it
            left = self.slots[at] != todo
            todo, at = todo[left], at[left] + 1 & len(self.slots) - 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        """Where arcs of these keys are looked for first: the upper bits of a product."""
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The arc of each key, or -1."""
        at = self.slot(key)
        arc = self.slots[at]
        todo = np.flatnonzero((self.key[arc] != key) & (arc >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & len(self.slots) - 1
            arc[todo] = self.slots[at[todo]]
            todo = todo[(self.key[arc[todo]] != key[todo]) & (arc[todo] >= 0)]
        return arc

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading ``word`` in ``state``, and the states that follow: failure arcs are
        taken until a state has an arc for the word."""
        weight, to = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        state = state.copy()
        while len(todo):
            now, read = state[todo], word[todo]
            at, root = self.find(now * self.n_words + read), now == 0
            hit = (at >= 0) & ~root
            weight[todo[root]] += self.root[read[root]]
            to[todo[root]] = self.word_state[read[root]]
            weight[todo[hit]] += self.weight[at[hit]]
            to[todo[hit]] = self.target[at[hit]]
            rest = ~(hit | root)
            todo = todo[rest]
            weight[todo] += self.fail_weight[now[rest]]
            state[todo] = self.fail_state[now[rest]]
        return weight, to

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each token: texts are read from left to right, many at a time, each
        with its state.  A run within a text first reads the two words before it, which no
        state looks behind."""
        runs = -(-lengths // RUN)
        text = np.repeat(np.arange(len(lengths)), runs)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        size = np.minimum(lengths[text] - first, RUN)
        order = np.argsort(-size, kind="stable")
        first, size, begin = first[order], size[order], starts[text[order]]
        weight = np.zeros(len(tokens))
        state = np.where(first <= len(self.lead), self.begin, 0)
        for back in self.lead:
            some = np.flatnonzero(first >= back)
            _, state[some] = self.step(state[some], tokens[begin[some] + first[some] - back])
        at, n = begin + first, len(size)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size[:n], -k, "left"))  # those longer than k
            weight[at[:n] + k], state[:n] = self.step(state[:n], tokens[at[:n] + k])
        return weight

    #: Words before a run that lead to its state, as far as states reach.
    lead = (2, 1)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def block_scores(batches: Iterator[pa.RecordBatch], width: int, parts: int, sums: list[int], strengths: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of each block."""
    model = Model(*sums, strengths)
    for rows in _by(batches, 2):
        block = Block(rows, width, parts)
        rows.clear()
        automaton = Automaton(block, model)
        del block.pairs, block.triples
        weights = automaton.traverse(block.tokens, block.starts, block.lengths)
        del automaton
        counts = block.counts[block.tokens]
        total = lambda x: np.add.reduceat(x, block.starts)
        n = len(block.lengths)
        yield pa.RecordBatch.from_arrays(
            [block.doc_ids, pa.array(block.held), pa.array(block.lengths), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(n, sums[0])), pa.array(total(model.base(counts))), pa.array(total(weights))],
            [x.split()[0] for x in SCORES.split(", ")],
        )


def score(docs: DataFrame, strengths: tuple[float, float] = STRENGTHS) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are read in blocks.  Counts of words, of word pairs, and of the words after pairs that
    are states are summed up by parts of the vocabulary and sent back to the blocks that
    asked for them, so each block has just the states and arcs that its texts can reach; no worker
    holds the whole model.  A block asks once for a word or an arc, however often it has it, so a
    frequent one is a row a block, and the arcs of one state are spread over parts.

    Null and blank texts are the end token alone.  Null ids are held out.  Repeated rows count as
    often as they are there.  Without training texts all scores are 0.  An empty table gives no
    rows; columns other than doc_id and text are ignored."""
    n = partitions(docs.sparkSession)
    rows = stored(docs.select("doc_id", "text").mapInArrow(lambda b: blocks(b, n), ROW), "lm-blocks", "kind", codec="none").select(*NAMES)
    texts = rows.where(F.col("kind") == BLOCK)
    dealt = lambda df, *by: df.repartition(n, by[0]).sortWithinPartitions(*by)
    words = stored(dealt(rows.where(F.col("kind") == WORDS), "part").mapInArrow(lambda b: count_words(b, n), ROW), "lm-words", "kind", codec="none").select(*NAMES)
    sums, longest = [0, 0, 0, 0], 0
    for row in words.where(F.col("kind") == STATS).toLocalIterator():  # a row for each part
        *own, listed = np.frombuffer(row["data"], "<i8").tolist()
        sums, longest = [a + b for a, b in zip(sums, own, strict=True)], max(longest, listed)
    width = longest * n
    known = texts.unionByName(words.where(F.col("kind") == WORDS))
    for kind in (PAIRS, TRIPLES):
        arcs = dealt(known, "block").mapInArrow(lambda b, kind=kind: block_arcs(b, kind, width, n), ROW)
        known = known.unionByName(stored(dealt(arcs, "part").mapInArrow(count_arcs, ROW), "lm-arcs", codec="none"))
        del arcs
        sweep(docs.sparkSession)
    return dealt(known, "block").mapInArrow(lambda b: block_scores(b, width, n, sums, strengths), SCORES)
