"""Token ids and a binary token file: each document compressed apart, with one shared dictionary."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, shared_dir, tidy

#: Words whose ids an encoder remembers, at most and twice over; see Kept.
MOST_WORDS = 600_000
#: Marks after a word that the tokenizer splits off if a letter comes before them.
MARKS = ".,:;!?"
#: Texts are split into words in chunks of so many bytes.
CHUNK_BYTES = 16 << 20
#: The dictionary is fitted on the documents with the smallest hashes of their ids: so many, and of
#: these on those up to so many bytes of ids.  Every document is then compressed with it.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, DICTIONARY_BYTES = 2000, 1 << 18, 1 << 16
#: A segment, one row of the file, ends at so many bytes of frames or so many documents.
SEGMENT_BYTES, SEGMENT_DOCS, LEVEL = 1 << 20, 1 << 13, 3

#: One entry of a segment's offset index; the frame ends where the next one starts.
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """A dict of bounded size that forgets what wasn't asked for since it last filled up."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def lacking(self, keys: list) -> list:
        """Those of the distinct ``keys`` that aren't known; what only the older half knows is taken
        over first."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            self.old, new = dict(self), keys
            self.clear()
        old = self.old
        self.update((k, old[k]) for k in new if k in old)
        return [k for k in new if k not in old]


class Ragged:
    """Arrays of ids one after another: ``flat`` with the lengths of each."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, items: list[bytes]) -> Ragged:
        lengths = np.fromiter(map(len, items), np.int64, len(items)) // 4
        return cls(np.frombuffer(b"".join(items), "<u4"), lengths)

    def take(self, which: np.ndarray) -> Ragged:
        lengths = self.lengths[which]
        at = np.repeat(self.starts[which] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return Ragged(self.flat[at], lengths)

    def followed_by(self, other: Ragged) -> Ragged:
        """Each array with the other's after it."""
        both = Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))
        n = len(self.lengths)
        taken = both.take(np.stack([np.arange(n), np.arange(n) + n], 1).ravel())
        return Ragged(taken.flat, self.lengths + other.lengths)


class Encoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers.

    The tokenizer drops white space before it splits, and never joins what white space separates,
    so the ids of a text are those of its words, one after another, and a word that comes often is
    tokenized once.  Of a word, marks after a final ASCII letter are split off as the tokenizer
    does, and ASCII capitals are lowered as it does, so that forms of a word share an entry.  This
    holds for tokenizers that lower case and drop white space; ``by_word`` is False for others."""

    _kept: dict = {}

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.stems = Kept(MOST_WORDS)

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> Encoder:
        """The one encoder of this worker process."""
        if (path, by_word) not in cls._kept:
            cls._kept[path, by_word] = cls(path, by_word)
        return cls._kept[path, by_word]

    @classmethod
    def forget(cls) -> None:
        """Let go of this worker's encoders, once all texts are encoded."""
        cls._kept.clear()
        tidy()

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in done]

    def _known(self, stems: list[str]) -> Ragged:
        """Ids of distinct stems.  New plain ones are tokenized as one text, whose tokens are dealt
        to stems by their places."""
        new = self.stems.lacking(stems)
        other = [x for x in new if not x.isascii() or "<|" in x]
        self.stems.update(zip(other, self._encode(other), strict=True))
        plain = [x for x in new if x.isascii() and "<|" not in x]
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, at = np.array(done.ids, "<u4").tobytes(), np.fromiter((a for a, _ in done.offsets), np.int64, len(done.ids))
            cuts = (np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in some)])) * 4).tolist()
            self.stems.update(zip(some, (ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
        return Ragged.of(list(map(self.stems.__getitem__, stems)))

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct words."""
        low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        cut = pc.ascii_rtrim(low, characters=MARKS)
        apart = pc.and_(pc.match_substring_regex(cut, "[a-z]$"), pc.invert(pc.match_substring(low, "<|")))
        stem = pc.if_else(apart, cut, low)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(low), pc.binary_length(stem)).to_numpy(zero_copy_only=False))
        at = pa.array(marked)
        ends = [x[n:] for x, n in zip(low.take(at).to_pylist(), pc.utf8_length(stem.take(at)).to_pylist(), strict=True)]
        stem, mark = stem.dictionary_encode(), pa.array(["", *ends]).dictionary_encode()
        which = np.zeros(len(words), np.int64)  # "" is the first mark
        which[marked] = mark.indices.to_numpy()[1:]
        ids, tails = self._known(stem.dictionary.to_pylist()), Ragged.of(self._encode(mark.dictionary.to_pylist()))
        return ids.take(stem.indices.to_numpy()).followed_by(tails.take(which))

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            yield from (self._encode([x])[0] for x in texts.to_pylist())
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, "right")))
            split = pc.ascii_split_whitespace(texts.slice(first, last - first))  # at runs of [\x20\x09-\x0D]
            words = split.flatten().dictionary_encode()
            ids = self._words(words.dictionary).take(words.indices.to_numpy())
            ends = np.r_[0, np.cumsum(ids.lengths)][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            yield from (ids.flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False))
            first = last


def encoded(path: str, by_word: bool = True):
    """Function of Arrow batches (doc_id, text, ...) to (doc_id, packed ids of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
        encode = Encoder.of(path, by_word)
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True)

    return run


class Dictionary(NamedTuple):
    data: bytes
    hash: str

    @classmethod
    def of(cls, data: bytes) -> Dictionary:
        return cls(data, hashlib.sha256(data).hexdigest())


def fit_dictionary(docs: DataFrame, path: str, end_id: int, width: int = 2, by_word: bool = True) -> Dictionary:
    """The shared dictionary, fitted in one task on the bounded sample named above.

    With too little to train on, the sampled ids themselves are the dictionary."""
    read, tail = encoded(path, by_word), np.array([end_id], "<u4").tobytes()
    order = F.xxhash64("doc_id")
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(order, "doc_id").limit(SAMPLE_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def frames(batches):
        for _, ids in read(batches):
            if len(ids) * width // 4 <= SAMPLE_DOC_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(ids + tail, "<u4").astype(f"<u{width}").tobytes()], pa.binary())], ["ids"])

    def fit(batches):
        import zstandard

        texts = sorted(x for b in batches for x in b.column(0).to_pylist())
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(texts)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["dictionary"])

    rows = sample.mapInArrow(frames, "ids binary").repartition(1).mapInArrow(fit, "dictionary binary").collect()  # one row
    return Dictionary.of(bytes(rows[0][0]) if rows else b"")


def write(docs: DataFrame, out: str, path: str, end_id: int, width: int = 2, by_word: bool = True) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order under the folder ``out``.

    ``out``/segments: Parquet of segments in file order, each a row of (part, seq, start, n_docs,
    n_ids, first_id, last_id, width, dictionary_hash, index, frames).  ``frames`` are zstandard
    frames, one a document; ``index`` is an array of ENTRY, so a short document is read by
    itself.  ``start`` counts the ids of the part before the segment.  ``out``/dictionary: one row.
    Spark's own writer commits the files, so a lost executor or a repeated task leaves no
    half-written file.  ``width`` is the bytes of a stored id (2 for vocabularies up to 65,536)."""
    dictionary = fit_dictionary(docs, path, end_id, width, by_word)
    spark = docs.sparkSession
    spark.createDataFrame([(dictionary.hash, bytearray(dictionary.data))], "hash string, data binary").coalesce(1).write.parquet(f"{out}/dictionary")
    read, tail = encoded(path, by_word), np.array([end_id], "<u4").tobytes()

    def segments(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary.data)
        if dictionary.data:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared if dictionary.data else None, write_dict_id=False)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        entries, frames, size, n = [], [], 0, 0

        def row():
            index = np.array(entries, ENTRY)
            ids = [None if e[1] else e[0] for e in (entries[0], entries[-1])]
            values = [part, seq, start, len(entries), n, *ids, width, dictionary.hash, index.tobytes(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SEGMENT, strict=True)], schema=SEGMENT)

        for doc_id, ids in read(batches):
            whole = np.frombuffer(ids + tail, "<u4")
            if width < 4 and int(whole.max()) >> (8 * width):
                raise ValueError(f"an id doesn't fit in {width} bytes")
            frame = packer.compress(whole.astype(f"<u{width}").tobytes())
            entries.append((doc_id or 0, doc_id is None, size, len(whole)))
            frames.append(frame)
            size, n = size + len(frame), n + len(whole)
            if size >= SEGMENT_BYTES or len(entries) >= SEGMENT_DOCS:
                yield row()
                seq, start = seq + 1, start + n
                entries, frames, size, n = [], [], 0, 0
        if entries:
            yield row()

    rows = docs.select("doc_id", "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(segments, SEGMENT_DDL).write.option("compression", "none").parquet(f"{out}/segments")


SEGMENT_DDL = "part int, seq int, start long, n_docs int, n_ids long, first_id long, last_id long, width int, dictionary_hash string, index binary, frames binary"
SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32()), ("dictionary_hash", pa.string()), ("index", pa.binary()), ("frames", pa.binary())])


def dictionary_of(spark: SparkSession, out: str) -> Dictionary:
    """The file's dictionary: one row of bounded size."""
    row = spark.read.parquet(f"{out}/dictionary").first()
    return Dictionary(bytes(row["data"]), row["hash"])


def _opened(dictionary: Dictionary, found: str):
    import zstandard

    if found != dictionary.hash:
        raise ValueError(f"segment was written with dictionary {found}, not {dictionary.hash}")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary.data) if dictionary.data else None)


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Every document of the file: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 of its ids as little-endian unsigned 32-bit integers, and ids on request."""
    dictionary = dictionary_of(spark, out)
    rows = spark.read.schema(SEGMENT_DDL).parquet(f"{out}/segments")
    # One row for each part that was written: as many as the writer had partitions.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def decode(batches):
        Encoder.forget()
        for batch in batches:
            for row in batch.to_pylist():
                index, frames, opened = np.frombuffer(row["index"], ENTRY), memoryview(row["frames"]), _opened(dictionary, row["dictionary_hash"])
                ends = [*index["offset"][1:].tolist(), len(frames)]
                n = index["n_tokens"].astype(np.int64)
                starts = row["base"] + row["start"] + np.cumsum(n) - n
                whole = [np.frombuffer(opened.decompress(frames[a:b]), f"<u{row['width']}").astype("<u4") for a, b in zip(index["offset"].tolist(), ends, strict=True)]
                if any(len(x) != k for x, k in zip(whole, n, strict=True)):
                    raise ValueError("a frame doesn't hold as many ids as its index says")
                columns = [pa.array(index["id"], mask=index["null"].astype(bool)), pa.array(starts), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in whole], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in whole], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return rows.join(F.broadcast(bases), "part").select("base", "start", "width", "dictionary_hash", "index", "frames").mapInArrow(decode, ddl)


def lookup(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """Ids of one document, or of each that has this id, by the index: Parquet skips all segments
    but those whose range holds it, and of these only the document's own frame is decompressed."""
    dictionary = dictionary_of(spark, out)
    rows = spark.read.schema(SEGMENT_DDL).parquet(f"{out}/segments").where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    found = []
    for row in rows.orderBy("part", "seq").toLocalIterator():
        index = np.frombuffer(bytes(row["index"]), ENTRY)
        starts = index["offset"].tolist()
        for k in np.flatnonzero((index["id"] == doc_id) & (index["null"] == 0)).tolist():
            frame = bytes(row["frames"][starts[k] : [*starts, len(row["frames"])][k + 1]])
            found.append(np.frombuffer(_opened(dictionary, row["dictionary_hash"]).decompress(frame), f"<u{row['width']}").tolist())
    return found


def encode_to_file(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new token file in the shared folder and read every document back.

    Null and blank texts have the end id alone.  Null ids come first.  Rows that repeat an id each
    have a place, next to each other, in the order of a hash of the text.  An empty table makes a
    file without documents.  Columns other than doc_id and text are ignored."""
    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, out, path or tokenizer_path(), end_id)
    return read(docs.sparkSession, out)
