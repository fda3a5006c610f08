"""Token ids of documents as binary shards with one shared compression dictionary.

A shard holds, in this order: ``MAGIC``, the SHA-256 of the dictionary, one
zstandard frame per document, the index (Arrow file format: doc_id, end of the
frame, number of tokens, check of the text), the length of the index as eight
bytes, ``MAGIC``.  A frame is the little-endian unsigned 32-bit ids of one
document, so each document can be read alone; the dictionary makes short ones
small.  Numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, bounded_sample, text_check
from dayloom.llm.spans import _table, slices, words_of

MAGIC = b"DLTOKEN1"
END_ID = 2
LEVEL = 3
#: The dictionary is made from the first ids of at most so many documents.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 32 << 10
#: A shard is closed when its ids exceed this size.
SHARD_BYTES = 128 << 20
#: Words in each of the two tables of ids that a Python worker keeps.
CACHE_WORDS = 800_000
BATCH = 2048

NOT_SPACE = _table([(0x20, 0x20)], False)

INDEX = pa.schema([("doc_id", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("tk", pa.int32())])


class WordTable:
    """Ids of words by 64-bit hash and a 32-bit check of the word, as sorted arrays."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begins, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *ids])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        for name, new in (("checks", checks), ("begins", begins), ("sizes", sizes)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])


class Encoder:
    """Ids of whole texts by a file of the tokenizers library.

    Its byte-level pre-tokenizer always begins a new piece at a space that
    something other than white space follows, and pieces are encoded one by one.
    So a text without double spaces and special tokens is encoded word by word.
    Each different word of a slice is looked up in a table, and the library
    encodes those that are not there.  When the table is full it becomes the old
    one, from which words that come again are copied.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = {c: self._ids([c])[0] for c in ".,"}
        self.young, self.old = WordTable(), WordTable()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """In small batches: the library's encodings are many times larger than their ids."""
        return [np.array(e.ids, "<u4") for lo in range(0, len(texts), BATCH)
                for e in self.tokenizer.encode_batch(texts[lo:lo + BATCH], add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of a space and each word.  Letters and a mark behind them are pieces of their own."""
        marked = [w[-1:] in self.ends and w[:-1].isalpha() for w in words]
        ids = self._ids([f" {w[:-1] if m else w}" for w, m in zip(words, marked)])
        return [np.concatenate([x, self.ends[w[-1]]]) if m else x for x, w, m in zip(ids, words, marked)]

    def _words(self, texts: list[str]) -> list[bytes]:
        """Texts that may be cut at every space."""
        words = words_of(pa.array(texts, pa.large_string()), NOT_SPACE)
        heads = words.offsets[words.doc] == words.starts        # no space before the first word of a text
        tails = np.flatnonzero(~heads)
        keys, first, inverse = np.unique(words.hashes[tails], return_index=True, return_inverse=True)
        body = words.raw.tobytes()
        cut = [body[words.starts[i]:words.ends[i]] for i in tails[first]]
        checks = np.fromiter(map(zlib.crc32, cut), np.uint32, len(cut))
        if len(self.young.keys) + len(keys) > CACHE_WORDS:
            self.old, self.young = self.young, WordTable()
        new = np.flatnonzero(self.young.find(keys, checks) < 0)
        before = self.old.find(keys[new], checks[new])
        known, unknown = new[before >= 0], new[before < 0]
        kept = [self.old.flat[b:b + n] for b, n in zip(self.old.begins[before[before >= 0]], self.old.sizes[before[before >= 0]])]
        fresh = self._encoded([cut[i].decode() for i in unknown])
        self.young.add(keys[np.concatenate([known, unknown])], checks[np.concatenate([known, unknown])], [*kept, *fresh])

        place = self.young.find(keys, checks)
        sizes, begins = np.zeros(len(words.starts), np.int64), np.zeros(len(words.starts), np.int64)
        sizes[tails], begins[tails] = self.young.sizes[place][inverse], self.young.begins[place][inverse]
        own = np.flatnonzero(heads)
        head_ids = self._ids([body[words.starts[i]:words.ends[i]].decode() for i in own])
        flat = np.concatenate([self.young.flat, *head_ids])
        sizes[own] = [len(x) for x in head_ids]
        begins[own] = len(self.young.flat) + np.cumsum(sizes[own]) - sizes[own]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)]
        bounds = np.concatenate([[0], ends])[words.first]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        whole = ["  " in t or t[-1:] == " " or any(s in t for s in self.special) for t in texts]
        slow = iter([x.tobytes() for x in self._ids([t for t, w in zip(texts, whole) if w])])
        fast = iter(self._words([t for t, w in zip(texts, whole) if not w]))
        return [next(slow) if w else next(fast) for w in whole]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    """A file system that driver and executors reach alike, and the path there."""
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def _sampled(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = _encoder(path)([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch({"ids": pa.array([x[:4 * SAMPLE_IDS] for x in ids], pa.binary())})

    return run


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; empty where there is too little to make one from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(x for x in samples if x)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class ShardWriter:
    def __init__(self, root: str, name: str, dictionary: bytes, level: int):
        self.fs, base = _open(root)
        self.url, self.path = f"{root}/{name}", f"{base}/{name}"
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.end, self.raw, self.rows = len(MAGIC) + 32, 0, []

    def add(self, doc_id: int | None, tk: int, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.end += len(frame)
        self.raw += len(ids)
        self.rows.append((doc_id, self.end, len(ids) // 4, tk))

    def close(self) -> tuple[str, int, int]:
        sink = pa.BufferOutputStream()
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), INDEX)]
        with pa.ipc.new_file(sink, INDEX) as w:
            w.write_batch(pa.record_batch(columns, schema=INDEX))
        index = sink.getvalue()
        self.out.write(index)
        self.out.write(struct.pack("<q", index.size) + MAGIC)
        self.out.close()
        return self.url, len(self.rows), self.raw // 4


class ShardReader:
    """Documents of one shard by position."""

    def __init__(self, url: str, dictionary: bytes):
        fs, path = _open(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(len(MAGIC) + 32, 0), self.file.read_at(16, size - 16)
        if head[:8] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{url} is no token shard")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{url} was written with another dictionary")
        length = struct.unpack("<q", tail[:8])[0]
        self.index = pa.ipc.open_file(pa.py_buffer(self.file.read_at(length, size - 16 - length))).read_all()
        self.ends = np.concatenate([[len(head)], self.index["end"].to_numpy()])
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> bytes:
        return self.decompressor.decompress(self.file.read_at(int(self.ends[i + 1] - self.ends[i]), int(self.ends[i])))


def _written(root: str, dictionary: bytes, tokenizer: str, end_id: int, level: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part_no, done, writer = task.partitionId(), [], None
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, tk, ids in zip(part.column("doc_id").to_pylist(), part.column("tk").to_pylist(), _encoder(tokenizer)(texts)):
                    if writer is None:      # each attempt has its own files; only those of successful ones are listed
                        name = f"part-{part_no:06d}-{len(done):04d}-{task.taskAttemptId()}.tok"
                        writer = ShardWriter(root, name, dictionary, level)
                    writer.add(doc_id, tk, ids + end)
                    if writer.raw >= SHARD_BYTES:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            urls, docs, tokens = zip(*done)
            yield pa.record_batch({"part": pa.array([part_no] * len(done), pa.int32()),
                                   "seq": pa.array(range(len(done)), pa.int32()), "shard": pa.array(urls),
                                   "n_docs": pa.array(docs, pa.int64()), "n_ids": pa.array(tokens, pa.int64())})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 level: int = LEVEL, folder: str | None = None) -> tuple[DataFrame, bytes]:
    """Write the shards of all rows in ascending order of id; return the table of shards and the dictionary.

    The table has shard (address), n_docs, n_ids and start, the ids in all shards
    before it.  Shards lie in ``folder``, by default below ``spark.checkpoint.dir``.

    Null texts count as empty; each document ends with ``end_id``.  Rows without
    id come last; rows of one id follow each other in the order of their texts'
    checks.  ``tokenizer`` is a file that every executor has.  Other columns are
    not looked at.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    root = f"{folder or tables.root}/tokens-{uuid.uuid4().hex}"
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         text_check(text).alias("tk"))
    chosen = bounded_sample(source.where("doc_id is not null").select("doc_id").distinct(), ["doc_id"], SAMPLE_DOCS, "dictionary")
    sample = source.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").mapInArrow(_sampled(tokenizer), "ids binary")
    dictionary = train_dictionary([bytes(r.ids) for r in sample.limit(2 * SAMPLE_DOCS).collect()])
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tk").asc()]       # rows of one id, or of none, are many tasks
    shards = tables.keep(
        source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _written(root, dictionary, tokenizer, end_id, level), "part int, seq int, shard string, n_docs long, n_ids long"),
        "shards")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per task
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return tables.keep(shards.join(parts, "part").withColumn("start", start), "starts"), dictionary


def _read(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(url, dictionary)
                counts = shard.index["n_tokens"].to_numpy()
                check = [zlib.crc32(shard.ids(i)) for i in range(len(counts))]
                yield pa.record_batch({
                    "doc_id": shard.index["doc_id"].combine_chunks(), "start": pa.array(start + np.cumsum(counts) - counts),
                    "n_tokens": pa.array(counts), "ids_crc32": pa.array(check, pa.int64())})

    return run


def read_tokens(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    spread = shards.select("shard", "start").repartition("shard")
    return spread.mapInArrow(_read(dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_tokens(*write_tokens(docs, tokenizer or public_tokenizer()))
