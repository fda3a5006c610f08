"""Documents that contain passages of benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, text_check
from dayloom.llm.spans import ALNUM, LOWER, as_long, slices, winnow, words_of

WINDOW = 10
SEED = 5
#: Item windows that one pass over the documents compares; each takes about 30 bytes in every Python worker.
BLOCK_WINDOWS = 1_000_000


class Lookup:
    """Position of 64-bit hashes in a sorted table; a bit table of their top bits answers most misses."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the hashes that are in the table, and where."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == hashes[some] if len(self.hashes) else np.zeros(0, bool)
        return some[hit], at[hit]


@dataclass
class Block:
    """Windows of some items by their length: hash table, and the items of each hash."""

    names: list[str]
    seeds: Lookup
    windows: dict[int, tuple[Lookup, np.ndarray, np.ndarray]]      # length -> table, offsets, item numbers


def _item_windows(length: int, seed: int):
    """A row for each window of each item: its length and hash, and for full windows the hash of its anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), ALNUM, LOWER)
                for n in range(1, length + 1):
                    grams, inside = words.grams(n)
                    at, anchor = np.flatnonzero(inside), None
                    if n < length:      # an item of n words is one window
                        at = at[words.counts[words.doc[at]] == n]
                    else:
                        small, whole = words.grams(seed)
                        at, least = winnow(small, whole, words.doc, length - seed + 1)
                        anchor = small[least]
                    if len(at):
                        yield pa.record_batch({
                            "item": part.column("item").take(pa.array(words.doc[at])),
                            "n": pa.array(np.full(len(at), n, np.int32)), "h": as_long(grams[at]),
                            "anchor": as_long(grams[at] if anchor is None else anchor)})

    return run


def _block(rows: list) -> Block:
    names = sorted({r.item for r in rows})
    number = {x: i for i, x in enumerate(names)}
    anchors, windows = [], {}
    for n in {r.n for r in rows}:
        own = [r for r in rows if r.n == n]
        h = np.array([r.h for r in own], np.int64).view(np.uint64)
        item = np.array([number[r.item] for r in own], np.int64)
        table = Lookup(h)
        at = np.searchsorted(table.hashes, h)
        pairs = np.unique(at * len(names) + item)
        windows[n] = (table, np.searchsorted(pairs // len(names), np.arange(len(table.hashes) + 1)), pairs % len(names))
        anchors += [r.anchor for r in own]
    return Block(names, Lookup(np.array(anchors, np.int64).view(np.uint64)), windows)


def _scan(shared, length: int, seed: int):
    """doc_id, tk, n_words, positions of hit words and the items of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), ALNUM, LOWER)
                step = np.zeros(len(words.starts) + length + 1, np.int64)
                pairs = [np.zeros(0, np.int64)]
                for n, (table, bounds, items) in block.windows.items():
                    if n < length:
                        at = np.flatnonzero(words.grams(n)[1])
                    else:       # only windows whose anchor is an item's
                        small, whole = words.grams(seed)
                        at, least = winnow(small, whole, words.doc, length - seed + 1)
                        at = at[block.seeds(small[least])[0]]
                    found, where = table(words.grams(n)[0][at])
                    at = at[found]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + n, -1)
                    sizes = bounds[where + 1] - bounds[where]
                    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[where], sizes)
                    pairs.append(np.unique(np.repeat(words.doc[at], sizes) * len(block.names) + items[index]))
                hit = np.flatnonzero(np.cumsum(step)[:len(words.starts)] > 0)
                pair = np.unique(np.concatenate(pairs))
                doc = np.arange(part.num_rows + 1)
                names = pa.array(block.names, pa.string()).take(pa.array(pair % max(1, len(block.names))))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "tk": part.column("tk"), "n_words": pa.array(words.counts.astype(np.int64)),
                    "hits": pa.ListArray.from_arrays(pa.array(np.searchsorted(words.doc[hit], doc).astype(np.int32)),
                                                     pa.array((hit - words.first[words.doc[hit]]).astype(np.int32))),
                    "items": pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(pair // max(1, len(block.names)), doc).astype(np.int32)), names)})

    return run


def decontamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, seed: int = SEED,
                    block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk (check of the text), n_words, hits (positions of hit words), items (ids as strings, sorted).

    Words are runs of ASCII digits, letters and all other than ASCII characters
    after A-Z became a-z.  A window is ``window`` consecutive words of an item; an
    item of fewer words is one window.  A document's word is hit if it lies in an
    occurrence of a window.

    The least hash of the ``seed`` grams of each window of a document is its
    fingerprint (winnowing): a shared window always has a shared fingerprint.
    Fingerprints that an item has are extended to the whole window.  The windows
    of the items go to all tasks in blocks of at most about ``block_windows``,
    one pass over the documents for each, so that their number is not bounded by
    memory.

    Null texts and texts without words have no hits.  Items without id or words
    are not looked for; items of one id count as one.  Equal rows of ``docs``
    give equal rows.  Other columns are not looked at.
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must lie between 1 and window")
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         text_check(text).alias("tk"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    windows = tables.keep(items.where("item is not null and text is not null").mapInArrow(
        _item_windows(window, seed), "item string, n int, h long, anchor long").distinct(), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    schema = "doc_id long, tk int, n_words long, hits array<int>, items array<string>"
    found = []
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("item", "h"), F.lit(blocks)) == b).collect()
        found.append(source.mapInArrow(_scan(spark.sparkContext.broadcast(_block(rows)), window, seed), schema))
    if blocks == 1:
        return found[0].select("doc_id", "tk", "n_words", "hits", F.array_sort("items").alias("items"))
    more = (reduce(DataFrame.union, found[1:]).where("size(items) > 0").dropDuplicates()
            .groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("hits")).alias("more_hits"),
                                         F.flatten(F.collect_list("items")).alias("more_items")))
    more = more.withColumnsRenamed({"doc_id": "other_id", "tk": "other_tk"})
    both = found[0].join(more, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("tk") == F.col("other_tk")), "left")
    merged = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.slice(a, 1, 0))))
    return both.select("doc_id", "tk", "n_words", merged("hits", "more_hits").alias("hits"), merged("items", "more_items").alias("items"))


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, the SHA-256 of the items' ids, contaminated."""
    found = decontamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
