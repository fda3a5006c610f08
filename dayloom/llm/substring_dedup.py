"""Removal of word sequences that an earlier document has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables
from dayloom.llm.repeats import Windows, covered, keyed, later_windows
from dayloom.llm.spans import Words, slices, words_of

MIN_WORDS = 13
SEED_WORDS = 5


def _cut(texts: pa.Array) -> Words:
    return words_of(texts)


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    raw, n, docs = words.raw, len(words.raw), len(words.first) - 1
    starts, ends, doc = words.starts[keep], words.ends[keep], words.doc[keep]
    step = np.zeros(n + 2, np.int8)
    step[starts] += 1
    step[ends] -= 1
    take = np.cumsum(step[:n + 1], dtype=np.int8) > 0
    gap = ends[:-1][doc[:-1] == doc[1:]]        # the byte behind a kept word that has a successor is white space
    take[gap] = True
    spaced = np.append(raw, np.uint8(0))
    spaced[gap] = 0x20
    sizes = np.concatenate([[0], np.cumsum(take)])[words.offsets]
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(spaced[take])).cast(pa.string())


def _cleaned(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                gone = covered(words, part.column("ats"), length)
                removed = np.bincount(words.doc[gone], minlength=part.num_rows)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_removed": pa.array(removed.astype(np.int64)), "kept_text": joined_words(words, ~gone)})

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                    seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    Words are runs of other than ASCII white space, unchanged.  Each word is
    removed that lies in a window of ``min_words`` consecutive words which also
    starts in a document of smaller id; windows are those of the input.  The
    kept words are joined by one space.

    Null text: no words.  Null id: the row is returned whole and removes nothing
    elsewhere.  Rows of one id are no duplicates of each other.  Texts with fewer
    than ``min_words`` words are returned whole.  Other columns are not looked
    at.
    """
    if not 1 <= seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    source = keyed(docs, doc_id, text)
    later = later_windows(source, Windows(_cut, min_words, seed_words), Tables(docs.sparkSession))
    return (source.join(later.hint("merge"), ["doc_id", "tk"], "left").select("doc_id", "text", "ats")
            .mapInArrow(_cleaned(min_words), "doc_id long, n_words long, n_removed long, kept_text string"))


def substring_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
