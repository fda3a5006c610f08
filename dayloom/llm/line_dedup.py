"""Removal of runs of lines that occur earlier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables
from dayloom.llm.repeats import Windows, covered, keyed, later_windows
from dayloom.llm.spans import Words, as_long, lines_of, list_parts, slices, unit_grams, words_of

MIN_LINES = 3
#: Runs of fewer lines go as well if they have more words than this.
SHORT_WORDS = 50


def _cut(texts: pa.Array) -> Words:
    return lines_of(texts)


def _again(lines: Words, length: int) -> np.ndarray:
    """Starts of windows that an equal window of the same text precedes without overlap."""
    hashes, inside = unit_grams(lines.hashes, lines.doc, length)
    at = np.flatnonzero(inside)
    if not len(at):
        return at
    order = at[np.lexsort((at, hashes[at], lines.doc[at]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (lines.doc[order[1:]] != lines.doc[order[:-1]])
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    return order[order >= first + length]


def _short(lines: Words, texts: pa.Array, k: int, short_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of k lines, which of them have over ``short_words`` words, and which are all lines of their text."""
    starts = np.flatnonzero(unit_grams(lines.hashes, lines.doc, k)[1])
    words = words_of(texts).starts
    size = np.searchsorted(words, lines.ends[starts + k - 1]) - np.searchsorted(words, lines.starts[starts])
    return starts, size > short_words, lines.counts[lines.doc[starts]] == k


def _short_rows(length: int, short_words: int, positions: bool):
    """Hashes of all runs of fewer than ``length`` lines and whether they may go, or a row for each that may; at * length + k is its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = lines_of(part.column("text"))
                for k in range(1, length):
                    starts, long, whole = _short(lines, part.column("text"), k, short_words)
                    may = long | whole
                    if positions:
                        starts = starts[may]
                    doc, hashes = lines.doc[starts], unit_grams(lines.hashes, lines.doc, k)[0][starts]
                    ids = part.column("doc_id").take(pa.array(doc))
                    if not positions:
                        yield pa.record_batch({"h": as_long(hashes), "doc_id": ids, "may": pa.array(may)})
                        continue
                    place = (starts - lines.first[doc]) * length + k
                    yield pa.record_batch({"h": as_long(hashes), "doc_id": ids, "tk": part.column("tk").take(pa.array(doc)),
                                           "place": pa.array(place.astype(np.int64))})

    return run


def _later_short(docs: DataFrame, length: int, short_words: int, tables: Tables) -> DataFrame:
    """(doc_id, tk, places): runs of fewer than ``length`` lines that may go and also start in a document of smaller id."""
    docs = docs.where("doc_id is not null and text is not null")
    rows = docs.select("doc_id", "text").mapInArrow(_short_rows(length, short_words, False), "h long, doc_id long, may boolean")
    first = tables.keep(rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max(F.when(F.col("may"), F.col("doc_id"))).alias("last_doc"))
                        .where("first_doc < last_doc").select("h", "first_doc"), "short-first")
    own = docs.mapInArrow(_short_rows(length, short_words, True), "h long, doc_id long, tk int, place long")
    out = tables.keep(own.join(first, "h").where("first_doc < doc_id").groupBy("doc_id", "tk")
                      .agg(F.collect_set("place").alias("places")), "short-later")
    tables.drop("short-first")
    return out


def _cleaned(length: int, short_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = lines_of(part.column("text"))
                gone = covered(lines, part.column("ats"), length)
                for j in range(length):
                    gone[_again(lines, length) + j] = True
                if short_words is not None:
                    values, bounds = list_parts(part.column("places"))
                    begin = np.repeat(lines.first[:-1], np.diff(bounds)) + values // length
                    for k in range(1, length):
                        starts, long, _ = _short(lines, part.column("text"), k, short_words)
                        again = np.intersect1d(_again(lines, k), starts[long])
                        for j in range(k):
                            gone[begin[values % length == k] + j] = True
                            gone[again + j] = True
                removed = np.bincount(lines.doc[gone], minlength=part.num_rows)
                texts = part.column("text").to_pylist()
                for i in np.flatnonzero(removed):
                    body = lines.raw[lines.offsets[i]:lines.offsets[i + 1]].tobytes()
                    out, unit = [], lines.first[i]
                    for line in body.split(b"\n"):
                        counted = bool(line.strip(b" \t\n\v\f\r"))
                        if not (counted and gone[unit]):
                            out.append(line)
                        unit += counted
                    texts[i] = b"\n".join(out).decode()
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_lines": pa.array(lines.counts.astype(np.int64)),
                    "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(texts, pa.string())})

    return run


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
               short_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_text.

    Lines end at line feeds; lines of ASCII white space alone are not counted and
    stay.  A run of ``min_lines`` or more consecutive counted lines that occurs
    earlier, in a document of smaller id or before it in its own document without
    overlap, is deleted with its line feeds.  Fingerprints are the least line
    hashes of ``min_lines`` consecutive lines, so no such run is missed.

    With ``short_words``, a run of fewer lines that occurs earlier in the same
    sense goes as well if it has more words than that, or if it is all counted
    lines of its text.

    Null text: no lines, and null is returned.  Null id: only repeats inside the
    text itself go.  Rows of one id are no duplicates of each other.  Other
    columns are not looked at.
    """
    source = keyed(docs, doc_id, text)
    tables = Tables(docs.sparkSession)
    found = source.join(later_windows(source, Windows(_cut, min_lines, 1), tables).hint("merge"), ["doc_id", "tk"], "left")
    columns = ["doc_id", "text", "ats"]
    if short_words is not None:
        found = found.join(_later_short(source, min_lines, short_words, tables).hint("merge"), ["doc_id", "tk"], "left")
        columns.append("places")
    return found.select(*columns).mapInArrow(_cleaned(min_lines, short_words),
                                             "doc_id long, n_lines long, n_removed long, kept_text string")


def line_dedup_digest(docs: DataFrame, short_words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept text (null: of nothing)."""
    kept = F.coalesce("kept_text", F.lit(""))
    return line_dedup(docs, short_words=short_words).select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
