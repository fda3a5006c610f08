"""Sequences of units that occur again in later documents, found by seed and extension.

A unit is a word or a line.  Of every ``length`` consecutive units, the least
hash of the ``seed`` grams inside is its anchor (winnowing), so two equal
windows always have equal anchors:

1. Anchors are counted: an aggregate with map-side combination keeps those that
   more than one document has.
2. Anchors join that table.  Their positions go back to their documents.
3. Around each such position the match is extended to both sides: every window
   that has its anchor there is hashed and looked up in the same way.

No pairs of documents are formed, so the work does not depend on how many
copies there are: each anchor and each window is one row, and an aggregate says
which document has it first.  Windows are compared by 64-bit hashes; of 10^13
different windows about one in a million would be taken for another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, text_check
from dayloom.llm.spans import Words, as_long, list_parts, slices, unit_grams, winnow


@dataclass(frozen=True)
class Windows:
    """How texts are cut into units, units in a window, units in an anchor."""

    cut: Callable[[pa.Array], Words]
    length: int
    seed: int

    def anchors(self, units: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows, and the position of the anchor of each."""
        grams, inside = unit_grams(units.hashes, units.doc, self.seed)
        return winnow(grams, inside, units.doc, self.length - self.seed + 1)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and a check of the text; rows that share an id are told apart by their texts."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       text_check(text).alias("tk"))


def _anchor_rows(spec: Windows, positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                units = spec.cut(part.column("text"))
                at = np.unique(spec.anchors(units)[1])
                if not len(at):
                    continue
                doc, anchor = units.doc[at], unit_grams(units.hashes, units.doc, spec.seed)[0][at]
                ids = part.column("doc_id").take(pa.array(doc))
                if not positions:
                    yield pa.record_batch({"h": as_long(anchor), "doc_id": ids})
                    continue
                yield pa.record_batch({"h": as_long(anchor), "doc_id": ids, "tk": part.column("tk").take(pa.array(doc)),
                                       "at": pa.array((at - units.first[doc]).astype(np.int32))})

    return run


def _window_rows(spec: Windows):
    """Hash and start of each window whose anchor is at one of the listed positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                units = spec.cut(part.column("text"))
                starts, at = spec.anchors(units)
                marked = np.zeros(len(units.starts) + 1, bool)
                values, bounds = list_parts(part.column("ats"))
                marked[np.repeat(units.first[:-1], np.diff(bounds)) + values] = True
                starts = starts[marked[at]]
                doc = units.doc[starts]
                hashes = unit_grams(units.hashes, units.doc, spec.length)[0][starts]
                yield pa.record_batch({"h": as_long(hashes), "doc_id": part.column("doc_id").take(pa.array(doc)),
                                       "tk": part.column("tk").take(pa.array(doc)),
                                       "at": pa.array((starts - units.first[doc]).astype(np.int32))})

    return run


ROWS = "h long, doc_id long, tk int, at int"


def _in_many(rows: DataFrame) -> DataFrame:
    """Hashes that more than one document has, and the first of those."""
    return (rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
            .where("first_doc < last_doc").select("h", "first_doc"))


def later_windows(docs: DataFrame, spec: Windows, tables: Tables) -> DataFrame:
    """(doc_id, tk, ats): starts of windows whose units also start in a document of smaller id.

    ``docs`` is a ``keyed`` frame.  Rows without an id take no part.
    """
    docs = docs.where("doc_id is not null and text is not null")
    shared = tables.keep(_in_many(docs.select("doc_id", "text").mapInArrow(_anchor_rows(spec, False), "h long, doc_id long"))
                         .select("h"), "anchors")
    anchors = docs.mapInArrow(_anchor_rows(spec, True), ROWS)
    seeds = tables.keep(anchors.join(shared, "h", "left_semi").groupBy("doc_id", "tk").agg(F.collect_set("at").alias("ats")),
                        "seeds")
    windows = tables.keep(docs.join(seeds.hint("merge"), ["doc_id", "tk"]).mapInArrow(_window_rows(spec), ROWS), "windows")
    first = tables.keep(_in_many(windows), "first")
    out = tables.keep(windows.join(first, "h").where("first_doc < doc_id").groupBy("doc_id", "tk")
                      .agg(F.collect_set("at").alias("ats")), "later")
    tables.drop("anchors", "seeds", "windows", "first")
    return out


def covered(units: Words, ats: pa.Array, length: int) -> np.ndarray:
    """Whether each unit lies in one of the listed windows of its text."""
    values, bounds = list_parts(ats)
    begin = np.repeat(units.first[:-1], np.diff(bounds)) + values
    step = np.zeros(len(units.starts) + length + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + length, -1)
    return np.cumsum(step)[:len(units.starts)] > 0
