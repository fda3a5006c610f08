"""Quality rules on texts as a short-circuit cascade in the order of rejections per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_sample, text_check
from dayloom.llm.spans import SPACED, Words, _table, lines_of, slices, unit_grams, words_of

#: Different (id, text) that costs and selectivities are estimated on, at most.
SAMPLE_ROWS = 2000
WINDOW = 5
#: A text fails the base with fewer words, or with a larger percentage of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 10, 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CHARACTER = (np.arange(256) & 0xC0) != 0x80        # first bytes of code points
_UPPER, _DIGIT = _table([(0x41, 0x5A)], True), _table([(0x30, 0x39)], True)
_LETTER = _table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)], True)
_BULLET, _DOT = np.isin(np.arange(256), np.frombuffer(b"*-", np.uint8)), np.arange(256) == 0x2E


class View:
    """Texts of a slice with the word, line and window structure that was needed so far.

    ``only`` keeps some of the texts, and of the structure what is known already;
    the rest is made when a later rule asks for it, from the texts that are left.
    """

    def __init__(self, texts: pa.Array, **known):
        self.texts = texts
        self.__dict__.update(known)

    def only(self, keep: np.ndarray) -> View:
        known = {}
        for name in ("words", "lines"):
            if name in self.__dict__:
                known[name] = _rows_of(self.__dict__[name], keep)
        for name in ("repeat_words", "duplicate_lines"):
            if name in self.__dict__:
                known[name] = self.__dict__[name][keep]
        return View(self.texts.filter(pa.array(keep)), **known)

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def words(self) -> Words:
        return words_of(self.texts)

    @cached_property
    def lines(self) -> Words:
        return lines_of(self.texts)

    def inside(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a table in each word."""
        sums = np.concatenate([[0], np.cumsum(table[self.words.raw])])
        return sums[self.words.ends] - sums[self.words.starts]

    def per_text(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.words.doc, of_words, len(self)).astype(np.int64)

    def bytes_of(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a table in each text; those of interest are never white space, so they lie in words."""
        return self.per_text(self.inside(table))

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    @cached_property
    def duplicate_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line, in each text."""
        return self.lines.counts - _different(self.lines.doc, self.lines.hashes, len(self))

    @cached_property
    def repeat_words(self) -> np.ndarray:
        """Words covered by a window of five words that the text holds twice or more."""
        grams, whole = unit_grams(self.words.hashes, self.words.doc, WINDOW)
        covered = np.zeros(len(self.words.starts) + 1, np.int64)
        at = np.flatnonzero(whole)
        if len(at):
            doc = self.words.doc[at]
            order = np.lexsort((grams[at], doc))
            key, owner = grams[at][order], doc[order]
            same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
            again = np.zeros(len(at), bool)
            again[1:] |= same
            again[:-1] |= same
            starts = at[order[again]]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + WINDOW, -1)
        return self.per_text(np.cumsum(covered)[:-1] > 0)


def _rows_of(units: Words, keep: np.ndarray) -> Words:
    """Words of some of the texts, numbered anew; bytes stay where they are."""
    chosen = keep[units.doc]
    out = Words(units.raw, units.offsets, units.starts[chosen], units.ends[chosen],
                np.concatenate([[0], np.cumsum(units.counts[keep])]))
    if "hashes" in units.__dict__:
        out.__dict__["hashes"] = units.hashes[chosen]
    return out


def _different(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, doc))
    key, owner = hashes[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=n)


def _word_length(v: View) -> np.ndarray:
    chars = v.bytes_of(_CHARACTER)
    return (chars < 2 * v.n_words) | (chars > 15 * v.n_words)


def _symbols(v: View) -> np.ndarray:
    return 10 * v.bytes_of(_SYMBOL) > v.n_words


def _letters(v: View) -> np.ndarray:
    return 100 * v.per_text(v.inside(_LETTER) > 0) < 80 * v.n_words


def _capitals(v: View) -> np.ndarray:
    return 100 * v.bytes_of(_UPPER) > 40 * v.bytes_of(_CHARACTER)


def _digits(v: View) -> np.ndarray:
    return 100 * v.bytes_of(_DIGIT) > 20 * v.bytes_of(_CHARACTER)


def _same_lines(v: View) -> np.ndarray:
    return 100 * v.duplicate_lines > 30 * v.lines.counts


def _bullets(v: View) -> np.ndarray:
    first = _BULLET[v.lines.raw[v.lines.starts]] if len(v.lines.starts) else np.zeros(0, bool)
    return 100 * np.bincount(v.lines.doc[first], minlength=len(v)) > 90 * v.lines.counts


def _trailing(v: View) -> np.ndarray:
    """Lines that end in three dots."""
    lines = v.lines
    long = lines.ends - lines.starts >= 3
    ends = lines.ends[long]
    dots = _DOT[lines.raw[ends - 1]] & _DOT[lines.raw[ends - 2]] & _DOT[lines.raw[ends - 3]]
    return 100 * np.bincount(lines.doc[long][dots], minlength=len(v)) > 30 * lines.counts


def _repeats(v: View) -> np.ndarray:
    return 100 * v.repeat_words > REPEAT_PERCENT * v.n_words


def _few_words(v: View) -> np.ndarray:
    return v.n_words < LEAST_WORDS


@dataclass(frozen=True)
class Rule:
    """True in ``fails`` rejects a text, whatever other rules say."""

    name: str
    fails: Callable[[View], np.ndarray]


BASE = (Rule("few_words", _few_words), Rule("repeats", _repeats))
#: Percentages and means as in published web-text filters.
RULES = (
    Rule("word_length", _word_length),      # mean under 2 or over 15 characters
    Rule("symbols", _symbols),              # over one to ten words
    Rule("letters", _letters),              # under 80 % of the words have a letter (any non-ASCII character counts as one)
    Rule("capitals", _capitals),            # over 40 % of the characters of words
    Rule("digits", _digits),                # over 20 % of the characters of words
    Rule("same_lines", _same_lines),        # over 30 % of the lines equal an earlier one
    Rule("bullets", _bullets),              # over 90 % of the lines begin with one
    Rule("trailing", _trailing),            # over 30 % of the lines end in three dots
)


def cascade(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts pass every rule; a rule looks only at those that passed the ones before it."""
    passed, alive = np.zeros(len(view), bool), np.arange(len(view))
    for rule in rules:
        if not len(alive):
            break
        fails = rule.fails(view)
        if fails.any():
            alive, view = alive[~fails], view.only(~fails)
    passed[alive] = True
    return passed


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text",
               rows: int = SAMPLE_ROWS, given: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The rules in the order of rejections per cost on a sample.

    Tasks test every rule on every sampled text and time it, with the structure of
    the text that it needs.  What comes back is one row per set of failed rules.
    Each next rule is the one that rejects most of the texts still there per
    second; those that reject none come last, cheapest first.  ``given`` rules
    were applied before, so what they reject does not count.  Times vary, so the
    order may; the verdict of all rules together does not.
    """
    every = (*given, *rules)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_check(text).alias("tk")).distinct()
    chosen = bounded_sample(ids, ["doc_id", "tk"], rows, "rules")
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_check(text).alias("tk"), F.col(text).cast("string").alias("text"))
    sample = sample.join(F.broadcast(chosen), sample["doc_id"].eqNullSafe(chosen["doc_id"]) & (sample["tk"] == chosen["tk"]), "left_semi")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                mask, cost = np.zeros(len(texts), np.int64), []
                for i, rule in enumerate(every):
                    begun = time.perf_counter()
                    mask |= rule.fails(View(texts)).astype(np.int64) << i
                    cost.append(time.perf_counter() - begun)
                kinds, n = np.unique(mask, return_counts=True)
                costs = [cost] + [[0.0] * len(every)] * (len(kinds) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n), pa.array(costs, pa.list_(pa.float64()))], ["mask", "n", "cost"])

    found = sample.select("text").mapInArrow(measure, "mask long, n long, cost array<double>")
    cells = found.groupBy("mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("cost")[i]).alias(f"c{i}") for i in range(len(every)))).collect()
    cost = [max(1e-9, sum(r[f"c{i}"] for r in cells)) for i in range(len(every))]
    skip = (1 << len(given)) - 1
    left, order, open_ = [(r["mask"], r["n"]) for r in cells if not r["mask"] & skip], [], set(range(len(given), len(every)))
    while open_:
        rejected = {i: sum(n for mask, n in left if mask >> i & 1) for i in open_}
        best = min(open_, key=lambda i: (-rejected[i] / cost[i], cost[i], i))
        open_.remove(best)
        order.append(every[best])
        left = [(mask, n) for mask, n in left if not mask >> best & 1]
    return tuple(order)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text",
                  order: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, tk (check of the text), base counts, base_failed and kept: one row per row of ``docs``.

    Words are runs of other than ASCII white space.  Of each whole text: n_words,
    word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in five-word windows that
    occur twice or more).  A text fails the base with fewer than ``LEAST_WORDS``
    words, or if more than ``REPEAT_PERCENT`` percent of them are in repeated
    windows.  It is kept if it passes the base and all ``rules``, which run as a
    cascade in ``order``, by default that of :func:`rule_order`: each rule looks
    only at the texts that the rules before it let through.

    Null and empty texts have no words and fail the base.  Rows are independent,
    so ties, repeated rows, equal ids and null ids make no difference; further
    columns are not looked at.  No rows give no rows.  Windows and lines are
    compared by 64 bits of hash within one text.
    """
    if order is None:
        order = rule_order(docs, rules, doc_id, text, given=BASE)
    schema = ("doc_id long, tk int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                view = View(part.column("text"))
                n, repeats = view.n_words, view.repeat_words
                base_failed = _few_words(view) | _repeats(view)
                counts = [n, view.bytes_of(_CHARACTER), view.bytes_of(_SYMBOL), view.duplicate_lines, repeats]
                kept = np.zeros(len(n), bool)
                kept[~base_failed] = cascade(view.only(~base_failed), order)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tk"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(base_failed), pa.array(kept)],
                    ["doc_id", "tk", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_check(text).alias("tk"),
                       F.col(text).cast("string").alias("text")).mapInArrow(judge, schema)


def quality_rules_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).drop("tk")
