"""Quality by histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import fold_of, labelled_sample, logistic
from dayloom.llm.spans import SPACED, Words, _table, lines_of, slices, unit_grams, words_of

#: Labelled documents that the trees are learned from, at most.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
BINS, DEPTH, ROUNDS, RATE, LAMBDA, LEAST_WEIGHT = 64, 4, 60, 0.2, 1.0, 2.0

_UPPER, _LOWER_CASE = _table([(0x41, 0x5A)], True), _table([(0x61, 0x7A)], True)
_DIGIT, _HIGH = _table([(0x30, 0x39)], True), _table([(0x80, 0xFF)], True)
_LETTER = _UPPER | _LOWER_CASE | _HIGH
_MARK = ~(_LETTER | _DIGIT | ~SPACED)
_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_BANG, _BAR = np.arange(256) == 0x21, np.arange(256) == 0x7C
_ODD = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@\\^_`{}~", np.uint8))

FEATURES = ("bytes", "words", "word_length", "upper", "digits", "marks", "high", "ends", "bangs", "bars", "odd", "lines",
            "line_words", "distinct_words", "distinct_pairs", "top_word", "repeated_next", "distinct_lines", "no_letter_words",
            "upper_words", "long_words")


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values and largest count of one value in each of n documents."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.append(fresh, len(key)))
    owner = (key[fresh] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, run)
    return np.bincount(owner, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; null counts as empty."""
    words, n = words_of(texts), len(texts)
    raw, edge = words.raw, words.offsets

    def counted(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return (sums[edge[1:]] - sums[edge[:-1]]).astype(float)

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[flag], minlength=n).astype(float)

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return sums[words.ends] - sums[words.starts]

    size, count = np.maximum(1.0, np.diff(edge)), words.counts.astype(float)
    per_word, length = np.maximum(1.0, count), words.ends - words.starts
    lines: Words = lines_of(texts)
    pairs, both = unit_grams(words.hashes, words.doc, 2)
    same = np.zeros(len(words.starts), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    different, most = _distinct(words.doc, words.hashes, n)
    columns = {
        "bytes": np.log1p(np.diff(edge)), "words": np.log1p(count), "word_length": np.bincount(words.doc, length, n) / per_word,
        "upper": counted(_UPPER) / size, "digits": counted(_DIGIT) / size, "marks": counted(_MARK) / size,
        "high": counted(_HIGH) / size, "ends": counted(_END) / per_word, "bangs": counted(_BANG) / per_word,
        "bars": counted(_BAR) / per_word, "odd": counted(_ODD) / per_word, "lines": np.log1p(lines.counts),
        "line_words": count / np.maximum(1, lines.counts), "distinct_words": different / per_word,
        "distinct_pairs": _distinct(words.doc[:len(pairs)][both], pairs[both], n)[0] / np.maximum(1.0, count - 1),
        "top_word": most / per_word, "repeated_next": words_with(same) / per_word,
        "distinct_lines": _distinct(lines.doc, lines.hashes, n)[0] / np.maximum(1, lines.counts),
        "no_letter_words": words_with(inside(_LETTER) == 0) / per_word,
        "upper_words": words_with((inside(_UPPER) > 1) & (inside(_LOWER_CASE) == 0)) / per_word,
        "long_words": words_with(length > 24) / per_word,
    }
    return np.stack([columns[f] for f in FEATURES], axis=1)


@dataclass
class Forest:
    """Complete binary trees as arrays; node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray     # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray        # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, bins: int = BINS, depth: int = DEPTH, rounds: int = ROUNDS, rate: float = RATE) -> Forest:
    """Second-order boosting of the logistic loss on histograms of quantile bins, all nodes of a level at once."""
    n, width = len(y), x.shape[1]
    inner = 2**depth - 1
    feature, threshold = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, inner + 1))
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0
    if not n or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], leaf[:0], base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)     # bin b: up to cuts[b]
    offset = binned + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(rounds):
        p = logistic(margin)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width * bins + offset).ravel()
            size = many * width * bins
            gs = np.bincount(at, np.repeat(g, width), size).reshape(many, width, bins).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, width), size).reshape(many, width, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + LAMBDA) + (gt - gs)**2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = -1.0
            best = gain.reshape(many, -1).argmax(axis=1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            f, b = best // bins, best % bins
            for i in np.flatnonzero(split):
                feature[t, first + i], threshold[t, first + i] = f[i], cuts[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        end = node - inner
        leaf[t] = rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + LAMBDA)
        margin += leaf[t][end]
    return Forest(feature, threshold, leaf, base)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"),
                                   "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
                  doc_id: str = "doc_id", text: str = "text") -> Forest:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fold.

    Statistics are computed where the texts are; one row of ``FEATURES`` per
    sampled document comes to the driver, about 3 MB.
    """
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, sample_rows, doc_id, text)
    rows = sample.mapInArrow(_feature_rows, "doc_id long, label int, x array<double>").toPandas()
    rows = rows.assign(key=rows.x.map(tuple)).sort_values(["doc_id", "key"])        # sums do not depend on the layout
    x = np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, (rows.label.to_numpy() > 0).astype(float))


def _scored(model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [logistic(model.value.margin(features(p.column("text")))) for p in slices(pa.record_batch({"text": texts}))]
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    return score


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score of 0.5 or more).

    Learned from labelled rows outside the held-out fold (crc32 of the id modulo
    3 is 1); rows without id count as held out.  Null counts as empty.  Without
    labelled rows every score is 0.5; with labels of one kind it is their share,
    shrunk to the middle by one row of each kind.  Equal texts have equal scores.
    Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, label, doc_id=doc_id, text=text))
    held = F.coalesce(fold_of(doc_id, FOLDS) == HELD_OUT, F.lit(True))
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"),
                        _scored(model)(F.col(text).cast("string")).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
