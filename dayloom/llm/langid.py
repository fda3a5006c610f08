"""Language of texts by a string kernel, Nyström features and one-versus-rest ridge regression.

The kernel of two texts is the number of letter n-grams (n = 1 to 3, blended)
that both have, divided by the root of the product of their numbers: a presence
kernel, so repetition does not count.  N-grams are those of the landmarks, a few
labelled texts.  Kernel values against the landmarks, whitened by the landmarks'
own kernel matrix, are the features of a ridge regression onto one column per
language.  Texts are scored in slices: a presence matrix times the landmarks'
matrix times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, bounded_sample, fold_of, one_row_of_each
from dayloom.llm.spans import slices

#: Labelled documents that are learned from, at most; landmarks among them, or one for each language if these are more.
SAMPLE_ROWS, LANDMARKS = 3000, 128
RIDGE = 1e-3
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Factor of the decision values in the softmax that gives the score.
SHARPNESS = 5.0
_CELLS = 1 << 23        # of one presence matrix, at most, but for the n-grams of a single text


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, and the n + 1 offsets; null counts as empty."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)


def grams(points: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit code of every n-gram that holds a letter.

    ``letters`` are the sorted letters of the sample, each with a symbol of its
    own; 0 stands for other than a letter, the last symbol for letters that the
    sample has not.  Symbols are fewer than 2^20, so three of them fit a code.
    """
    symbols = len(letters) + 2
    place = np.minimum(np.searchsorted(letters, points), max(0, len(letters) - 1))
    known = letters[place] == points if len(letters) else np.zeros(len(points), bool)
    symbol = np.where(known, place + 1, np.where(_is_letter()[points], symbols - 1, 0)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    docs, codes, code, base = [], [], np.zeros(len(symbol), np.int64), 0
    for n in (1, 2, 3):
        m = max(0, len(symbol) - n + 1)
        code = code[:m] * symbols + symbol[n - 1:]
        ok = (code > 0) & (text[:m] == text[n - 1:])
        docs.append(text[:m][ok])
        codes.append(code[ok] + base)
        base += symbols**n
    return np.concatenate(docs), np.concatenate(codes)


@dataclass
class Landmarks:
    letters: np.ndarray
    vocabulary: np.ndarray      # sorted codes of the n-grams that some landmark has
    columns: np.ndarray         # normalised presence, n-grams x landmarks

    @staticmethod
    def of(letters: np.ndarray, codes: list[np.ndarray]) -> Landmarks:
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        columns = np.zeros((len(every), len(codes)), np.float32)
        for j, own in enumerate(codes):
            columns[np.searchsorted(every, own), j] = 1 / np.sqrt(max(1, len(own)))
        return Landmarks(letters, every, columns)

    def _present(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different (text, row of ``columns``) of some texts."""
        text, code = grams(points, offsets, self.letters)
        row = np.minimum(np.searchsorted(self.vocabulary, code), max(0, len(self.vocabulary) - 1))
        ok = self.vocabulary[row] == code if len(self.vocabulary) else np.zeros(len(code), bool)
        pair = np.unique(text[ok] * np.int64(max(1, len(self.vocabulary))) + row[ok])
        return pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary))

    def kernel(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Kernel of each text with each landmark, and which texts have letters.

        Texts are taken in runs; a run is a presence matrix over the n-grams that
        it has, times those rows of the landmarks' matrix.
        """
        points, offsets = code_points(texts)
        out = np.zeros((len(texts), self.columns.shape[1]), np.float32)
        letter = np.concatenate([[0], np.cumsum(_is_letter()[points])])
        text, row = self._present(points, offsets)
        counts = np.bincount(text, minlength=len(texts))
        ends, lo = np.cumsum(counts), 0
        while lo < len(texts):
            # a run of t texts with p pairs has at most p different n-grams
            before = ends[lo] - counts[lo]
            span = np.arange(1, len(texts) - lo + 1) * np.minimum(ends[lo:] - before, len(self.vocabulary))
            hi = lo + max(1, int(np.searchsorted(span, _CELLS, side="right")))
            part = slice(int(before), int(ends[hi - 1]))
            used, column = np.unique(row[part], return_inverse=True)
            own = np.zeros((hi - lo, len(used)), np.float32)
            own[text[part] - lo, column] = 1
            out[lo:hi] = own @ self.columns[used] / np.sqrt(np.maximum(1, counts[lo:hi]))[:, None]
            lo = hi
        return out, letter[offsets[1:]] > letter[offsets[:-1]]


@dataclass
class LanguageModel:
    landmarks: Landmarks
    weights: np.ndarray         # landmarks x languages
    languages: list[str]

    def __call__(self, texts: pa.Array) -> pa.StructArray:
        names, scores = [None] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(texts)), pa.array(scores)], ["lang", "score"])
        kernel, lettered = self.landmarks.kernel(texts)
        value = SHARPNESS * (kernel @ self.weights)
        share = np.exp(value - value.max(axis=1, keepdims=True))
        best = value.argmax(axis=1)
        scores = np.where(lettered, share.max(axis=1) / share.sum(axis=1), 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            points = np.unique(code_points(part.column("text"))[0])
            yield pa.record_batch({"letter": pa.array(points[_is_letter()[points]].astype(np.int32))})


def _codes(letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points, offsets = code_points(batch.column("text").slice(row, 1))
                own = np.unique(grams(points, offsets, letters)[1])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(row, 1), "codes": pa.array([own], pa.list_(pa.int64()))})

    return run


def _kernel_rows(landmarks: Landmarks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kernel, lettered = landmarks.kernel(part.column("text"))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(kernel.ravel()), kernel.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.record_batch({"k": rows, "lang": part.column("lang")}).filter(pa.array(lettered))

    return run


def train_langid(docs: DataFrame, lang: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS,
                 doc_id: str = "doc_id", text: str = "text") -> LanguageModel:
    """Learn from at most ``sample_rows`` documents with a language outside the held-out fold.

    Of several rows of an id that with the least text check counts, then the first
    language.  Landmarks are taken from the languages in turn, at least one of
    each.  To the driver come the letters of the sample, the n-grams of the
    landmarks and one kernel row per sampled text.
    """
    tables = Tables(docs.sparkSession)
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"),
                        F.col(text).cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    ids = bounded_sample(known.select("doc_id").distinct(), ["doc_id"], sample_rows, "langid")
    sample = tables.keep(one_row_of_each(known, ids, ["lang"]), "sample")
    letters = np.sort(np.array([r.letter for r in sample.select("text").mapInArrow(_letters, "letter int").distinct().collect()], np.uint32))
    order: dict[str, int] = {}
    chosen = []
    for r in sorted(sample.select("doc_id", "lang").collect(), key=lambda r: r.doc_id):
        order[r.lang] = order.get(r.lang, 0) + 1
        chosen.append((order[r.lang], r.lang, r.doc_id))
    marks = [x[2] for x in sorted(chosen)[:max(landmarks, len(order))]]
    rows = sample.where(F.col("doc_id").isin(marks)).select("doc_id", "text").mapInArrow(_codes(letters), "doc_id long, codes array<long>")
    codes = [np.array(r.codes, np.int64) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    model = Landmarks.of(letters, codes)
    rows = sample.select("text", "lang").mapInArrow(_kernel_rows(model), "k array<float>, lang string").collect() if codes else []
    tables.drop("sample")
    languages = sorted({r.lang for r in rows})
    if not languages:
        return LanguageModel(model, np.zeros((len(codes), 0)), [])
    # a fixed order of the rows: sums, and so weights, do not depend on the layout
    rows = sorted(rows, key=lambda r: (r.lang, r.k))
    kernel = np.array([r.k for r in rows], np.float64)
    own = (model.columns.T @ model.columns).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = kernel @ whiten
    goal = np.where(np.array([r.lang for r in rows])[:, None] == np.array(languages), 1.0, -1.0)
    share = 1 / np.maximum(1, (goal > 0).sum(axis=0))[np.argmax(goal, axis=1)]       # languages count alike
    weighed = phi * share[:, None]
    weights = np.linalg.solve(weighed.T @ phi + RIDGE * np.eye(phi.shape[1]), weighed.T @ goal)
    return LanguageModel(model, whiten @ weights, languages)


def _predicted(model):
    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [model.value(p.column("text")) for p in slices(pa.record_batch({"text": texts}))]
            yield pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.float64())], ["lang", "score"])

    return predict


def langid(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learned from text and non-null language of documents outside the held-out
    fold (crc32 of the id modulo 3 is 1); rows without id count as held out.
    Texts that are null or have no letters are ``und`` with score 0, and so is
    every text if there is nothing to learn from.  Of equally good languages the
    first by name is taken.  Equal texts get equal results.  Of rows with clashing
    ids one is learned from (see :func:`train_langid`) and all are predicted.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_langid(docs, lang, doc_id=doc_id, text=text))
    held = F.coalesce(fold_of(doc_id, FOLDS) == HELD_OUT, F.lit(True))
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"),
                      _predicted(model)(F.col(text).cast("string")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
