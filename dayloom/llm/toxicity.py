"""Toxicity by a fuzzy lexicon whose hits are weighed by their context.

The lexicon is learned from labelled documents: whole words that toxic documents
have far more often than others, and stems that many such words begin with.  A
trie of it, run together with a Levenshtein automaton of one edit, becomes one
deterministic automaton over bytes, which numpy steps for all different words of
a slice at once.  A swap of neighbours is one edit too; in stems the edit lies
before the last letter.  Words that one digit or mark cuts are run again as one.
Each hit counts by the words around it and by whether it stands in quotation
marks; a logistic model over the sums gives the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, fold_of, labelled_sample, logistic
from dayloom.llm.spans import LOWER, SPACED, Words, _table, slices, words_of

#: Labelled documents that the lexicon and the model are learned from, at most.
SAMPLE_ROWS = 12_000
CONTEXT_WORDS = 8
FOLDS, HELD_OUT = 5, 0
FUZZY_FROM, STEM_FROM, STEM_WORDS = 4, 4, 4
EXACT, FUZZY, STEM = 1, 2, 3
FUZZY_SHARE = 0.7

LETTERS = _table([(0x61, 0x7A), (0x80, 0xFF)], True)


@dataclass
class Automaton:
    """step[state, class of byte] is the next state; state 0 rejects all that follows, 1 is the start."""

    classes: np.ndarray
    step: np.ndarray
    kind: np.ndarray
    entry: np.ndarray

    @staticmethod
    def of(lexicon: list[tuple[str, bool, bool]], swaps: bool = False) -> Automaton:
        """From entries (word, is a stem, one edit allowed); ``swaps``: two neighbours that changed places are one edit.

        States are sets of (node, e): no edit so far (0), one (1), one that led
        to this end of a stem (LANDED), all that follows a misspelled stem
        (INSIDE), or the byte still to come of a swap (SWAP + byte).
        """
        landed, inside, swap = 2, 3, 4
        children: list[dict[int, int]] = [{}]
        word_at: dict[int, int] = {}
        stem_at: dict[int, int] = {}
        fuzzy = [False]
        for number, (word, stem, edit) in enumerate(lexicon):
            node = 0
            path = [0]
            for b in word.encode():
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    fuzzy.append(False)
                node = children[node][b]
                path.append(node)
            (stem_at if stem else word_at).setdefault(node, number)
            if edit:
                for n in path:
                    fuzzy[n] = True
        letters = sorted({b for c in children for b in c})
        classes = np.zeros(256, np.int64)
        classes[letters] = np.arange(1, len(letters) + 1)
        bent = {n for n, s in stem_at.items() if lexicon[s][2]}

        def edited(node: int) -> set:
            return {(c, landed if c in bent else 1) for c in children[node].values() if fuzzy[c]}

        def closed(states: set) -> frozenset:
            for node, e in list(states):        # a letter of the entry is missing
                if e == 0 and fuzzy[node]:
                    states |= edited(node)
            return frozenset(states | {(n, inside) for n, e in states if e == 1 and n in bent})

        def after(states: frozenset, b: int) -> frozenset:
            out = set()
            for node, e in states:
                if e == inside:
                    out.add((node, e))
                elif e >= swap:
                    if b == e - swap:
                        out.add((node, 1))
                elif b in children[node]:
                    child = children[node][b]
                    if e == 0 or fuzzy[child]:
                        out.add((child, min(e, 1)))
                if e == 0 and fuzzy[node]:
                    out.add((node, 1))          # a letter too many
                    out |= edited(node)
                    if swaps:
                        out |= {(d, swap + x) for x, c in children[node].items() if x != b and (d := children[c].get(b)) is not None and fuzzy[d]}
            return closed(out)

        start = closed({(0, 0)})
        number = {frozenset(): 0, start: 1}
        order, rows = [frozenset(), start], []
        kind, entry = [], []
        while len(rows) < len(order):
            here, row = order[len(rows)], []
            stem = next((s for n, e in here if e == 0 and (s := stem_at.get(n)) is not None), None)
            exact = next((s for n, e in here if e == 0 and (s := word_at.get(n)) is not None), None)
            near = min((s for n, e in here for s in (word_at.get(n) if e in (1, landed) else stem_at[n] if e == inside else None,)
                        if s is not None and lexicon[s][2]), default=None)
            kind.append(EXACT if exact is not None else STEM if stem is not None else FUZZY if near is not None else 0)
            entry.append(next((x for x in (exact, stem, near) if x is not None), -1))
            for b in [-1, *letters]:
                new = frozenset({(n, e) for n, e in here if n in stem_at and e == 0}) if stem is not None else after(here, b)
                if new not in number:
                    number[new] = len(order)
                    order.append(new)
                row.append(number[new])
            rows.append(row)
        return Automaton(classes, np.array(rows, np.int32), np.array(kind, np.int8), np.array(entry, np.int32))

    def run(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Last state of each word."""
        out = np.zeros(len(starts), np.int32)
        live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        while len(live):
            state = self.step[state, self.classes[raw[at]]]
            at = at + 1
            done = at == ends[live]
            out[live[done]] = state[done]
            on = ~done & (state != 0)
            live, state, at = live[on], state[on], at[on]
        return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the number of toxic and other documents that have it."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), LETTERS, LOWER)
            toxic = part.column("label").to_numpy(zero_copy_only=False) > 0
            _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            pair = np.unique(inverse * part.num_rows + words.doc)
            term, doc = pair // part.num_rows, pair % part.num_rows
            body = words.raw.tobytes()
            names = [body[words.starts[i]:words.ends[i]] for i in first]
            yield pa.record_batch({
                "term": pa.array(names, pa.binary()),
                "toxic": pa.array(np.bincount(term[toxic[doc]], minlength=len(first)), pa.int64()),
                "other": pa.array(np.bincount(term[~toxic[doc]], minlength=len(first)), pa.int64())})


def branches(words: dict[str, int]) -> list[str]:
    """Beginnings of at least ``STEM_FROM`` letters at which ``STEM_WORDS`` words part into three directions or more."""
    below: dict[str, list[str]] = defaultdict(list)
    for w in words:
        for k in range(STEM_FROM, len(w)):
            below[w[:k]].append(w)
    found = [p for p, ws in below.items() if len(ws) >= STEM_WORDS and len({w[len(p)] for w in ws}) >= 3]
    return sorted(found, key=lambda p: (-sum(words[w] for w in below[p]), p))


def propose(words: dict[str, int], stems: dict[str, int], least: int) -> list[tuple[str, bool, bool]]:
    """Lexicon entries: the shortest of nested stems, and words of enough documents; those that a stem begins are there for their misspellings."""
    top: list[str] = []
    for p in sorted(stems, key=len):
        if not any(p.startswith(s) for s in top):
            top.append(p)
    whole = [w for w, t in words.items() if t >= least and w not in top]
    ranked = [(n, w, stem, len(w.encode()) >= FUZZY_FROM)
              for n, w, stem in [*((stems[p], p, True) for p in top), *((words[w], w, False) for w in whole)]]
    return [x[1:] for x in sorted(ranked, key=lambda x: (-x[0], x[1]))]


def select(entries: list[tuple[str, bool, bool]], hits: list, n_other: int) -> list[tuple[str, bool, bool]]:
    """Entries that hit few other documents and are common, or explain toxic ones which those before them leave with one hit or none.

    The second rule leaves out words that merely come with the copies of one document.
    Words that a kept stem begins stay as long as their misspellings hit few other documents.
    """
    per: dict[int, dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
    others: dict[tuple[int, int], int] = defaultdict(int)
    for r in hits:
        if r.label > 0:
            per[r.entry][r.kind][r.doc] = r.n
        else:
            others[r.entry, r.kind] += r.n
    explained: dict[int, int] = defaultdict(int)
    kept, begun, top = [], [], {w for w, stem, _ in entries if stem}
    most = max((len(d) for kinds in per.values() for d in kinds.values()), default=0)
    for i, (word, stem, edit) in enumerate(entries):
        kind = STEM if stem else EXACT
        near = edit and others[i, FUZZY] <= max(0.1 * len(per[i][FUZZY]), 1e-4 * n_other)
        if not stem and (own_stem := next((word[:k] for k in range(1, len(word)) if word[:k] in top), None)):
            if near:
                begun.append((own_stem, (word, stem, edit)))
            continue
        own = per[i][kind]
        if not own or others[i, kind] > 0.1 * len(own):
            continue
        if len(own) < 0.1 * most and sum(explained[d] < 2 for d in own) < max(3, 0.05 * len(own)):
            continue
        for d, n in own.items():
            explained[d] += n
        kept.append((word, stem, near))
    left = {w for w, stem, _ in kept if stem}
    return kept + [entry for own_stem, entry in begun if own_stem in left]


@dataclass
class Lexicon:
    entries: list[tuple[str, bool, bool]]
    automaton: Automaton
    context_hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that match, kind of the match, entry."""
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        state = self.automaton.run(words.raw, words.starts[first], words.ends[first])[inverse]
        hit = self.automaton.kind[state] > 0
        # two words around one digit or mark that is an edit; the hit is at the first
        cut = (words.starts[1:] - words.ends[:-1] == 1) & (words.doc[1:] == words.doc[:-1]) & ~hit[1:] & ~hit[:-1]
        cut = np.flatnonzero(cut)
        cut = cut[SPACED[words.raw[words.ends[cut]]]]
        state[cut] = self.automaton.run(words.raw, words.starts[cut], words.ends[cut + 1])
        at = np.flatnonzero(self.automaton.kind[state])
        return at, self.automaton.kind[state[at]], self.automaton.entry[state[at]]

    def context(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Mean weight of the words around each hit; hits themselves and unknown words weigh nothing."""
        own = np.zeros(len(words.starts))
        if len(self.context_hashes):
            place = np.minimum(np.searchsorted(self.context_hashes, words.hashes), len(self.context_hashes) - 1)
            own = np.where(self.context_hashes[place] == words.hashes, self.context_weights[place], 0.0)
        own[at] = 0.0
        sums = np.concatenate([[0.0], np.cumsum(own)])
        lo = np.maximum(at - CONTEXT_WORDS, words.first[words.doc[at]])
        hi = np.minimum(at + CONTEXT_WORDS + 1, words.first[words.doc[at] + 1])
        return (sums[hi] - sums[lo]) / np.maximum(1, hi - lo - 1)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: logarithms of all weighed hits, fuzzy ones, stems and quoted ones; the last column is 1.

        Fuzzy hits count ``FUZZY_SHARE`` in the first, so that they tell something even if the sample has none.
        """
        words = words_of(texts, LETTERS, LOWER)
        at, kind, _ = self.hits(words)
        quoted = _quoted(words, at)
        weight = np.where(quoted, 0.25, 1.0) * logistic(1.0 + self.context(words, at))
        out = np.ones((len(texts), 5))
        share = np.where(kind == FUZZY, FUZZY_SHARE, 1.0) * weight
        for j, sel in enumerate((kind > 0, kind == FUZZY, kind == STEM)):
            out[:, j] = np.log1p(np.bincount(words.doc[at[sel]], weights=share[sel], minlength=len(texts)))
        out[:, 3] = np.log1p(np.bincount(words.doc[at[quoted]], minlength=len(texts)))
        return out


def _quoted(words: Words, at: np.ndarray) -> np.ndarray:
    """Whether a word stands behind an opened quotation mark of its line."""
    raw = words.raw
    n = len(raw)
    straight = raw == 0x22
    sign = np.zeros(n, np.int64)
    if n > 2:
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        sign[1:][pair == 0xC2AB] = 1            # « »
        sign[1:][pair == 0xC2BB] = -1
        curly = (pair[:-1] == 0xE280)
        sign[2:][curly & (raw[2:] == 0x9C)] = 1     # “ ”
        sign[2:][curly & (raw[2:] == 0x9D)] = -1
    odd, depth = np.concatenate([[0], np.cumsum(straight)]), np.concatenate([[0], np.cumsum(sign)])
    begins = np.zeros(n + 1, np.int64)
    begins[1:][raw == 0x0A] = np.flatnonzero(raw == 0x0A) + 1
    begins[words.offsets[:-1]] = words.offsets[:-1]
    line = np.maximum.accumulate(begins)[words.starts[at]]
    here = words.starts[at]
    return ((odd[here] - odd[line]) % 2 == 1) | (depth[here] - depth[line] > 0)


def _entry_hits(lexicon: Lexicon):
    """Hits of each entry by kind: a row per toxic document, and the number of documents for all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), LETTERS, LOWER)
                at, kind, entry = lexicon.hits(words)
                key, n = np.unique((entry.astype(np.int64) * 4 + kind) * part.num_rows + words.doc[at], return_counts=True)
                doc, key = key % part.num_rows, key // part.num_rows
                toxic = part.column("label").to_numpy(zero_copy_only=False)[doc] > 0
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                yield pa.record_batch({
                    "entry": pa.array((key // 4).astype(np.int32)), "kind": pa.array((key % 4).astype(np.int32)),
                    "label": pa.array(toxic.astype(np.int32)), "doc": pa.array(np.where(toxic, ids, 0)),
                    "n": pa.array(np.where(toxic, n, 1).astype(np.int64))})

    return run


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = lexicon.features(part.column("text"))
                yield pa.record_batch({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "label": part.column("label")})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton steps; the last column of ``x`` is the constant and is not shrunk.  Without rows, a low constant."""
    if not len(y):
        return np.array([0.0] * 4 + [-4.0])
    shrink = np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        gradient = x.T @ (p - y) + shrink * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2.0, 2.0)
    return w


def judge(sample: DataFrame, words: dict[str, int], stems: dict[str, int], least: int, n_other: int) -> list[tuple[str, bool, bool]]:
    """Entries that pass :func:`select`.

    A stem counts by its words, but is judged by its documents.  When one does not
    pass, all starts again without it: its words, itself if it is one, and longer
    stems stand for themselves then.
    """
    stems = dict(stems)
    while True:
        entries, judged = propose(words, stems, least), None
        begun = {w for w, stem, _ in entries if stem}
        lost: set[str] = set()
        while judged != entries and not lost:       # what hit an entry that goes or loses its edit may hit another one then
            judged = entries
            hits = (sample.mapInArrow(_entry_hits(Lexicon(entries, Automaton.of(entries, swaps=True))), "entry int, kind int, label int, doc long, n long")
                    .groupBy("entry", "kind", "label", "doc").agg(F.sum("n").alias("n"))).collect()
            entries = select(entries, hits, n_other)
            lost = begun - {w for w, stem, _ in entries if stem}
        if not lost:
            return entries
        for stem in lost:
            del stems[stem]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
                   doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn lexicon, context and weights from at most ``sample_rows`` labelled documents outside the held-out fold.

    What comes to the driver is bounded by the sample: the words that toxic
    documents of it have far more often, all of which are candidates, their
    hits, words of 20 of its documents or more, and five numbers for each document.
    """
    tables = Tables(docs.sparkSession)
    sample = tables.keep(labelled_sample(docs, labels, label, FOLDS, HELD_OUT, sample_rows, doc_id, text), "sample")
    totals = sample.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
    terms = tables.keep(sample.select("text", "label").mapInArrow(_terms, "term binary, toxic long, other long")
                        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
    odds = (F.log((F.col("toxic") + 0.5) / (totals[0] + 1)) - F.log((F.col("other") + 0.5) / (totals[1] + 1)))
    terms = terms.withColumn("odds", odds).withColumn("term", F.decode("term", "UTF-8"))
    strong = terms.where("toxic >= 2 and odds > 2.5")
    words = {r.term: r.toxic for r in sorted(strong.collect(), key=lambda r: (-r.toxic, r.term))}
    # so many documents that no word of this corpus is expected to have only toxic ones by chance
    rate = (totals[0] + 1) / (sum(totals) + 2)
    least = max(3, int(np.ceil(np.log(100 * (terms.where("toxic + other >= 3").count() + 1)) / -np.log(rate))))
    begins = branches(words)
    beginning = F.explode(F.transform(F.sequence(F.lit(STEM_FROM), F.greatest(F.lit(STEM_FROM), F.length("term"))),
                                      lambda k: F.substring("term", F.lit(1), k)))
    stems = (terms.where(F.length("term") >= STEM_FROM).select(beginning.alias("stem"), "toxic", "other")
             .join(F.broadcast(docs.sparkSession.createDataFrame([(b,) for b in begins], "stem string")), "stem")
             .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()) if begins else []
    stems = {r.stem: r.toxic for r in stems if r.toxic >= least and r.other <= 0.1 * r.toxic}
    entries = judge(sample, words, stems, least, totals[1])

    around = terms.where("toxic + other >= 20").orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("toxic") + F.col("other"))), "term")
    context = {r.term: float(np.clip(r.odds, -2, 2)) for r in around.collect()}
    words = words_of(pa.array(list(context), pa.string()), LETTERS, LOWER)
    weights = np.array(list(context.values()))[words.doc] if context else np.zeros(0)
    order = np.argsort(words.hashes)
    lexicon = Lexicon(entries, Automaton.of(entries, swaps=True), words.hashes[order], weights[order])

    rows = sample.select("text", "label").mapInArrow(_feature_rows(lexicon), "x array<double>, label int").collect()
    tables.drop("sample", "terms")
    x = np.array(sorted((r.x, int(r.label > 0)) for r in rows), dtype=object)
    fit = fit_logistic(np.array([r[0] for r in x], float).reshape(-1, 5), np.array([r[1] for r in x], float))
    return ToxicityModel(lexicon, fit)


def toxicity_score(text: str | Column, model: ToxicityModel, docs: DataFrame) -> Column:
    """Score of whole texts from 0 to 1; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found: ToxicityModel = shared.value
        for texts in batches:
            parts = slices(pa.record_batch({"text": texts}))
            out = [logistic(found.lexicon.features(p.column("text")) @ found.weights) for p in parts]
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    return score(F.col(text) if isinstance(text, str) else text)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score of 0.5 or more).

    Learned from labelled rows outside the held-out fold (crc32 of the id modulo
    5 is 0); rows without id count as held out.  Null and empty texts get the
    score of a text without hits.  Without labelled rows every score is low.
    Equal texts have equal scores.  Other columns are not looked at.
    """
    model = train_toxicity(docs, labels, label, doc_id=doc_id, text=text)
    held = F.coalesce(fold_of(doc_id, FOLDS) == HELD_OUT, F.lit(True))
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"),
                        toxicity_score(F.col(text).cast("string"), model, docs).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
