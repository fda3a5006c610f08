"""Toxicity, language and quality: held-out accuracy and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from dayloom.llm.common import labelled_sample
from dayloom.llm.langid import Landmarks, code_points, grams, langid, train_langid
from dayloom.llm.quality import FEATURES, features, fit_forest, quality
from dayloom.llm.toxicity import EXACT, FUZZY, STEM, Automaton, branches, propose, toxicity, train_toxicity

SF = SF_SMALL.replace("0.001", "0.01")
ODD = [(9001, None), (9002, ""), (9003, " \n 123 !!"), (9004, "x" * 100_000), (None, "plain words"), (9005, "plain words"), (9005, "plain words")]


def docs_of(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", 1.0, "z") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, score double, label string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def accuracy(frame, truth, column):
    rows = [r for r in frame.collect() if r.held_out and truth.get(r.doc_id) is not None]
    return np.mean([r[column] == truth[r.doc_id] for r in rows]), len(rows)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(1)
    entries = [("loser", False, True), ("scum", False, False), ("lowe", True, False), ("moron", False, True), ("closer", False, True)]
    automaton = Automaton.of(entries)
    words = {"".join(rng.choice("losermnwcu") for _ in range(rng.randrange(1, 9))) for _ in range(4000)}
    words |= {"loser", "losr", "closer", "looser", "scum", "scun", "lowest", "lowe", "low", "mor0n", "moron", "mroon"}
    for w in sorted(words):
        raw = np.frombuffer(w.encode(), np.uint8)
        kind = automaton.kind[automaton.run(raw, np.array([0]), np.array([len(raw)]))[0]]
        if w in ("loser", "scum", "moron", "closer"):
            want = EXACT
        elif w.startswith("lowe"):
            want = STEM
        else:
            want = FUZZY if any(e and distance(w, x) <= 1 for x, _, e in entries) else 0
        assert kind == want, w


def test_toxicity_held_out_and_misspelled(spark):
    rng = random.Random(2)
    bad = ["idiot", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(900):
        words = [f"{rng.choice('bdfgkmp')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randrange(40)}" for _ in range(30)]
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1, "clash"))
    rows += [(2000, "you Worthles idiott"), (2001, "the word \"idiot\" was quoted by them, no more"), *ODD]
    got = toxicity(docs_of(spark, rows), labels_of(spark, [*labels, (3, None, None, None), (None, 1, 1, None)]), "toxic")
    share, n = accuracy(got, {i: t for i, t, *_ in labels}, "predicted")
    assert n > 100 and share == 1.0
    by = {r.doc_id: r for r in got.collect()}
    assert by[2000].predicted == 1 and by[2001].score < by[2000].score
    assert by[9001].score == by[9002].score == by[9003].score < 0.5 and len([r for r in got.collect() if r.doc_id == 9005]) == 2
    assert by[9002].held_out == (zlib.crc32(b"9002") % 5 == 0) and by[None].held_out


def swapped(w):
    return {w[:k] + w[k + 1] + w[k] + w[k + 2:] for k in range(len(w) - 1)}


def test_automaton_with_swaps_and_edits_in_stems():
    rng = random.Random(8)
    entries = [("idiot", True, True), ("idiots", False, True), ("scum", False, True), ("moro", True, False), ("morons", False, True)]
    automaton = Automaton.of(entries, swaps=True)
    words = {"".join(rng.choice("idotscumrn") for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    for w in ("idiot", "idiots", "scum", "morons"):
        for k in range(len(w) + 1):
            words |= {w[:k] + w[k + 1:], *(w[:k] + c + w[k + j:] + tail for c in "ix" for j in (0, 1) for tail in ("", "ic"))} | swapped(w)
    for w in sorted(words - {""}):
        raw = np.frombuffer(w.encode(), np.uint8)
        kind = automaton.kind[automaton.run(raw, np.array([0]), np.array([len(raw)]))[0]]
        near = {x for x in ("idiots", "scum", "morons") if distance(w, x) <= 1 or w in swapped(x)}
        # a misspelled stem begins the word, and the edit is not at its last letter
        stem = any(w[:k] in swapped("idiot") or w[k - 1] == "t" and distance(w[:k - 1], "idio") == 1 for k in range(4, min(len(w), 6) + 1))
        want = STEM if w.startswith(("idiot", "moro")) else EXACT if w == "scum" else FUZZY if near or stem else 0
        assert kind == want, w


def test_toxicity_of_misspelled_stems_swaps_and_marks(spark):
    rng = random.Random(6)
    bad = ["scum", *(f"idiot{tail}" for tail in ("s", "ic", "ry", "er", "like")), "worthless"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"{rng.choice('bdfgkmp')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}" for _ in range(30)]
        for _ in range(2 * (i % 5 == 0)):
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0), 1, "clash"))
    planted = ["such idoitic idotry", "sucm and scm", "you id1ots and w0rthless", "wortlhess idioxs", "sc*m, wor-thless", "worht1ess scvm idiiotry"]
    clean = ["some plain words", "bana-lora di,fa", "12 3 scale worth idea"]
    rows += [(3000 + k, t) for k, t in enumerate(planted + clean)]
    by = {r.doc_id: r.predicted for r in toxicity(docs_of(spark, rows), labels_of(spark, labels), "toxic").collect()}
    assert [by[3000 + k] for k in range(len(planted + clean))] == [1] * len(planted) + [0] * len(clean)


def test_lexicon_has_no_cap():
    words = {f"{a}{b}{c}{d}zz": 9 for a in "bcdfg" for b in "aeiou" for c in "klmn" for d in "rstv"}
    assert {w for w, *_ in propose(words, {}, 3)} == set(words) and len(words) == 400
    families = [f"{a}{b}{c}{d}" for a in "bcdfghjk" for b in "aeiou" for c in "klmnpq" for d in "aeiou"]
    assert set(branches({f + tail: 2 for f in families for tail in ("x", "yy", "z", "w")})) == set(families) and len(families) == 1200


def test_words_of_a_rejected_stem_come_back(spark):
    """A stem that also begins words of other documents goes; its words, and a longer stem, stay."""
    rng = random.Random(12)
    tails = {"mer": 15, "my": 14, "bag": 13, "lord": 15, "bagger": 12, "bagful": 12, "bagged": 12, "bagpipe": 12}
    bad = [f"scum{tail}" for tail, n in tails.items() for _ in range(n)] + ["worthless"] * 30
    rows, labels = [], []

    def add(i, word, toxic):
        words = [f"{rng.choice('bdfgkmp')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}" for _ in range(12)]
        rows.append((i, " ".join([*words, word] if word else words)))
        labels.append((i, int(toxic), 1, "clash"))

    learned = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    for i, word in zip(learned, bad):
        add(i, word, True)
    for i, word in zip(learned[len(bad):], [f"scumble{x}" for x in "abcdefghijklmnopqrst"] + [""] * 800):
        add(i, word, False)
    entries = train_toxicity(docs_of(spark, rows), labels_of(spark, labels)).lexicon.entries
    found = {w for w, stem, _ in entries}
    assert ("scum", True) not in {(w, stem) for w, stem, _ in entries} and "worthless" in found
    assert {"scummer", "scummy", "scumlord"} <= found and ("scumbag", True) in {(w, stem) for w, stem, _ in entries}


def test_samples_take_one_row_of_an_id(spark):
    texts = [f"text {i % 7}" for i in range(20_000)]
    docs = docs_of(spark, [(4, t) for t in texts] + [(6, "b"), (6, "a"), (8, None)])
    got = labelled_sample(docs, labels_of(spark, [(4, 1, 0, None), (6, 0, 1, None), (6, 1, 1, None), (8, 1, 1, None)]), "toxic", 1, 9, 100).collect()
    least = min(set(texts), key=lambda t: zlib.crc32(t.encode()))
    assert sorted((r.doc_id, r.text, r.label) for r in got) == [(4, least, 1), (6, min("ab", key=lambda t: zlib.crc32(t.encode())), 1), (8, None, 1)]


def test_toxicity_of_the_tables(tables):
    docs, labels = tables
    got = toxicity(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    share, n = accuracy(got, truth, "predicted")
    assert got.count() == docs.count() and n > 50 and share > 0.95
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_without_labels(spark):
    docs, none = docs_of(spark, ODD), labels_of(spark, [])
    assert {r.predicted for r in toxicity(docs, none).collect()} == {0}
    assert {r.score for r in quality(docs, none).collect()} == {0.5}
    assert {(r.lang_pred, r.score) for r in langid(docs).collect()} == {("und", 0.0)}
    one_kind = labels_of(spark, [(9004, 1, 1, None), (9005, 1, 1, None)])
    assert quality(docs, one_kind).count() == toxicity(docs, one_kind).count() == len(ODD)
    empty = docs_of(spark, [])
    assert toxicity(empty, none).count() == quality(empty, none).count() == langid(empty).count() == 0


def test_langid(spark, tables):
    docs, _ = tables
    got = langid(docs)
    share, n = accuracy(got, {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}, "lang_pred")
    assert got.count() == docs.count() and n > 200 and share > 0.98
    mixed = docs.select("doc_id", "text", "lang").unionByName(docs_of(spark, ODD).select("doc_id", "text", "lang"))
    by = {r.doc_id: r for r in langid(mixed).collect()}
    assert by[9001].lang_pred == by[9002].lang_pred == by[9003].lang_pred == "und" and by[9003].score == 0.0
    assert by[9005].lang_pred in ("en", "fr", "de", "es") and 0 <= by[9005].score <= 1
    assert by[9001].held_out == (zlib.crc32(b"9001") % 3 == 1)


# First and last letter of eight alphabets.
ALPHABETS = ("az", "ая", "αω", "את", "აჰ", "ադ", "कह", "กฮ")


def alphabet_rows(rng, per_language):
    """Documents of two languages of each alphabet, each with letters of its own and some that both have."""
    rows = []
    for a, (low, high) in enumerate(ALPHABETS):
        letters = [chr(c) for c in range(ord(low), ord(high) + 1) if chr(c).isalpha()]
        third = len(letters) // 3
        for k, own in enumerate((letters[:2 * third], letters[third:])):
            for _ in range(per_language):
                rows.append((f"l{a}{k}", " ".join("".join(rng.choice(own) for _ in range(rng.randrange(2, 7))) for _ in range(12))))
    rng.shuffle(rows)
    return rows


def test_langid_of_many_alphabets(spark):
    rows = alphabet_rows(random.Random(3), 150)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid(docs).collect()}
    for name in {lang for lang, _ in rows}:
        told = [got[i].lang_pred == name for i, (lang, _) in enumerate(rows) if lang == name and got[i].held_out]
        assert len(told) > 20 and np.mean(told) > 0.95, name


def test_kernel_against_sets_of_grams():
    rows = [t for _, t in alphabet_rows(random.Random(4), 3)] + ["", "12 !", "a", "日本語 日本 abc" * 30]
    letters = np.unique(code_points(pa.array(rows[:40]))[0])
    letters = letters[[chr(c).isalpha() for c in letters]]
    known = {chr(c) for c in letters}

    def own(t):
        symbols = [c if c in known else "?" if c.isalpha() else " " for c in t.lower()]
        return {tuple(symbols[i:i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1) if any(c != " " for c in symbols[i:i + n])}

    marks = rows[:10] + rows[-1:]
    model = Landmarks.of(letters, [np.unique(grams(*code_points(pa.array([t])), letters)[1]) for t in marks])
    every = set().union(*map(own, marks))
    want = [[len(own(t) & own(m)) / max(1, len(own(t) & every) * len(own(m))) ** 0.5 for m in marks] for t in rows]
    got, lettered = model.kernel(pa.array([*rows, None]))
    assert np.allclose(got[:-1], want, atol=1e-6) and not got[-1].any()
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in rows] + [False]


def test_every_language_has_a_landmark_and_clashing_ids_are_settled(spark):
    rows = [(100 * k + j, f"word{chr(0x561 + k) * 3} {chr(0x561 + k)}{j}", f"l{k}") for k in range(30) for j in range(9)]
    schema = "doc_id long, text string, lang string"
    model = train_langid(spark.createDataFrame(rows, schema), landmarks=7)
    assert len(model.languages) == 30 and model.landmarks.columns.shape[1] == 30
    clash = rows + [(i, t + " other", "l0") for i, t, _ in rows] + [(i, t, "l1") for i, t, _ in rows]
    one = train_langid(spark.createDataFrame(clash, schema).repartition(3))
    two = train_langid(spark.createDataFrame(clash[::-1], schema).repartition(5))
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def test_quality(tables):
    docs, labels = tables
    got = quality(docs, labels)
    share, n = accuracy(got, {r.doc_id: r.quality for r in labels.collect()}, "predicted")
    assert got.count() == docs.count() and n > 80 and share > 0.97


def test_forest_against_plain_traversal():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = fit_forest(x, y, rounds=20)
    margin = forest.margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    for i in range(50):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - margin[i]) < 1e-9


def test_features():
    row = dict(zip(FEATURES, features(pa.array(["Aa aa 12!\nAa", None]))[0]))
    assert row["words"] == np.log1p(4) and row["distinct_words"] == 0.75 and row["top_word"] == 0.5 and row["lines"] == np.log1p(2)
    assert not features(pa.array([None, ""])).any()
