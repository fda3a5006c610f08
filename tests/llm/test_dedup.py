"""Substring, line and Jaccard deduplication against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dayloom.llm.common import Tables
from dayloom.llm.components import components
from dayloom.llm.jaccard_join import jaccard_join
from dayloom.llm.line_dedup import line_dedup
from dayloom.llm.spans import ALNUM, LOWER, SPACED, lines_of, winnow, words_of
from dayloom.llm.substring_dedup import substring_dedup, substring_dedup_digest

SCHEMA = "doc_id long, text string, h long, tk string, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], SCHEMA)


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    out = []
    for i in range(60):
        a = base[rng.randrange(6)].split()
        cut = rng.randrange(50)
        body = a[cut:cut + rng.randrange(5, 40)]
        glue = rng.choice([" ", "\n", "\t ", "  "])
        out.append((i, prose(rng, rng.randrange(20)) + glue + glue.join(body) + " é " + prose(rng, 5)))
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, base[0]), (75, base[0]), (75, base[0]), (75, base[1]),
            (None, base[0]), (76, " ".join(base) * 3), (77, prose(rng, 30_000, 5_000)), (78, "\x00   a")]
    return out


def brute_substring(rows, k=13):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in docs:
        if i is not None:
            for s in range(len(ws) - k + 1):
                w = tuple(ws[s:s + k])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in docs:
        gone = set()
        for s in range(len(ws) - k + 1):
            if i is not None and first[tuple(ws[s:s + k])] < i:
                gone |= set(range(s, s + k))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_words_and_winnowing():
    words = words_of(pa.array(["a b", None, "", "é\tc", "x"]), SPACED)
    assert words.counts.tolist() == [2, 0, 0, 2, 1]
    assert words_of(pa.array(["A-b 1é\x7f"]), ALNUM, LOWER).counts.tolist() == [3]
    assert lines_of(pa.array(["a\n \n\nb", None, "\n"])).counts.tolist() == [2, 0, 0]
    again = words_of(pa.array(["zz b a", "q", "a"]))
    assert again.hashes[2] == again.hashes[4] == words.hashes[0]        # whatever stands before
    grams, inside = words_of(pa.array([" ".join("abcdefgh" * 3)])).grams(2)
    starts, at = winnow(grams, inside, np.zeros(24, int), 4)
    assert all(s <= p < s + 4 and grams[p] == grams[s:s + 4].min() for s, p in zip(starts, at))


def test_substring_dedup(spark, rows):
    got = substring_dedup(frame(spark, rows)).collect()
    assert order(map(tuple, got)) == order(brute_substring(rows))
    digest = {(r.doc_id, r.n_words): r.kept_sha256 for r in substring_dedup_digest(frame(spark, rows)).collect()}
    assert digest[71, 0] == hashlib.sha256(b"").hexdigest()


def test_substring_dedup_parameters_and_empty(spark, rows):
    got = substring_dedup(frame(spark, rows), min_words=4, seed_words=4).collect()
    assert order(map(tuple, got)) == order(brute_substring(rows, 4))
    assert substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(frame(spark, rows), min_words=3, seed_words=4)


def brute_lines(rows, k=3):
    docs = [(i, None if t is None else t.split("\n")) for i, t in rows]
    counted = [[j for j, x in enumerate(ls or []) if x.strip(" \t\n\v\f\r")] for _, ls in docs]
    first = {}
    for (i, ls), c in zip(docs, counted):
        if i is not None:
            for s in range(len(c) - k + 1):
                w = tuple(ls[j] for j in c[s:s + k])
                first[w] = min(first.get(w, i), i)
    out = []
    for (i, ls), c in zip(docs, counted):
        gone, own = set(), {}
        for s in range(len(c) - k + 1):
            w = tuple(ls[j] for j in c[s:s + k])
            if (i is not None and first[w] < i) or own.setdefault(w, s) + k <= s:
                gone |= set(range(s, s + k))
        lines = {c[u] for u in gone}
        kept = None if ls is None else "\n".join(x for j, x in enumerate(ls) if j not in lines)
        out.append((i, len(c), len(gone), kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = ["alpha", "beta é", "  gamma", "delta", "", "  ", "epsilon"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "a\nb\nc\nd"), (63, "x\na\nb\nc\n"), (64, "a\nb\nc"), (64, "a\nb\nc"), (None, "a\nb\nc\n\na\nb\nc"),
             (65, "\n".join(f"line {j % 700}" for j in range(5000)))]
    got = line_dedup(frame(spark, rows)).collect()
    assert order(map(tuple, got)) == order(brute_lines(rows))
    assert line_dedup(frame(spark, [])).count() == 0


def brute_short_lines(rows, short_words, k=3):
    docs = [(i, None if t is None else t.split("\n")) for i, t in rows]
    counted = [[j for j, x in enumerate(ls or []) if x.strip(" \t\n\v\f\r")] for _, ls in docs]
    runs = [[(s, tuple(ls[j] for j in c[s:s + m])) for m in range(1, k + 1) for s in range(len(c) - m + 1)] for (_, ls), c in zip(docs, counted)]
    first = {}
    for (i, _), found in zip(docs, runs):
        for _, w in found if i is not None else ():
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, ls), c, found in zip(docs, counted, runs):
        gone, own = set(), {}
        for s, w in found:
            again = own.setdefault(w, s) + len(w) <= s
            if (again or i is not None and first[w] < i) and (
                    len(w) == k or len(w) == len(c) or len(WORD.findall(" ".join(w))) > short_words):
                gone |= set(range(s, s + len(w)))
        lines = {c[u] for u in gone}
        out.append((i, len(c), len(gone), None if ls is None else "\n".join(x for j, x in enumerate(ls) if j not in lines)))
    return out


def test_short_line_dedup(spark):
    rng = random.Random(4)
    lines = ["alpha", "beta é of  six words or so", "  gamma with four words", "delta", "", " ", "epsilon and zeta and eta"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(7)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "only one"), (93, "only one"), (94, "x\nonly one\ny"), (95, "two lines\n\nof it"), (96, "two lines\nof it\n"),
             (None, "only one"), (None, "a b c d e f\n\na b c d e f"), (97, "q r"), (97, "q r"), (97, "q r\ns"), (98, "q r")]
    got = line_dedup(frame(spark, rows), short_words=4).collect()
    assert order(map(tuple, got)) == order(brute_short_lines(rows, 4))
    by = {r.doc_id: r.kept_text for r in got}
    assert (by[92], by[93], by[94], by[96]) == ("only one", "", "x\nonly one\ny", "")
    passage = prose(rng, 60)
    got = {r.doc_id: r.kept_text for r in line_dedup(frame(spark, [(1, f"a\n{passage}"), (2, f"b\n{passage}\nc")]), short_words=50).collect()}
    assert got == {1: f"a\n{passage}", 2: "b\nc"}
    assert line_dedup(frame(spark, []), short_words=4).count() == 0


def shingles(t):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(ws[j:j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set()


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        root = find(a)
        out.append((i, len(sets[a]), None if i is None else min(rows[b][0] for b in range(len(rows)) if rows[b][0] is not None and find(b) == root)))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return " ".join(words)


def test_jaccard_join(spark):
    rng = random.Random(11)
    rows = []
    for g in range(8):      # small groups around the limit
        base = prose(rng, 90, 500).split()
        rows += [(len(rows), edited(rng, base, n)) for n in (0, 1, 2, 3, 4, 5)]
    base = prose(rng, 150, 900).split()     # a large group whose shingles are all frequent
    rows += [(len(rows), edited(rng, base, rng.randrange(9))) for _ in range(120)]
    line = prose(rng, 40, 900)              # a passage that many unlike texts share
    rows += [(len(rows), prose(rng, rng.randrange(5, 60), 900) + " " + line) for _ in range(80)]
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "one"), (905, "É x"), (906, "é x"), (None, rows[0][1]),
             (907, rows[0][1]), (907, rows[0][1]), (907, rows[60][1]), (3, "same id other text " * 3), (908, prose(rng, 20_000, 9_000))]
    rng.shuffle(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(frame(spark, rows)).collect()]
    assert order(got) == order(brute_jaccard(rows))
    assert jaccard_join(frame(spark, [])).count() == 0
    assert jaccard_join(frame(spark, [(1, "only one text here")])).first().component_id == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (3, 1)] + [(20, i) for i in range(21, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Tables(spark), "c").collect()))
    assert got == {**dict.fromkeys((1, 2, 3), 1), 4: 4, 5: 4, **dict.fromkeys(range(10, 15), 10), **dict.fromkeys(range(20, 60), 20)}
    assert components(spark.createDataFrame([], "a long, b long"), Tables(spark), "none").count() == 0


def test_components_of_a_hub_and_many_equal_texts(spark):
    edges = [(5000, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(6000, 6040)] + [(2999, 6040)] + [(9000, 9001)] * 3
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Tables(spark), "hub").collect()))
    assert got == {**{n: 1 for e in edges[:-3] for n in e}, 9000: 9000, 9001: 9000}

    same = "one text that very many rows have and one id has beside another text"
    rows = [(i, same) for i in range(10, 2010)] + [(i, " ") for i in range(3000, 3400)] + [(None, same)] * 300
    rows += [(5, "alone"), (6, None), (4, "other words of id four"), (4, same)]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_join(frame_).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in range(10, 2010) for r in by_id[i]} == {4}
    assert all(r.component_id == r.doc_id and r.root is None for i in range(3000, 3400) for r in by_id[i])
    assert len(by_id[None]) == 300 and {r.component_id for r in by_id[None]} == {None}
    assert len({r.root for r in by_id[4]}) == 2 and by_id[5][0].component_id == 5 and by_id[6][0].root is None
