"""Filter audit, quality rules and conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
import pytest

from dayloom.llm.conversation_repair import BLOCK, block_costs, conversation_digest, conversation_repair, search
from dayloom.llm.filter_audit import filter_audit
from dayloom.llm.quality_rules import BASE, RULES, View, cascade, quality_rules, quality_rules_digest, rule_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, h1 long, mask int, kept string, n long"


def docs_frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, 1, 2, "x", None) for i, t, s in rows], DOCS)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"word{chr(97 + i)}" for i in range(26)] + ["été", "$5", "ABC", "|", "1234", "ok."]
    out = []
    for _ in range(n):
        k = rng.choice([0, 5, 30, 60, 120])
        ws = [rng.choice(vocabulary[:rng.choice([26, 32])]) + str(rng.randrange(rng.choice([3, 90]))) for _ in range(k)]
        cut = rng.randrange(k + 1)
        out.append(" ".join(ws) if rng.random() < 0.5 else " ".join(ws[:cut]) + "\n" + " ".join(ws[cut:]) + "\n" + " ".join(ws[:cut]))
    return out


# --- filter audit

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = []
    for part, members in parts.items():
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            alive = [True] * len(members)
            for k, x in enumerate(order):
                row = [part, "".join(order), k + 1, 0, 0, 0, 0, 0, 0]
                for j, (fails, q, t) in enumerate(members):
                    row[3] += alive[j] and not fails[x]
                    row[4] += alive[j] and fails[x]
                    row[5] += not alive[j] and fails[x]
                    row[6] += fails[x] and sum(fails.values()) == 1
                    row[7] += alive[j] and fails[x] and q
                    row[8] += alive[j] and fails[x] and t
                    alive[j] = alive[j] and not fails[x]
                total[x] += row[4]
                steps.append((row, x))
        out += [(*row, total[x]) for row, x in steps]
    return out


def test_filter_audit(spark):
    base = texts(3, 40)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)] + [(100 + i, base[i % 5], "s0") for i in range(20)]
    rows += [(1, base[1], "s1"), (1, base[2], "s1"), (None, base[0], None), (None, base[0], "s0"), (200, None, None), (201, "", ""), (202, "x " * 20_000, "s2")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, text string")
    got = [tuple(r) for r in filter_audit(docs_frame(spark, rows), known).collect()]
    assert sorted(got) == sorted(brute_audit(rows, labels))
    assert len({r[0] for r in got}) * 600 == len(got)


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs_frame(spark, []), labels).count() == 0
    one = filter_audit(docs_frame(spark, [(1, "a", "s")]), labels).collect()
    assert len(one) == 600 and {r.good_lost for r in one} == {0}


# --- quality rules

def brute_rules(t):
    t = t or ""
    ws, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[k:k + 5]) for k in range(len(ws) - 4))
    covered = {j for k in range(len(ws) - 4) if grams[tuple(ws[k:k + 5])] > 1 for j in range(k, k + 5)}
    n, chars, symbols, dup = len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls))
    failed = n < 10 or 100 * len(covered) > 20 * n
    rejected = {
        "word_length": chars < 2 * n or chars > 15 * n, "symbols": 10 * symbols > n,
        "letters": 100 * sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) for w in ws) < 80 * n,
        "capitals": 100 * len(re.findall("[A-Z]", t)) > 40 * chars, "digits": 100 * len(re.findall("[0-9]", t)) > 20 * chars,
        "same_lines": 100 * dup > 30 * len(ls), "bullets": 100 * sum(x[0] in "*-" for x in ls) > 90 * len(ls),
        "trailing": 100 * sum(x.endswith("...") for x in ls) > 30 * len(ls)}
    return (n, chars, symbols, dup, len(covered), failed), rejected


def rule_rows():
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    prose = " ".join(words[:40])
    own = [prose, prose.replace(" ", "$ "), " ".join("1234567" for _ in range(12)) + " " + prose, prose.upper(), "\n".join(["same line here"] * 4 + words[:30]),
           "\n".join(f"- {w} a" for w in words[:20]), "\n".join(f"* {w}" for w in words[:20]), "\n".join(f"{w} and..." for w in words[:20]),
           " ".join("x" * 40 + w for w in words[:20]), " ".join("abcdefghijk"[i % 11] for i in range(11)), prose + " été ... ..\n..\n...", "日本 " * 3 + prose,
           " ".join(f"{w} == =+" for w in words[:30]), "\n".join(f"-{w} aab" for w in words[:20]),
           "\n".join(f"{words[i]} {words[i + 1]} {words[i + 2]}\nagain" for i in range(0, 60, 3)), None, "", " \n\t ", "one", prose + " " + prose, " ".join(f"v{i}" for i in range(30_000))]
    return [(i, t, "s") for i, t in enumerate(own + texts(9, 40))] + [(0, prose, "s"), (None, prose, None), (None, None, None)]


def test_quality_rules(spark):
    rows = rule_rows()
    got = quality_rules_digest(docs_frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        counts, rejected = brute_rules(t)
        want.append((i, *counts, not counts[-1] and not any(rejected.values())))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for rule in RULES:      # each one is met by a row that no other rejects
        assert any(r[rule.name] and sum(r.values()) == 1 for r in (brute_rules(t)[1] for _, t, _ in rows)), rule.name


def test_every_order_has_the_same_verdict():
    rows = [t for _, t, _ in rule_rows() if t]
    want = [not any(brute_rules(t)[1].values()) for t in rows]
    rng = random.Random(2)
    for _ in range(6):
        order = rng.sample(RULES, len(RULES))
        assert cascade(View(pa.array(rows)), tuple(order)).tolist() == want


def test_rules_see_only_what_earlier_ones_let_through():
    rows = [t for _, t, _ in rule_rows() if t]
    seen = []
    spy = type(RULES[0])("spy", lambda v: (seen.append(v.texts.to_pylist()), RULES[1].fails(v))[1])
    cascade(View(pa.array(rows)), (RULES[2], spy))
    assert seen == [[t for t in rows if not brute_rules(t)[1]["letters"]]]


def test_rule_order(spark):
    rows = [(i, "$ a b c d e f g h i j " + "x" * i, "s") for i in range(60)] + [(100 + i, f"clean words only in this text number {chr(97 + i)} now", "s") for i in range(20)]
    order = rule_order(docs_frame(spark, rows))
    assert {r.name for r in order} == {r.name for r in RULES} and len(order) == len(RULES)
    assert order[0].name in ("symbols", "word_length")          # the others reject nothing
    assert [r.name for r in rule_order(docs_frame(spark, []), RULES[:2], given=BASE)] != []
    assert quality_rules(docs_frame(spark, [])).count() == 0
    again = [(7, rows[0][1], "s")] * 500                        # one id and text many times
    assert rule_order(docs_frame(spark, again), rows=3)


# --- conversation repair

NEXT, KEEP = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def cheapest(rows):
    """(cost, edits) of rows (initial, fault) by exhaustive choice."""
    @lru_cache(None)
    def go(i, q, inserts):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        if i < len(rows):
            role, fault = rows[i]
            cut = fault == "truncated"
            found.append((3, "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                if role in KEEP[q]:
                    found.append((cut, "K", i + 1, KEEP[q][role]))
                found.append((2 + cut, "R", i + 1, NEXT[q]))
        if inserts:
            found.append((2, "I", i, NEXT[q]))
        out = []
        for f in found:
            if len(f) == 2:
                out.append(f)
            elif (rest := go(f[2], f[3], inserts - 1 if f[1] == "I" else 3)) is not None:
                out.append((f[0] + rest[0], f[1] + rest[1]))
        return min(out, default=None)

    return go(0, 0, 3)


def brute_repair(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        lines, i, q = [], 0, 0
        for edit in audit:
            if edit == "K":
                q = KEEP[q][initials[i]]
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
            elif edit in "IR":
                q = NEXT[q]
                lines.append(("user" if q == 2 else "assistant") + ":" + (rows[i][2] if edit == "R" else ""))
            i += edit != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, b"x", "y") for r in rows], "conv_id long, turn long, role string, text string, seq int, h binary, kind string")


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    says = ["Yes.", "No!", "Well", "", " \t", "Why?", "It is so.", None, "a.b", "dot. "]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(says) if rng.random() < 0.3 else f"Line {rng.randrange(10**6)}."))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (900, None, "user", "a."), (900, None, "assistant", "b."), (900, None, None, None)]
    rows += [(901, t, "user" if t % 2 else "assistant", "Same.") for t in range(5)] * 2
    rows += [(902, t, rng.choice(["user", "assistant", "system", "x"]), f"Turn {t}" + rng.choice([".", ""])) for t in range(5 * BLOCK)]
    rows += [(903, 7, "user", "Same.")] * (2 * BLOCK + 5) + [(904, t, "user", "x " * 20_000 + ".") for t in range(3)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "Gone.")]


def test_conversation_repair(spark, talk):
    got = [tuple(r) for r in conversation_digest(conversations(spark, talk)).collect()]
    assert sorted(got, key=repr) == sorted(brute_repair(talk), key=repr)
    none = [r for r in got if r[0] is not None and r[0] >= 1000]
    assert none[0][1:8] == (0, 0, 0, 0, 0, 0, "") and none[0][8] == hashlib.sha256(b"").hexdigest()


def test_conversation_repair_of_nothing(spark):
    assert conversation_digest(conversations(spark, [])).count() == 0


def test_undamaged_rows_of_many_partitions(spark):
    """A conversation that is cut by ranges gives what it gives in one piece."""
    rows = [(5, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"t{t}.", False) for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean")
    one = conversation_repair(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = conversation_repair(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one == many and len(one[0].audit) >= 1000 and one[0].cost > 0


def test_blocks_and_whole_agree():
    rng = random.Random(4)
    last = (0, 4, 2, 0)
    for _ in range(300):
        marks = bytes(rng.choice([0, 1, 1, 2, 2, 3]) << 2 | rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(13)))
        want = cheapest(tuple(("sua?"[m >> 2], ("", "truncated", "blank")[m & 3]) for m in marks))
        cost, edits, end = search(marks, 0, last)
        assert (cost, edits + ("", "II", "I", "")[end]) == want
        cut = rng.randrange(len(marks) + 1)
        costs = block_costs(marks[cut:])
        value = tuple(min(costs[4 * q + r] + last[r] for r in range(4) if costs[4 * q + r] >= 0) for q in range(4))
        cost, head, mid = search(marks[:cut], 0, value)
        _, tail, end = search(marks[cut:], mid, last)
        assert (cost, head + tail + ("", "II", "I", "")[end]) == want
