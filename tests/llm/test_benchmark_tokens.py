"""Benchmark decontamination and token shards against plain Python."""

import re
import zlib

import numpy as np
import pytest

from dayloom.llm.decontamination import decontamination, decontamination_digest
from dayloom.llm.token_output import Encoder, ShardReader, public_tokenizer, read_tokens, token_digest, write_tokens

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        ws = cut(t)
        n = min(10, len(ws))
        if i is not None and n:
            windows += [(str(i), ws[s:s + n]) for s in range(len(ws) - n + 1)]
    out = []
    for i, t in docs:
        ws = cut(t)
        hits, found = set(), set()
        for item, w in windows:
            for s in range(len(ws) - len(w) + 1):
                if ws[s:s + len(w)] == w:
                    hits |= set(range(s, s + len(w)))
                    found.add(item)
        out.append((i, len(ws), sorted(hits), sorted(found)))
    return out


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then it runs away"), (2, "short item É"), (10, "Short, ITEM é"), (3, None), (4, " !"),
         (None, "the quick brown"), (5, "one two three four five six seven eight nine ten"), (5, "another text for the same item id with eleven words here"),
         (6, "ha ha"), (6, "ha ha")]
DOCS = [(1, "He said: The QUICK brown-fox jumps over the lazy dog, and then nothing"), (2, None), (3, ""), (4, "short item É and short item É"),
        (5, "one two three four five six seven eight nine"), (6, "zero one two three four five six seven eight nine ten eleven"), (7, "ha ha ha ho ha"),
        (8, "filler " * 30_000 + "one two three four five six seven eight nine ten"), (None, "ha ha"), (6, "ha ha"), (6, "ha ha"),
        (9, "text for the same item id with eleven words here")]


@pytest.mark.parametrize("block", [1_000_000, 4])
def test_decontamination(spark, block):
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in DOCS], "doc_id long, text string, hits int, item string")
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, n int")
    got = [(r.doc_id, r.n_words, r.hits, r["items"]) for r in decontamination(docs, items, block_windows=block).collect()]
    assert sorted(got, key=repr) == sorted(brute_hits(DOCS, ITEMS), key=repr)
    clean = decontamination_digest(docs, items.where("item_id > 100")).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated for r in clean)
    assert decontamination(docs.where("doc_id < 0"), items, block_windows=block).count() == 0


TEXTS = [(5, "a  b   c"), (3, None), (1, ""), (2, "x\n  y z \n\n w  "), (9, "<|endoftext|> hi"), (7, " lead x   y é"), (None, "null id"),
         (5, "a  b   c"), (5, "other"), (8, "word, " * 50_000 + "end."), (10, " "), (11, "\n a"), (12, "a \nb"), (13, "a\n\n b'll don't it's. x.y, 3.5, été."),
         (14, "  q  z"), (15, "tab\t x .  , a, ,b")]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


def test_encoder_equals_library():
    encoder = Encoder(public_tokenizer())
    texts = [t or "" for _, t in TEXTS]
    for _ in range(2):
        assert [x.tobytes() for x in library(texts)] == encoder(texts)


def test_tokens(spark):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in TEXTS], "doc_id long, text string, start int, shard string")
    got = sorted(map(tuple, token_digest(docs).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = np.append(library([t])[0], np.uint32(2)).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_digest(docs.where("doc_id < 0")).count() == 0


def test_one_document_of_a_shard(spark):
    docs = spark.createDataFrame([(i, f"document number {i} holds a few words") for i in range(200)], "doc_id long, text string")
    shards, dictionary = write_tokens(docs, public_tokenizer())
    assert dictionary and read_tokens(shards, dictionary).count() == 200
    first = min(shards.collect(), key=lambda r: r.start)
    reader = ShardReader(first.shard, dictionary)
    at = reader.index["doc_id"].to_pylist().index(3)
    assert reader.ids(at) == np.append(library(["document number 3 holds a few words"])[0], np.uint32(2)).astype("<u4").tobytes()
    with pytest.raises(ValueError):
        ShardReader(first.shard, b"another dictionary")
