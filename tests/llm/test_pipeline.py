"""Registered queries against their SQL, and the pipeline stage by stage."""

import random
import tempfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from conftest import SF_SMALL
from dayloom.llm import catalog, sql
from dayloom.llm.token_output import public_tokenizer
from dayloom.llm.toxicity import toxicity
from test_benchmark_tokens import brute_hits
from test_dedup import brute_jaccard, edited, prose

TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF_SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in catalog.QUERIES
    assert set(catalog.QUERIES) <= set(driver.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    columns, base = docs.columns, tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        source, before = docs, [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF_SMALL).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if k < 4:
            assert docs.columns == columns
            after = [(r.doc_id, r.text) for r in docs.collect()]
            assert set(after) <= set(before)
        if name == "ngram_jaccard_join":
            joined = brute_jaccard(before)
            assert sorted(i for i, _ in after) == sorted(i for i, n, c in joined if c == i)
        if name == "benchmark_decontamination":
            assert sorted(i for i, _ in after) == sorted(i for i, _, hits, _ in brute_hits(before, items) if not hits)
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
            kept = {r.doc_id for r in toxicity(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), labels).collect() if r.score < 0.5}
            assert sorted(after, key=repr) == sorted((x for x in before if x[0] in kept), key=repr)
            clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
            assert len(clean & {i for i, _ in before}) - len(clean & {i for i, _ in after}) <= 0.02 * len(clean)
        if name == "source_mixing":
            con = duckdb.connect()
            con.register("documents", source.toPandas())
            copies = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({sql.MIXING}) WHERE size > 0").fetchall()}
            texts = dict(before)
            assert Counter(i for i, _ in after) == Counter({i: n for i, n in copies.items() if n}) and all(texts[i] == t for i, t in after)
        if name == "token_output":
            rows = docs.orderBy("start").collect()
            assert [r.doc_id for r in rows] == sorted(i for i, _ in before)
            assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
            library = Tokenizer.from_file(public_tokenizer())
            want = Counter()
            for i, t in before:
                ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
                want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_run_survives_empty_and_null_rows(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    for name, keep in (("none", []), ("few", rows)):
        spark.createDataFrame(keep, schema).write.parquet(f"{base}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{base}/{name}/{t}.parquet")
        got = corpus_pipeline.run(spark, f"{base}/{name}")
        # documents without words are never taken by the mix; of the equal rows of id 3 one is left, and taken up to three times
        assert {r.doc_id for r in got.collect()} <= {None, 3} if name == "few" else got.count() == 0


def test_one_of_each_group_with_clashing_ids(spark):
    rng = random.Random(12)
    base = [prose(rng, 80, 500) for _ in range(6)]
    rows = [(rng.randrange(1, 9), edited(rng, base[g].split(), 1)) for g in range(6) for _ in range(4)]
    rows += [(1, base[0]), (1, base[1]), (1, base[2]), (20, "alone here"), (20, "alone here"), (20, "other text"), (21, None), (21, None), (None, base[0])]
    # with ids of their own, brute force tells which rows are one group
    groups = {}
    for (i, t), (_, n, c) in zip(rows, brute_jaccard([(k, t) for k, (_, t) in enumerate(rows)])):
        if i is not None and n:
            groups.setdefault(c, []).append((i, t))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF_SMALL).collect()]
    assert sorted((x for x in got if x[0] is None or x[1] is None), key=repr) == [(21, None), (21, None), (None, base[0])]
    left = [x for x in got if x[0] is not None and x[1] is not None]
    assert len(left) == len(groups)
    for own in groups.values():
        assert len([x for x in left if x in own]) == 1 and min(i for i, _ in own) == next(i for i, t in left if (i, t) in own)
