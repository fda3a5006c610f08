"""Documents whose sets of word n-grams overlap, joined by grouped prefixes.

Documents of one set are one node.  Let p(n) be the number of shingles of a set
of n that can miss in a partner, plus one: in any common order of shingles, two
sets that link share a shingle among their first p.  The order is, frequent ones
last:

1. Of the shingles with a hash below a fixed share ``RANGE`` of all hashes, those
   that over ``HOT`` nodes have are frequent.  The order begins with the others of
   the range.  Nodes with equal shingles in the range and equal size are one
   group; groups that share a shingle meet, pairs that can not overlap enough by
   their counts go, and the rest is expanded to nodes and verified on whole sets.
2. Nodes with fewer than p such shingles may miss each other in step 1, but not
   the other nodes.  They are joined again among themselves, over all their
   shingles, with frequencies among themselves.
3. What again has fewer than p infrequent shingles lies in large groups of near
   copies.  Nodes that share one of their first p shingles form clusters, and
   these are compared block by block; a block of about ``BLOCK`` shingles meets
   blocks of like sizes, and each comparison returns a spanning forest.

No list of more than about ``HOT`` nodes is expanded to pairs of rows.  Step 3 is
quadratic in the size of a group of near copies of which no two are equal.
Sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import lookup_by_frequency
from dayloom.llm.common import Tables, text_check
from dayloom.llm.components import components
from dayloom.llm.spans import LOWER, SPACED, as_long, mix, slices, words_of

WORDS = 5
PERCENT = 80
RANGE = 0.3
#: Bits of 64 that the nodes of a frequent shingle set: 20 bits are 24 nodes on average.
HOT = 20
BLOCK = 30_000

_U = np.uint64


def _sets(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text after one another, their n + 1 offsets, and a hash of each whole set."""
    cut = words_of(part.column("text"), SPACED, LOWER)
    full = cut.grams(words)[0]
    out = []
    for i in range(part.num_rows):
        lo, hi = cut.first[i], cut.first[i + 1]
        if hi - lo >= words:
            out.append(np.unique(full[lo:hi - words + 1]))
        else:       # the whole text is one shingle
            own = np.zeros(0, np.uint64)
            if hi > lo:
                own = mix(np.array([hi - lo], np.uint64))
                for h in cut.hashes[lo:hi]:
                    own = mix(own * _U(0xC2B2AE3D27D4EB4B) + h)
            out.append(own)
    counts = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)]), _set_hash(np.concatenate(out), counts)


def _set_hash(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ _U(0x5851F42D4C957F2D)))])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64) * _U(0x9E3779B97F4A7C13))


def _low(shingles: np.ndarray) -> np.ndarray:
    return shingles < _U(int(RANGE * 2**64))


def _described(words: int, shingles: bool):
    """For each document its node, size, group and shingles in the range; or a row for each shingle in the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                all_shingles, bounds, node = _sets(part, words)
                n = np.diff(bounds)
                low = _low(all_shingles)
                below = np.concatenate([[0], np.cumsum(low)])
                r = below[bounds[1:]] - below[bounds[:-1]]
                group = mix(_set_hash(all_shingles[low], r) + n.astype(np.uint64))
                if shingles:
                    doc = np.repeat(np.arange(part.num_rows), r)
                    yield pa.record_batch({"h": as_long(all_shingles[low]), "key": as_long(group[doc]),
                                           "n": pa.array(n[doc].astype(np.int32)), "r": pa.array(r[doc].astype(np.int32)),
                                           "bit": as_long(_U(1) << (node[doc] & _U(63)))})
                else:
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "tk": part.column("tk"), "node": as_long(node),
                                           "key": as_long(group), "n": pa.array(n.astype(np.int32)), "r": pa.array(r.astype(np.int32))})

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shingles, bounds, node = _sets(part, words)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), as_long(shingles))
                yield pa.record_batch({"node": as_long(node), "shingles": lists})

    return run


def _first(n: Column, percent: int) -> Column:
    """p(n): shingles of which two linked sets share at least one, in any order."""
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _can_link(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= (a + b) * percent


def _tier(rows: DataFrame, tables: Tables, name: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of keys that share an infrequent shingle and can link, and keys with too few infrequent ones.

    ``rows``: h, key, n (size of the set), r (rows of the key), bit (of the node).
    """
    shared = rows.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_or("bit").alias("bits"))
    hot = F.bit_count("bits") >= HOT
    shared = tables.keep(shared.where((F.col("lo") < F.col("hi")) | hot).select("h", hot.alias("hot")), f"{name}-shared")
    posts = tables.keep(rows.join(shared, "h").groupBy("h", "key").agg(*(F.min(c).alias(c) for c in ("n", "r", "hot"))), f"{name}-posts")
    hots = tables.keep(posts.where("hot").groupBy("key").agg(F.count("*").cast("int").alias("hots"), F.min("n").alias("n"),
                                                             F.min("r").alias("r")), f"{name}-hots")
    cold = posts.where("not hot").select("h", "key", "n", "r")
    a = cold.withColumnsRenamed({"key": "a", "n": "na", "r": "ra"})
    b = cold.withColumnsRenamed({"key": "b", "n": "nb", "r": "rb"})
    pairs = (a.join(b, "h").where(F.col("a") < F.col("b"))
             .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
             .groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count("*").alias("c")))
    pairs = (pairs.join(hots.select(F.col("key").alias("a"), F.col("hots").alias("ha")), "a", "left")
             .join(hots.select(F.col("key").alias("b"), F.col("hots").alias("hb")), "b", "left").fillna(0, ["ha", "hb"]))
    most = F.col("c") + F.least("ha", "hb") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    pairs = tables.keep(pairs.where(_can_link(most, F.col("na"), F.col("nb"), percent)).select("a", "b"), f"{name}-pairs")
    return pairs, hots


def _linked(percent: int):
    """Verify pairs: each row has both sets, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = batch.column("x")[i].values.to_numpy(), batch.column("y")[i].values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(percent: int):
    """Compare two blocks of sets; a row for each node and the least node it is linked with, over any number of links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, sizes, shingles = ([batch.column(f"{c}{s}")[i].values.to_numpy() for s in "xy"] for c in ("nodes", "sizes", "shingles"))
                owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
                order = [np.argsort(s, kind="stable") for s in shingles]
                x, y = (s[o] for s, o in zip(shingles, order))
                at, counts = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
                counts = counts - at
                both = np.zeros(len(nodes[0]) * len(nodes[1]), np.int64)
                ends = np.cumsum(counts)
                begin = 0
                while begin < len(x):       # about a million shared shingles at a time
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 1_000_000, "right")))
                    c = counts[begin:end]
                    inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(at[begin:end], c)
                    pair = np.repeat(owner[0][order[0][begin:end]], c) * len(nodes[1]) + owner[1][order[1][inner]]
                    both += np.bincount(pair, minlength=len(both))
                    begin = end
                both = both.reshape(len(nodes[0]), len(nodes[1]))
                p, q = np.nonzero(100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))
                names, place = np.unique(np.concatenate([nodes[0][p], nodes[1][q]]), return_inverse=True)
                a, b = place[:len(p)], place[len(p):]
                label, last = np.arange(len(names)), None
                while last is None or (label != last).any():
                    last = label.copy()
                    low = np.minimum(label[a], label[b])
                    np.minimum.at(label, a, low)
                    np.minimum.at(label, b, low)
                    label = label[label]
                own = label != np.arange(len(names))
                yield pa.record_batch({"a": pa.array(names[own]), "b": pa.array(names[label[own]])})

    return run


def _dense_links(heavy: DataFrame, posts: DataFrame, hots: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """Links among the nodes of ``heavy`` (node, n, shingles), by clusters and blocks."""
    from pyspark.sql import Window

    need = hots.withColumn("need", _first(F.col("n"), percent) - (F.col("n") - F.col("hots"))).where("need > 0").select("key", "need")
    place = F.row_number().over(Window.partitionBy("key").orderBy("h"))
    keys = (posts.where("hot").join(need, "key").withColumn("place", place).where(F.col("place") <= F.col("need")).select("h", "key"))
    keys = tables.keep(keys, "dense-keys")
    # shingles and nodes are both vertices; a shingle stands for its least node
    star = keys.join(keys.groupBy("h").agg(F.min("key").alias("m")), "h").select(F.col("key").alias("a"), F.col("m").alias("b"))
    clusters = tables.keep(components(star, tables, "dense"), "dense-clusters")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    members = heavy.join(clusters, "node").withColumn("band", band)
    sizes = members.groupBy("root", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.repartition("root", "band", "block")     # not by cluster: one may be large
    blocks = tables.keep(members.groupBy("root", "band", "block").agg(F.collect_list(F.struct("node", "n", "shingles")).alias("rows"))
                         .select("root", "band", "block", F.col("rows.node").alias("nodes"), F.col("rows.n").alias("sizes"),
                                 F.flatten("rows.shingles").alias("shingles")), "dense-blocks")
    names = blocks.select("root", "band", "block")
    other = names.select("root", F.col("band").alias("band2"), F.col("block").alias("block2"))
    pairs = names.join(other, "root").where(
        F.col("band2").between(F.col("band"), F.col("band") + 1) & ((F.col("band2") > F.col("band")) | (F.col("block2") >= F.col("block"))))
    left = blocks.select("root", "band", "block", *(F.col(c).alias(f"{c}x") for c in ("nodes", "sizes", "shingles")))
    right = blocks.select("root", F.col("band").alias("band2"), F.col("block").alias("block2"),
                          *(F.col(c).alias(f"{c}y") for c in ("nodes", "sizes", "shingles")))
    both = pairs.join(left, ["root", "band", "block"]).join(right, ["root", "band2", "block2"])
    return both.select(*(f"{c}{s}" for c in ("nodes", "sizes", "shingles") for s in "xy")).mapInArrow(_block_links(percent), "a long, b long")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk (check of the text), n_shingles, component_id, root.

    After A-Z became a-z, words are runs of other than ASCII white space, and a
    text's set are its distinct shingles of ``words`` words; a text of fewer words
    is one shingle.  Two texts link if 100 * |intersection| >= percent * |union|.
    component_id is the least id that links lead to; root tells components apart,
    also those of one least id, and is null for rows without shingles or id.

    Null texts and texts without words have no shingles and are linked with
    nothing, as are rows without id (component_id null).  Rows of one id are nodes
    of their own texts.  Other columns are not looked at.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_check(text).alias("tk"))
    every = tables.keep(source.mapInArrow(_described(words, False), "doc_id long, tk int, node long, key long, n int, r int"), "docs")
    live = source.where("doc_id is not null and text is not null")
    nodes = every.where("doc_id is not null and n > 0").groupBy("node", "key", "n", "r").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = tables.keep(nodes, "nodes")

    rows = live.select("text").mapInArrow(_described(words, True), "h long, key long, n int, r int, bit long")
    pairs, hots = _tier(rows, tables, "range", percent)
    few = (nodes.join(hots.select("key", "hots"), "key", "left")
           .where(F.col("r") - F.coalesce("hots", F.lit(0)) < _first(F.col("n"), percent)).select("node", "n"))
    few = tables.keep(few, "few")
    expand = nodes.select("key", "node")
    inside = expand.join(nodes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key", "left_semi")
    inside = inside.join(few, "node", "left_anti")
    inside = inside.select("key", F.col("node").alias("a")).join(inside.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    pairs = (pairs.join(expand.select(F.col("key").alias("a"), F.col("node").alias("x")), "a")
             .join(expand.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    pairs = tables.keep(pairs.union(inside), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(few.select("node")).distinct()
    wanted = nodes.join(wanted, "node", "left_semi").select("doc_id").distinct()
    sets = live.join(wanted.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(_set_rows(words), "node long, shingles array<long>")
    sets = tables.keep(sets, "sets")
    heavy = tables.keep(sets.join(few, "node").dropDuplicates(["node"]), "heavy")

    rows = heavy.select(F.explode("shingles").alias("h"), F.col("node").alias("key"), "n", F.col("n").alias("r"),
                        F.expr("shiftleft(1L, int(pmod(node, 64L)))").alias("bit"))
    again, hots = _tier(rows, tables, "whole", percent)
    dense = _dense_links(heavy, spark.read.schema("h long, key long, n int, r int, hot boolean").parquet(f"{tables.root}/whole-posts"),
                         hots, tables, percent)
    dense = tables.keep(dense, "dense-links")

    pairs = pairs.union(again).distinct()
    x, y = sets.withColumnsRenamed({"node": "a", "shingles": "x"}), sets.withColumnsRenamed({"node": "b", "shingles": "y"})
    links = tables.keep(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")
                        .mapInArrow(_linked(percent), "a long, b long"), "links")
    roots = components(links.union(dense), tables, "components")
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = tables.keep(roots.join(least, "root").select("node", "component_id", "root"), "named")
    known = tables.keep(nodes.join(named, "node", "left").select(
        "node", "copies", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "node").alias("root")), "known")
    # nodes of very many equal texts come back by broadcast
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    found = lookup_by_frequency(every.where(linked).select("doc_id", "tk", "n", "node"), known, ["node"], "copies").drop("node")
    rest = every.where(~linked).select("doc_id", "tk", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return found.union(rest).select("doc_id", "tk", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
