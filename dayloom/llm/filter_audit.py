"""How filters interact: what each of them removes under every order of applying them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Tables

LETTERS = "ABCDE"
#: Under so many words A fails; B, C: percent of different words at least, of capitals at most.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
WORD_GAP, CAPITAL, SYMBOL = r"[\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < LEAST_WORDS,
        "B": different * 100 < n * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit(CAPITAL)) * 100 > F.char_length(text) * CAPITAL_PERCENT,
        "D": text.rlike(SYMBOL),
    }
    return sum((F.when(fail, _BIT[letter]).otherwise(0) for letter, fail in fails.items()), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the set of filters they fail, and how many of them are labelled.

    Texts are read once, into rows of a part, an id, a mask and 128 bits of hash.
    The least id of each text comes from a pre-aggregated minimum; it is looked up
    by (text, id), so a text that a third of all rows share is dealt out by id.
    """
    tables = Tables(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).cast("long").alias("doc_id"),
                       whole.alias("text"))
    rows = tables.keep(rows.select("part", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                                   text_failures(F.col("text")).alias("mask")), "rows")
    first = (rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("is_first", F.lit(True)))
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                           F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    judged = rows.join(first, ["h1", "h2", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return judged.groupBy("part", (F.col("mask") + F.when(copy, _BIT["E"]).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _orders() -> Column:
    """All orders as strings of filter letters: a constant array that goes with the plan to every task."""
    return F.split(F.lit(" ".join("".join(p) for p in permutations(LETTERS))), " ")


def _steps(order: Column) -> Column:
    """What each step of an order does to the rows of a cell (columns mask, n, good, toxic): one struct of ``COUNTS`` per step."""
    zero = F.lit(0).cast("long")
    count = lambda when, of="n": F.when(when, F.col(of)).otherwise(zero)

    def apply(state: Column, letter: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(LETTERS[0]))
        fails, here = F.col("mask").bitwiseAND(bit) != 0, state["alive"]
        step = F.struct(
            count(here & ~fails).alias("kept"), count(here & fails).alias("removed"), count(~here & fails).alias("redundant"),
            count(F.col("mask") == bit).alias("unique_fails"), count(here & fails, "good").alias("good_lost"),
            count(here & fails, "toxic").alias("toxic_lost"))
        return F.struct((here & ~fails).alias("alive"), F.concat(state["steps"], F.array(step)).alias("steps"))

    empty = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), empty.alias("steps"))
    return F.aggregate(F.split(order, ""), start, apply, lambda s: s["steps"])


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTS)))


def _removed_by(letter: str) -> Column:
    """Rows that a filter removes, over all steps."""
    steps = F.filter("steps", lambda s, i: F.substr(F.element_at(_orders(), (i / len(LETTERS)).cast("int") + 1), i % len(LETTERS) + 1, F.lit(1)) == letter)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda sum, s: sum + s["removed"])


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and counts of that step: one row for each part, order of the five filters and step.

    A fails texts of few words, B those of few different words, C those of many
    capitals, D those with a symbol, E those whose text a row with a smaller id
    has, removed or not.  Of the rows of the part, ``kept`` are left after the
    step, ``removed`` go in it, ``redundant`` fail its filter but went earlier,
    ``unique_fails`` fail its filter only, ``good_lost`` and ``toxic_lost`` are
    the removed ones labelled quality 1 and toxic 1, ``shapley`` is what its
    filter removes, at any step, over all orders.

    Rows are counted by part and set of failed filters first: at most 32 cells a
    part, however many rows it has.  Each cell folds its set along each of the
    120 orders; the 600 structs of the cells of a part are added elementwise.

    A null part counts as the part '', null texts are empty, rows without id are
    never copies.  Rows of one id and text are not copies of each other, and each
    of them has the labels of the id; of several labels of an id a 1 counts.
    Empty tables give no rows.  Further columns are not looked at.
    """
    tables = Tables(docs.sparkSession)
    cells = tables.keep(failure_cells(docs, labels, doc_id, text, part), "cells")
    folded = cells.select("part", F.flatten(F.transform(_orders(), _steps)).alias("steps"))
    # the cells of a part are at most 32
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), F.size(_orders()) * len(LETTERS))
    parts = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.aggregate("cells", zero, _added).alias("steps"))
    totals = {f"all_{x}": _removed_by(x) for x in LETTERS}
    rows = parts.withColumns(totals).select("part", *totals, F.posexplode("steps").alias("at", "done"))
    rows = rows.withColumns({"filter_order": F.element_at(_orders(), (F.col("at") / len(LETTERS)).cast("int") + 1),
                             "step": (F.col("at") % len(LETTERS) + 1).cast("int")})
    letter = F.substr(F.col("filter_order"), F.col("step"), F.lit(1))
    shapley = F.coalesce(*(F.when(letter == x, F.col(f"all_{x}")) for x in LETTERS))
    return rows.select("part", "filter_order", "step", *(F.col(f"done.{c}") for c in COUNTS), shapley.alias("shapley"))
