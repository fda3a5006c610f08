"""Sums of arrays over all rows of a table of numbers: one array per task is shuffled."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)


def pack(rows: DataFrame) -> DataFrame:
    """The same numbers as one row per batch, dealt out evenly: scans that come again and again read arrays instead of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"_n": pa.array([batch.num_rows], pa.int32()), "_block": pa.array([matrix(batch).tobytes()], pa.binary())})

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "_n int, _block binary")


def matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The rows of a batch, or those of each packed batch in it."""
    if batch.schema.names == ["_n", "_block"]:
        for n, block in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(block.as_buffer()).reshape(n.as_py(), -1)
    elif batch.num_rows:
        yield matrix(batch)


#: Numbers that all tasks of a scan may send to the driver; more are added up in a shuffle before.
_DIRECT = 1 << 22


def summed(rows: DataFrame, step: Callable[[np.ndarray], np.ndarray], width: int, *, tasks: int | None = None) -> np.ndarray:
    """Sum of an array of ``width`` numbers that ``step`` makes of the rows of a batch; ``rows`` may be packed.

    ``tasks``, if known, is the number of tasks that read ``rows``: a few short arrays are added up by the driver, without a shuffle.
    """
    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(width)
        for batch in batches:
            for x in matrices(batch):
                total += step(x)
        return total

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"s": pa.array([added(batches)], pa.list_(pa.float64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"at": pa.array(np.arange(width, dtype=np.int32)), "s": pa.array(added(batches))})

    out = np.zeros(width)
    if tasks is not None and tasks * width <= _DIRECT:
        for r in rows.mapInArrow(whole, "s array<double>").collect():
            out += r["s"]
        return out
    for r in rows.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out


@contextlib.contextmanager
def held(packed: DataFrame) -> Iterator[RDD]:
    """Blocks of stored packed rows, kept by the executors meanwhile: a scan then costs little more than its tasks.

    Blocks that do not fit in memory go to the executors' disks, those of a lost executor are read again from the table.
    """
    blocks = packed.rdd.map(lambda r: (r["_n"], bytes(r["_block"]))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield blocks
    finally:
        blocks.unpersist()


def summed_blocks(blocks: RDD, step: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """:func:`summed` of blocks that are :func:`held`; many long arrays are added up in a shuffle before."""
    def added(parts: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
        total = np.zeros(width)
        for n, block in parts:
            total += step(np.frombuffer(block).reshape(n, -1))
        yield total

    arrays = blocks.mapPartitions(added)
    if blocks.getNumPartitions() * width <= _DIRECT:
        return sum(arrays.collect(), np.zeros(width))
    return arrays.treeReduce(np.add)
