"""Most frequent items in bounded memory: one count-min sketch for each hash partition.

The value stream is reduced to 64-bit hashes in the JVM; each Arrow batch is combined to
(hash, rows) before it is shuffled, so a value with a third of all rows leaves one row a
batch. Hash partitions are disjoint: a partition's sketch sees all rows of its values and the
partitions' heaps of heavy candidates are merged by putting them together. Candidates are
then counted exactly in a second scan, which shuffles nothing but them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

WIDTH = 1 << 18
DEPTH = 4
HEAP = 1024
#: Candidates to which they may be widened.
MOST = 1 << 19
WIDEST = 1 << 21


class CountMin:
    """Count-min sketch with conservative update, over arrays of distinct 64-bit hashes.

    An update raises each of a value's cells to no more than estimate + rows. In one call several
    values may share a cell, which then takes the greatest of their needs, so every cell of x
    always holds at least the rows of x: estimates are never too low. They are too high by more
    than e / width of all rows with a probability of at most exp(-depth).
    """

    def __init__(self, width: int = WIDTH, depth: int = DEPTH) -> None:
        if width & (width - 1):
            raise ValueError("the width must be a power of two")
        self.cells = np.zeros((depth, width), np.int64)
        self.odd = np.random.default_rng(7).integers(1, 2**63, depth, np.uint64) | np.uint64(1)
        self.shift = np.uint64(64 - width.bit_length() + 1)
        self.rows = 0

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Add rows of distinct hashes; the new estimates."""
        mixed = hashes ^ (hashes >> np.uint64(29))
        at = [(mixed * a) >> self.shift for a in self.odd]
        wanted = np.min([c[i] for c, i in zip(self.cells, at, strict=True)], axis=0) + rows
        for c, i in zip(self.cells, at, strict=True):
            np.maximum.at(c, i, wanted)
        self.rows += int(rows.sum())
        return wanted

    def error(self) -> int:
        return int(np.ceil(np.e / self.cells.shape[1] * self.rows))


class Heap:
    """The candidates with the greatest estimates; at most twice `size` are held."""

    def __init__(self, size: int = HEAP) -> None:
        self.size, self.hashes, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.floor = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        new = counts > self.floor
        if not new.any():
            return
        hashes = np.concatenate((hashes[new], self.hashes))
        counts = np.concatenate((counts[new], self.counts))
        order = np.lexsort((hashes, -counts))  # the latest estimate of a hash is its greatest
        _, first = np.unique(hashes[order], return_index=True)
        keep = order[np.sort(first)][: self.size]
        self.hashes, self.counts = hashes[keep], counts[keep]
        if len(keep) == self.size:
            self.floor = int(self.counts[-1]) - 1  # ties with the last may still enter


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows = np.unique(batch.column(0).to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(rows.astype(np.int64))], ["h", "n"])


def heavy_candidates(df: DataFrame, value: Column, width: int = WIDTH, depth: int = DEPTH, heap: int = HEAP) -> DataFrame:
    """h (the value's hash), approx_count, error_bound: the heaviest candidates of every hash partition.

    Null values are left out. At most heap rows a partition; the sketch takes 8 * width * depth bytes of a task.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, top = CountMin(width, depth), Heap(heap)
        for batch in batches:
            hashes, at = np.unique(batch.column(0).to_numpy().view(np.uint64), return_inverse=True)
            rows = np.zeros(len(hashes), np.int64)
            np.add.at(rows, at, batch.column(1).to_numpy())
            top.add(hashes, seen.add(hashes, rows))
        error = pa.array(np.full(len(top.hashes), seen.error(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(top.hashes.view(np.int64)), pa.array(top.counts), error], ["h", "approx_count", "error_bound"])

    stream = df.select(value.alias("v")).filter(F.col("v").isNotNull()).select(F.xxhash64("v").alias("h"))
    parts = stream.mapInArrow(_combine, "h bigint, n bigint").repartition("h")
    return parts.mapInArrow(sketch, "h bigint, approx_count bigint, error_bound bigint")


def counted(df: DataFrame, value: Column, out: str, k: int, width: int, depth: int, heap: int) -> DataFrame:
    """The k most frequent of at most `heap` candidates, with `guaranteed`: no value that isn't a candidate can have more rows.

    The candidates are broadcast (16 bytes each) to the second scan. Estimates are never too low, so a value that was
    left out has at most as many rows as the least estimate of a full set of candidates.
    """
    best = heavy_candidates(df, value, width, depth, heap).orderBy(F.desc("approx_count"), "h").limit(heap)
    cut = best.agg(F.when(F.count("*") >= heap, F.min("approx_count")).otherwise(0)).scalar()
    named = df.select(value.alias(out)).filter(F.col(out).isNotNull()).withColumn("h", F.xxhash64(out))
    exact = named.join(F.broadcast(best.select("h")), "h", "left_semi").groupBy("h", out).agg(F.count("*").alias("n_rows"))
    top = exact.join(F.broadcast(best), "h").orderBy(F.desc("n_rows"), out).limit(k)
    return top.select(out, "approx_count", "error_bound", "n_rows", (F.col("n_rows") >= cut).alias("guaranteed"))


def most_frequent(df: DataFrame, value: Column, out: str, k: int, width: int = WIDTH, depth: int = DEPTH, heap: int = HEAP) -> DataFrame:
    """The k most frequent values: `out`, approx_count, error_bound, n_rows (the exact rows) and guaranteed; ties by value.

    Runs when called, as the k rows tell whether the candidates were enough: if not, it runs again with eight times as
    many in a sketch eight times as wide, up to MOST of them; beyond that, rows that aren't sure say so. Null values are left
    out, an empty table gives no rows.
    """
    while True:
        found = written(counted(df, value, out, k, width, depth, heap))
        if heap >= MOST or found.filter(~F.col("guaranteed")).isEmpty():
            return found.orderBy(F.desc("n_rows"), out)
        width, heap = min(width * 8, WIDEST), heap * 8
