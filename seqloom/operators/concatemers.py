"""Long reads that hold several amplicons one after another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import MISMATCH
from ..functions.sequence import revcomp_text

REACH = 6000
PIECES = "array<struct<start: int, stop: int>>"


def _starts(read: np.ndarray, pattern: bytes, errors: int) -> np.ndarray:
    if len(read) < len(pattern):
        return np.zeros(0, np.int64)
    wrong = np.zeros(len(read) - len(pattern) + 1, np.int16)
    for k, letter in enumerate(pattern):
        wrong += MISMATCH[letter][read[k : k + len(wrong)]]
    return np.flatnonzero(wrong <= errors)


def _pieces(text: str, forward: bytes, reverse: bytes, errors: int, reach: int) -> list[dict]:
    read = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    starts, ends = _starts(read, forward, errors), _starts(read, reverse, errors)
    out, at = [], 0
    while True:
        s = starts[np.searchsorted(starts, at) :]
        if not len(s):
            return out
        begin = int(s[0]) + len(forward)
        e = ends[np.searchsorted(ends, begin) :]
        if not len(e) or e[0] - begin > reach:
            at = begin
            continue
        out.append({"start": begin, "stop": int(e[0])})
        at = int(e[0]) + len(reverse)


def found(seq: Column, forward: Column, reverse: Column, errors: int = 1, reach: int = REACH) -> Column:
    """Array of (start, stop): the inserts between a forward primer and the next reverse complement of the reverse
    primer at most `reach` bases on. Null reads or primers give an empty array."""

    @F.arrow_udf(PIECES)
    def kernel(s: pa.Array, f: pa.Array, r: pa.Array) -> pa.Array:
        rows = [_pieces(a.upper(), b.encode(), revcomp_text(c).encode(), errors, reach) if a and b and c else [] for a, b, c in zip(s.to_pylist(), f.to_pylist(), r.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))

    return kernel(seq, forward, reverse)


def split(reads: DataFrame, seq: str, read_id: str, forward: str, reverse: str, errors: int = 1, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """One row for each amplicon of reads with `least` to `most` of them: amplicon_id (read id and _1, _2 ...), insert, number, n_amplicons."""
    cut = reads.withColumn("_p", found(F.col(seq), F.col(forward), F.col(reverse), errors)).withColumn("n_amplicons", F.size("_p"))
    kept = cut.filter(F.col("n_amplicons").between(least, most)).select("*", F.posexplode("_p").alias("_k", "_q"))
    insert = F.substr(seq, F.col("_q.start") + 1, F.col("_q.stop") - F.col("_q.start"))
    return kept.select("*", insert.alias("insert"), (F.col("_k") + 1).alias("number"), F.concat_ws("_", read_id, (F.col("_k") + 1).cast("string")).alias("amplicon_id")).drop("_p", "_k", "_q")


def statistics(reads: DataFrame, seq: str, forward: str, reverse: str, groups: list[str], errors: int = 1) -> DataFrame:
    """groups, n_amplicons, n_reads, n_bases: reads by how many amplicons they hold."""
    cut = reads.withColumn("_p", found(F.col(seq), F.col(forward), F.col(reverse), errors))
    bases = F.aggregate("_p", F.lit(0), lambda a, x: a + x["stop"] - x["start"])
    return cut.groupBy(*groups, F.size("_p").alias("n_amplicons")).agg(F.count("*").alias("n_reads"), F.sum(bases).alias("n_bases"))
