"""The tier decision: first (green), second (yellow) or failed, with every reason.

The ladder is one Arrow kernel: each step is a whole-array operation on the reads that got
there, in fixed order, so later steps see the lengths that earlier ones left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import Scores, text_bytes
from .config import FilterConfig

REASONS = ("short", "long", "accumulated_error", "low_quality", "window", "binomial", "homopolymer", "ambiguous")
FLAGS = ("tail_trimmed", "window_trimmed", "error_trimmed")
STRUCT = "tier string, length int, mean_quality double, " + ", ".join(f"{x} boolean" for x in (*REASONS, *FLAGS))

PLAIN = np.zeros(256, bool)
PLAIN[list(b"ACGTacgt")] = True


def _runs(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each letter how long the run of equal letters is that ends with it."""
    index = np.arange(len(flat))
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[at[:-1][at[:-1] < len(flat)]] = True
    return index - np.maximum.accumulate(np.where(first, index, 0)) + 1


def graded(seq: Column, quality: Column, offset: Column, mate: Column, config: FilterConfig, second: Column | None = None) -> Column:
    """A struct of tier, effective length, mean quality, reasons and trim flags of a read.

    `second` marks reads that an earlier step (a primer found only with more errors) lets pass as second tier at most.
    A second-tier read fails where no second output is kept. Null texts are empty reads; null offsets count as 33.
    """
    c = config

    @F.arrow_udf(STRUCT)
    def kernel(text: pa.Array, scores: pa.Array, offsets: pa.Array, mates: pa.Array, seconds: pa.Array) -> pa.Array:
        flat, at = text_bytes(text)
        s = Scores(scores, offsets)
        n = np.minimum(np.diff(at), s.n)
        rows = len(n)
        yellow = np.asarray(seconds.fill_null(False).to_numpy(zero_copy_only=False), bool).copy()
        failed = np.zeros(rows, bool)
        why = {r: np.zeros(rows, bool) for r in (*REASONS, *FLAGS)}
        length = n.copy()

        def fail(reason: str, which: np.ndarray) -> None:
            why[reason] |= which & ~failed
            failed[which] = True

        def demote(reason: str, which: np.ndarray) -> None:
            why[reason] |= which & ~failed
            yellow[which & ~failed] = True

        runs = _runs(flat, at) if len(flat) else np.zeros(0, np.int64)
        last = runs[np.maximum(at[1:] - 1, 0)] if len(flat) else np.zeros(rows, np.int64)
        last = np.where(np.diff(at) > 0, last, 0)
        if c.trim_run:
            tail = (last >= c.trim_run) & (c.trim_run < length) & (n == np.diff(at))
            length = np.where(tail, np.maximum(1, length - last), length)
            why["tail_trimmed"] |= tail
        if c.truncate:
            length = np.minimum(length, c.truncate)

        short = length < c.min_length
        rescued = short & (length >= c.min_length_2) if c.min_length_2 is not None else np.zeros(rows, bool)
        fail("short", short & ~rescued)
        demote("short", rescued)
        fail("long", length > c.max_length)

        cut = s.trimmed(c.trim_width, c.trim_threshold, length)
        why["window_trimmed"] |= (cut < length) & ~failed
        length = np.where(failed, length, cut)

        if c.max_accumulated_error is not None:
            here = s.budget(c.max_accumulated_error, length)
            low = here < c.min_length
            if c.max_accumulated_error_2 is None:
                fail("accumulated_error", low)
            else:
                floor = c.min_length if c.min_length_2 is None else c.min_length_2
                fail("accumulated_error", low & (s.budget(c.max_accumulated_error_2, length) < floor))
                demote("accumulated_error", low)
            trim = ~low & ~failed & (here < length)
            why["error_trimmed"] |= trim
            length = np.where(trim, here, length)

        mean = s.mean(length)
        poor = s.window_poor(c.window_width, c.window_threshold, length) if c.window_threshold else np.zeros(rows, bool)
        low = np.where(poor, 0.0, mean) < c.min_quality
        if c.min_quality_2 is None and c.window_threshold_2 is None:
            fail("window", poor)
            fail("low_quality", low)
        else:
            loose = c.window_threshold if c.window_threshold_2 is None else c.window_threshold_2
            poor2 = s.window_poor(c.window_width, loose, length) if loose else np.zeros(rows, bool)
            least = c.min_quality if c.min_quality_2 is None else c.min_quality_2
            fail("window", poor & poor2)
            demote("window", poor)
            fail("low_quality", (low | poor) & (np.where(poor2, 0.0, mean) < least))
            demote("low_quality", low & ~poor)

        if c.alpha != -1:
            first = (mates.fill_null(1).to_numpy(zero_copy_only=False) == 1) | c.binomial_both
            fail("binomial", first & (s.expected_errors(int(c.max_expected_errors), c.alpha, length) > c.max_expected_errors))

        place = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
        owner = np.repeat(np.arange(rows), np.diff(at))
        inside = place < length[owner]
        fail("homopolymer", np.bincount(owner, inside & (runs >= c.max_run), rows) > 0)
        odd = np.bincount(owner, inside & ~PLAIN[flat], rows)
        many = odd > c.max_ambiguous
        if c.max_ambiguous_2 is not None:
            fail("ambiguous", many & (odd >= c.max_ambiguous_2))
        demote("ambiguous", many)

        tier = np.where(failed, "failed", np.where(yellow, "yellow" if c.second_output else "failed", "green"))
        columns = [pa.array(tier.astype(object), pa.string()), pa.array(length.astype(np.int32)), pa.array(mean)]
        return pa.StructArray.from_arrays([*columns, *(pa.array(why[r]) for r in why)], ["tier", "length", "mean_quality", *why])

    return kernel(seq, quality, offset, mate, F.lit(False) if second is None else second)


def with_tier(reads: DataFrame, config: FilterConfig) -> DataFrame:
    """reads (seq, quality, qual_offset, mate) with the columns of graded()."""
    made = graded(F.col("seq"), F.col("quality"), F.col("qual_offset"), F.col("mate"), config)
    return reads.withColumn("_g", made).select("*", "_g.*").drop("_g")
