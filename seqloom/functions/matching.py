"""Approximate matching of nucleotide patterns and barcodes, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import text_bytes
from .sequence import STANDS_FOR

SCAN = 14


def _mismatches() -> np.ndarray:
    """table[a, b]: 1 unless a and b are equal bases or one is a base that the other stands for.

    Two codes that stand for several bases never match, equal or not.
    """
    table = np.ones((256, 256), np.int16)
    for code, bases in STANDS_FOR.items():
        for base in bases:
            for x in (code, code.lower()):
                for y in (base, base.lower()):
                    table[ord(x), ord(y)] = table[ord(y), ord(x)] = 0
    return table


MISMATCH = _mismatches()
PLAIN = 1 - np.eye(256, dtype=np.int16)


class Texts:
    """The letters of many reads, seen by position from either end."""

    def __init__(self, column: pa.Array) -> None:
        self.flat, self.at = text_bytes(column)
        self.n = np.diff(self.at)

    def at_offset(self, offset: np.ndarray, k: int) -> np.ndarray:
        """Letter k of the window that starts at offset in each read; 0 where there is none."""
        pos = offset + k
        there = (pos >= 0) & (pos < self.n)
        if not len(self.flat):
            return np.zeros(len(self.n), np.uint8)
        return np.where(there, self.flat[np.minimum(self.at[:-1] + np.maximum(pos, 0), len(self.flat) - 1)], 0)

    def hits(self, offset: np.ndarray, pattern: bytes, errors: int, table: np.ndarray, solid: float) -> np.ndarray:
        wrong, known = np.zeros(len(self.n), np.int16), np.zeros(len(self.n), np.int16)
        for k, letter in enumerate(pattern):
            here = self.at_offset(offset, k)
            wrong += table[letter][here]
            known += (here != 78) & (here != 110) & (here != 0)
        return (wrong <= errors) & (known >= max(1, int(solid * len(pattern)))) & (offset >= 0) & (offset + len(pattern) <= self.n)


def _search(texts: Texts, pattern: bytes, errors: int, offsets: Iterable[np.ndarray], table: np.ndarray, solid: float) -> np.ndarray:
    found = np.full(len(texts.n), -1, np.int64)
    for offset in offsets:
        open_ = found < 0
        if not open_.any():
            break
        hit = open_ & texts.hits(offset, pattern, errors, table, solid)
        found[hit] = offset[hit]
    return found


def _by_pattern(seq: pa.Array, pattern: pa.Array, run) -> pa.Array:
    """run(reads, pattern) for the reads of each different pattern; null where read or pattern is null or empty."""
    out, done = np.zeros(len(seq), np.int32), np.zeros(len(seq), bool)
    names = np.array([p or "" for p in pattern.to_pylist()], object)
    for name in set(names) - {""}:
        rows = np.flatnonzero((names == name) & ~np.asarray(seq.is_null()))
        out[rows] = run(Texts(seq.take(pa.array(rows))), name.upper().encode())
        done[rows] = True
    return pa.array(out, mask=~done)


def match_forward(seq: Column, pattern: Column, errors: int = 0, within: int = 20, plain: bool = False, part: float = 0) -> Column:
    """First start of the pattern (0-based, below `within`, or if `part` is given below that part of the read) with at most
    `errors` mismatches; -1 without a match.

    At least half of the window (rounded down) must not be N. plain: letters match only themselves.
    """

    @F.arrow_udf("int")
    def kernel(s: pa.Array, p: pa.Array) -> pa.Array:
        def run(t: Texts, x: bytes) -> np.ndarray:
            ends = np.floor(t.n * part).astype(np.int64) if part else np.full(len(t.n), within)
            offsets = (np.where(k < ends, k, -1) for k in range(int(ends.max(initial=0))))
            return _search(t, x, errors, offsets, PLAIN if plain else MISMATCH, 0 if plain else 0.5)

        return _by_pattern(s, p, run)

    return kernel(seq, pattern)


def match_reverse(seq: Column, pattern: Column, errors: int = 0, part: float = 0.25) -> Column:
    """Last start of the pattern in the last `part` of the read; -1 without a match. At least 90 % of the window (rounded down) must not be N."""

    @F.arrow_udf("int")
    def kernel(s: pa.Array, p: pa.Array) -> pa.Array:
        def run(t: Texts, x: bytes) -> np.ndarray:
            low = np.ceil(t.n * (1 - part)).astype(np.int64)
            steps = int((t.n - low - len(x)).max(initial=-1)) + 1
            offsets = [np.where(t.n - len(x) - k >= low, t.n - len(x) - k, -1) for k in range(steps)]
            return _search(t, x, errors, offsets, MISMATCH, 0.9)

        return _by_pattern(s, p, run)

    return kernel(seq, pattern)


class BarcodeIndex:
    """Barcodes of one length, sorted, with the number of their sample."""

    def __init__(self, barcodes: list[tuple[str, int]]) -> None:
        width = max((len(b) for b, _ in barcodes), default=1)
        kept = sorted((b.encode(), i) for b, i in barcodes if len(b) == width)
        self.width = width
        self.codes = np.array([b for b, _ in kept], f"S{width}")
        self.samples = np.array([i for _, i in kept], np.int64)
        self.letters = self.codes.view(np.uint8).reshape(len(kept), width) if kept else np.zeros((0, width), np.uint8)

    def window(self, t: Texts, k: int, rows: np.ndarray) -> np.ndarray:
        return np.stack([t.at_offset(np.full(len(t.n), k), j)[rows] for j in range(self.width)], 1) if len(rows) else np.zeros((0, self.width), np.uint8)


def by_length(barcodes: list[tuple[str, int]]) -> list[BarcodeIndex]:
    """An index for each length, longest first."""
    return [BarcodeIndex([x for x in barcodes if len(x[0]) == n]) for n in sorted({len(b) for b, _ in barcodes} - {0}, reverse=True)]


def find_barcode(seq: Column, barcodes: list[tuple[str, int]], scan: int = SCAN, errors: int = 0) -> Column:
    """struct(sample_idx, start, mismatches, candidates) of the barcode in a read.

    The exact barcode of least start wins, a longer one before a shorter one. Without one, if errors are allowed, all barcodes with at most that many
    mismatches at any start are candidates: one sample is taken (least start), several leave sample_idx null.
    `barcodes` are the samples of a map, sent along with the function; larger maps go through barcode_join.
    """
    indexes = by_length(barcodes)

    @F.arrow_udf("sample_idx int, start int, mismatches int, candidates int")
    def kernel(s: pa.Array) -> pa.Array:
        t = Texts(s)
        n = len(t.n)
        sample, start = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        wrong, candidates = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for index in indexes:
            for k in range(scan):
                rows = np.flatnonzero((sample < 0) & (t.n >= k + index.width))
                if len(rows):
                    code = np.ascontiguousarray(index.window(t, k, rows)).view(f"S{index.width}").ravel()
                    at = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
                    hit = index.codes[at] == code
                    sample[rows[hit]], start[rows[hit]] = index.samples[at[hit]], k
        candidates[sample >= 0] = 1
        if errors and indexes:
            open_ = np.flatnonzero(sample < 0)
            best: dict[int, dict[int, tuple[int, int]]] = {}
            for k, index in product(range(scan), indexes):
                rows = open_[t.n[open_] >= k + index.width]
                codes, back = np.unique(index.window(t, k, rows), axis=0, return_inverse=True)
                if not len(codes):
                    continue
                far = (codes[:, None, :] != index.letters[None]).sum(2)
                near = [np.flatnonzero(f <= errors) for f in far]
                for row, c in zip(rows, back.ravel(), strict=True):
                    for b in near[c]:
                        best.setdefault(row, {}).setdefault(int(index.samples[b]), (k, int(far[c, b])))
            for row, found in best.items():
                candidates[row] = len(found)
                if len(found) == 1:
                    ((sample[row], (start[row], wrong[row])),) = found.items()
        none = sample < 0
        columns = [pa.array(sample.astype(np.int32), mask=none), pa.array(start.astype(np.int32), mask=none), pa.array(wrong.astype(np.int32), mask=none), pa.array(candidates.astype(np.int32))]
        return pa.StructArray.from_arrays(columns, ["sample_idx", "start", "mismatches", "candidates"])

    return kernel(seq)
