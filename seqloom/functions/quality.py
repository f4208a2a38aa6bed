"""Quality kernels over Arrow batches.

The scores of a batch are one flat array with row bounds, and every measure comes from prefix
sums over it: no padding, so one long read costs its own length only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: error probability by score; one in ten million from 70 on
FLAT_FROM, FLAT = 70, 1e-7


def error_of(q: np.ndarray) -> np.ndarray:
    return np.where(q >= FLAT_FROM, FLAT, 10.0 ** (-np.clip(q, 0, FLAT_FROM) / 10.0))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


class Scores:
    """Scores of many reads: flat values, row bounds and prefix sums."""

    def __init__(self, quality: pa.Array, offset: pa.Array) -> None:
        flat, self.at = text_bytes(quality)
        self.n = np.diff(self.at)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        off = offset.fill_null(33).to_numpy(zero_copy_only=False).astype(np.int64)
        self.q = flat.astype(np.int64) - off[self.row]
        self.start = self.at[:-1]
        self.sums = np.concatenate(([0], np.cumsum(self.q)))
        self.place = np.arange(len(self.q)) - self.start[self.row]

    def total(self, length: np.ndarray) -> np.ndarray:
        return self.sums[self.start + length] - self.sums[self.start]

    def mean(self, length: np.ndarray) -> np.ndarray:
        return np.where(length > 0, self.total(length) / np.maximum(length, 1), 0.0)

    def median(self) -> np.ndarray:
        """The upper median of all scores; 0 for an empty read."""
        if not len(self.q):
            return np.zeros(len(self.n), np.int64)
        low, span = int(self.q.min()), int(self.q.max() - self.q.min()) + 1
        small = np.int32 if len(self.n) * span < 1 << 31 else np.int64
        both = np.sort(self.row.astype(small) * small(span) + (self.q - low).astype(small))  # one number for row and score
        at = np.minimum(self.start + self.n // 2, len(self.q) - 1)
        return np.where(self.n > 0, both[at] % span + low, 0)

    def accumulated_error(self) -> np.ndarray:
        p = np.where(self.q >= 0, error_of(self.q), 0.0)
        return np.bincount(self.row, p, len(self.n))

    def budget(self, most: float, length: np.ndarray) -> np.ndarray:
        """The first position at which the errors so far reach `most`, or the length."""
        p = error_of(np.maximum(self.q, 0))
        sums = np.concatenate(([0.0], np.cumsum(p)))
        reached = (sums[1:] - sums[self.start][self.row] >= most) & (self.place < length[self.row])
        hits = np.concatenate(([0], np.cumsum(reached)))
        first = np.flatnonzero(reached)
        k = hits[self.start]
        some = hits[self.start + self.n] > k
        pos = (first[np.minimum(k, max(0, len(first) - 1))] if len(first) else np.zeros(len(k), np.int64)) - self.start
        return np.where(some, pos, length)

    def windows(self, width: int) -> np.ndarray:
        """Sum of the window from each position on, where it fits into the flat array."""
        out = np.zeros(len(self.q), np.int64)
        if len(self.q) >= width:
            out[: len(self.q) - width + 1] = self.sums[width:] - self.sums[: len(self.sums) - width]
        return out

    def trimmed(self, width: int, threshold: float, length: np.ndarray) -> np.ndarray:
        """Length after cutting a poor 3' end.

        If the last window isn't over the threshold, the cut goes left to the last window that reaches it, but not into the first
        quarter or window; half a window is given up with it.
        """
        if threshold == 0 or width <= 0 or not len(self.q):
            return length
        need = int(width * threshold)
        low = np.maximum(length >> 2, width)
        last = length - width
        good = (self.windows(width) >= need) & (self.place > low[self.row]) & (self.place < last[self.row])
        seen = np.maximum.accumulate(np.where(good, np.arange(len(self.q)), -1))
        at = seen[np.minimum(self.start + np.maximum(last, 0), len(self.q) - 1)]
        edge = np.where(at >= self.start, at - self.start + 1, np.minimum(low + 1, last))
        final = self.sums[self.start + length] - self.sums[self.start + np.maximum(last, 0)]
        noop = (width >= length) | (final > need)
        return np.where(noop, length, np.maximum(0, edge - width // 2))

    def window_poor(self, width: int, threshold: float, length: np.ndarray) -> np.ndarray:
        """Whether a window but the first falls under the threshold."""
        if width <= 0 or not len(self.q):
            return np.zeros(len(length), bool)
        bad = (self.windows(width) < int(threshold) * width) & (self.place >= 1) & (self.place <= (length - width)[self.row])
        return np.bincount(self.row, bad, len(length)) > 0

    def expected_errors(self, most: int, alpha: float, length: np.ndarray) -> np.ndarray:
        """Upper bound of errors at level alpha by the Poisson-binomial law, interpolated between counts; 0 if alpha is -1.

        Scores out of 0..109 are sure errors. Reads under three bases have none.
        """
        out, states = np.zeros(len(length)), most + 3
        if alpha == -1:
            return out
        p = np.where((self.q < 0) | (self.q > 109), 1.0, error_of(np.clip(self.q, 0, 109)))
        order = np.argsort(-length, kind="stable")
        law = np.zeros((len(length), states))
        law[:, 0] = 1
        for k in range(int(length.max(initial=0))):
            rows = order[: np.searchsorted(-length[order], -k, side="left")]  # those longer than k
            pk = p[self.start[rows] + k][:, None]
            now = law[rows]
            law[rows] = now * (1 - pk) + np.concatenate((np.zeros((len(rows), 1)), now[:, :-1]), 1) * pk
        level, before = 1 - alpha, np.zeros(len(length))
        done = length < 3
        for j in range(states):
            after = before + law[:, j]
            stop = ~done & ((after > level) | (j == states - 1))
            step = after - before
            out = np.where(stop, 0 if j == 0 else np.maximum(0, j - 1 + (level - before) / np.where(step > 0, step, 1)), out)
            done |= stop
            before = after
        return out


MEASURES = {"average": "double", "median": "int", "accumulated_error": "double", "budget_position": "int", "trimmed_length": "int", "window_poor": "boolean", "expected_errors": "double"}


def measures(quality: Column, offset: Column, only: tuple[str, ...] = (), width: int = 15, threshold: float = 20, budget: float = 1.0, look: int = 50, floor: float = 25, most: int = 2, alpha: float = 0.005) -> Column:
    """A struct of measures of a read (of MEASURES those named in `only`, or all), in one pass over its scores."""
    names = only or tuple(MEASURES)

    @F.arrow_udf(", ".join(f"{n} {MEASURES[n]}" for n in names))
    def kernel(q: pa.Array, o: pa.Array) -> pa.Array:
        s = Scores(q, o)
        n = s.n
        make = {
            "average": lambda: pa.array(s.mean(n)),
            "median": lambda: pa.array(s.median().astype(np.int32)),
            "accumulated_error": lambda: pa.array(s.accumulated_error()),
            "budget_position": lambda: pa.array(s.budget(budget, n).astype(np.int32)),
            "trimmed_length": lambda: pa.array(s.trimmed(width, threshold, n).astype(np.int32)),
            "window_poor": lambda: pa.array(s.window_poor(look, floor, n)),
            "expected_errors": lambda: pa.array(s.expected_errors(most, alpha, n)),
        }
        return pa.StructArray.from_arrays([make[x]() for x in names], list(names))

    return kernel(quality, offset)


def rebased(quality: Column, offset: Column, to: int = 33) -> Column:
    """The quality text with another offset; what would fall out of 33..126 is set to the edge, scores under 0 to 0."""

    @F.arrow_udf("string")
    def kernel(q: pa.Array, o: pa.Array) -> pa.Array:
        flat, at = text_bytes(q)
        row = np.repeat(np.arange(len(q)), np.diff(at))
        off = o.fill_null(33).to_numpy(zero_copy_only=False).astype(np.int64)
        moved = np.clip(np.maximum(flat.astype(np.int64) - off[row], 0) + to, max(33, to), 126).astype(np.uint8)
        made = pa.Array.from_buffers(pa.large_string(), len(q), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(moved.tobytes())])
        return pa.compute.if_else(q.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())

    return kernel(quality, offset)


def merged_score(first: Column, second: Column, agree: Column) -> Column:
    """Score of a base that two mates read: likelier right where they agree; at most 40."""
    p, q = F.pow(F.lit(10.0), -first / 10), F.pow(F.lit(10.0), -second / 10)
    low, high = F.least(p, q), F.greatest(p, q)
    both = p * q / 3 / (1 - p - q + 4 * p * q / 3)
    either = low * (1 - high / 3) / (p + q - 4 * p * q / 3)
    return F.least(F.lit(40), F.round(-10 * F.log10(F.when(agree, both).otherwise(either)))).cast("int")
