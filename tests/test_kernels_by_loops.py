"""The per-read kernels against plain loops, on random reads."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.functions import matching
from seqloom.functions.quality import Scores
from seqloom.functions.sequence import STANDS_FOR


def reads(n=3000, seed=8):
    r = random.Random(seed)
    return [[r.choice((2, 11, 20, 20, 25, 37, r.randint(0, 41))) for _ in range(r.choice((0, 1, 2, 14, 15, 16, 30, 31, 60, r.randint(0, 150))))] for _ in range(n)]


ROWS = reads()


@pytest.fixture(scope="module")
def scores():
    return Scores(pa.array(["".join(chr(q + 33) for q in x) for x in ROWS]), pa.array([33] * len(ROWS), pa.int32()))


def trimmed(q, width, threshold):
    """From the end to the left while windows are under the threshold."""
    n, need = len(q), int(width * threshold)
    if threshold == 0 or width >= n or sum(q[n - width :]) > need:
        return n
    low, last = max(n >> 2, width), n - width
    edge = min(low + 1, last)
    for at in range(last - 1, low, -1):
        if sum(q[at : at + width]) >= need:
            edge = at + 1
            break
    return max(0, edge - (width >> 1))


@pytest.mark.parametrize(("width", "threshold"), [(15, 20), (10, 25), (1, 20), (15, 0)])
def test_trimmed(scores, width, threshold):
    assert scores.trimmed(width, threshold, scores.n).tolist() == [trimmed(q, width, threshold) for q in ROWS]


def test_last_window_at_the_threshold():
    """A last window that only reaches the threshold is cut."""
    q = [2] * 40 + [20] * 15
    s = Scores(pa.array(["".join(chr(x + 33) for x in q)]), pa.array([33], pa.int32()))
    assert s.trimmed(15, 20, s.n)[0] == trimmed(q, 15, 20) < 55


def test_sums(scores):
    error = lambda q: 10 ** (-q / 10)

    def budget(q, most):
        total = 0.0
        for k, x in enumerate(q):
            total += error(x)
            if total >= most:
                return k
        return len(q)

    assert np.allclose(scores.accumulated_error(), [sum(map(error, q)) for q in ROWS])
    assert np.allclose(scores.mean(scores.n), [sum(q) / len(q) if q else 0 for q in ROWS])
    assert scores.median().tolist() == [sorted(q)[len(q) // 2] if q else 0 for q in ROWS]
    assert scores.budget(1.0, scores.n).tolist() == [budget(q, 1.0) for q in ROWS]
    assert scores.window_poor(10, 20, scores.n).tolist() == [any(sum(q[i : i + 10]) < 200 for i in range(1, len(q) - 9)) for q in ROWS]


def test_expected_errors(scores):
    def bound(q, most, alpha):
        if len(q) < 3:
            return 0.0
        law = [1.0] + [0.0] * (most + 2)
        for x in q:
            p = 10 ** (-x / 10)
            law = [law[0] * (1 - p)] + [law[j] * (1 - p) + law[j - 1] * p for j in range(1, most + 3)]
        before = 0.0
        for j, x in enumerate(law):
            if before + x > 1 - alpha or j == len(law) - 1:
                return 0.0 if j == 0 else max(0.0, j - 1 + (1 - alpha - before) / (x if x > 0 else 1))
            before += x

    assert np.allclose(scores.expected_errors(2, 0.005, scores.n), [bound(q, 2, 0.005) for q in ROWS])


def matches(read, pattern, errors, starts, share):
    for at in starts:
        window = read[at : at + len(pattern)]
        if at < 0 or len(window) < len(pattern) or sum(c != "N" for c in window) < max(1, int(share * len(pattern))):
            continue
        if sum(not (a == b and len(STANDS_FOR[a]) == 1 or (len(STANDS_FOR[a]) == 1) != (len(STANDS_FOR[b]) == 1) and (a in STANDS_FOR[b] or b in STANDS_FOR[a])) for a, b in zip(window, pattern, strict=True)) <= errors:
            return at
    return -1


@pytest.mark.parametrize("pattern", ["GTGYCAGCMGCCGCGGT", "ACGTA", "NACG"])
def test_patterns(spark, pattern):
    """Forward from the start, reverse in the last quarter; shares of known letters are rounded down."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    texts = ["".join(r.choice("ACGTN" if r.random() < 0.3 else "ACGT") for _ in range(r.randint(0, 90))) for _ in range(600)]
    plain = lambda: "".join(r.choice("ACGTNN" if r.random() < 0.2 else STANDS_FOR[c]) for c in pattern)
    texts += [t[:5] + plain() + t[5:] + plain() for t in texts[:400]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = df.select("i", matching.match_forward(F.col("s"), F.lit(pattern), 2, 22).alias("f"), matching.match_reverse(F.col("s"), F.lit(pattern), 2).alias("b")).orderBy("i").collect()
    for row, t in zip(got, texts, strict=True):
        n = len(t)
        assert row.f == matches(t, pattern, 2, range(22), 0.5), t
        assert row.b == matches(t, pattern, 2, range(n - len(pattern), -(-3 * n // 4) - 1, -1), 0.9), t
