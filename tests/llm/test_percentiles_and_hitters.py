import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import heavy_hitters as hh
from seqloom.llm import percentiles as pc


def rank(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 9))) - 1]


@pytest.fixture(scope="module")
def values():
    r = random.Random(1)
    return [(r.choice(["hot"] * 5 + ["a", None]), r.choice([None, float("nan"), r.gauss(0, 9), 4.0, -1e9]), r.randint(0, 3)) for _ in range(4000)]


def test_percentiles(spark, values):
    df = spark.createDataFrame(values, "g string, v double, value int").repartition(9)  # value clashes
    got = {(r.g, r.probability): (r.n_values, r.value) for r in pc.percentiles(pc.frequencies(df, ["g"], F.col("v")), ["g"], (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    for g in {x[0] for x in values}:
        own = [v for h, v, _ in values if h == g and v is not None and not math.isnan(v)]
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert got.pop((g, p)) == (len(own), rank(own, p))
    assert not got


def test_parts_and_bounded_error(spark, values):
    df = spark.createDataFrame(values, "g string, v double, d int")
    whole = pc.percentiles(pc.frequencies(df, ["g"], F.col("v")), ["g"])
    parts = pc.merged(pc.frequencies(df, ["g", "d"], F.col("v")), ["g"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, pc.percentiles(parts, ["g"]).collect()))
    near = pc.percentiles(pc.frequencies(df, ["g"], F.col("v"), 0.5), ["g"], resolution=0.5)
    exact = {(r.g, r.probability): r.value for r in whole.collect()}
    for r in near.collect():
        assert r.error_bound == 0.25 and abs(r.value - exact[r.g, r.probability]) <= 0.25 + 1e-9


def test_scores(spark):
    rows = [("a", "II5", 33, "x"), ("a", None, 33, "x"), ("a", "", 33, "x"), (None, "h", 64, "y"), ("a", "h", 64, "y"), ("b", "I", None, "y"), ("c", "é!", 33, "z"), ("a", "I" * 100_000, 33, "x")]
    df = spark.createDataFrame(rows, "g string, quality string, qual_offset int, n string")
    want = Counter()
    for g, q, o, _ in rows:
        for c in q or "":
            if o is not None:
                want[g, float(ord(c) - o)] += 1
    assert {(r.g, r.value): r.n for r in pc.score_frequencies(df, ["g"]).collect()} == dict(want)
    assert pc.percentiles(pc.score_frequencies(df.limit(0), ["g"]), ["g"]).count() == 0


def test_sketch_is_never_too_low():
    r = np.random.default_rng(2)
    sketch, exact = hh.CountMin(1 << 8, 3), Counter()
    for _ in range(40):
        found, n = np.unique(r.zipf(1.3, 500).astype(np.uint64), return_counts=True)
        estimates = sketch.add(found, n)
        exact.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
        assert all(e >= exact[h] for h, e in zip(found.tolist(), estimates.tolist(), strict=True))
    assert sketch.rows == sum(exact.values())


def test_most_frequent(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot"] * 30 + [f"v{k}" for k in range(10)] + [f"rare{r.random()}"] + [None, ""]), 1) for _ in range(6000)] + [("x" * 100_000, 2)] * 40
    df = spark.createDataFrame(rows, "s string, h int").repartition(8)
    want = sorted(((-n, v) for v, n in Counter(v for v, _ in rows if v).items()))[:8]
    for width in (1 << 18, 1 << 6):
        got = hh.most_frequent(df, F.nullif("s", F.lit("")), "s", 8, width).collect()
        assert [(-x.n_rows, x.s) for x in got] == want
        assert all(x.n_rows <= x.approx_count for x in got)
    assert hh.most_frequent(df.limit(0), F.col("s"), "s", 8).count() == 0


def test_ties(spark):
    df = spark.createDataFrame([(s,) for s in "edcba"], "s string")
    assert [r.s for r in hh.most_frequent(df, F.col("s"), "s", 3).collect()] == ["a", "b", "c"]


def test_widened_until_sure(spark):
    """Few candidates for many values of nearly one count: they are widened until nothing else can have more rows."""
    rows = [(f"v{k}",) for k in range(300) for _ in range(5 + (k % 50 == 0))]
    df = spark.createDataFrame(rows, "s string").repartition(3)
    got = hh.most_frequent(df, F.col("s"), "s", 6, heap=8).collect()
    assert [(r.s, r.n_rows) for r in got] == [(s, 6) for s in sorted(f"v{k}" for k in range(0, 300, 50))]
    assert all(r.guaranteed and r.approx_count >= r.n_rows for r in got)
