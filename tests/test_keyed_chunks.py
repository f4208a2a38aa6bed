"""Chunked per-key results against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.keyed_chunks import chunked, key_states, number_rows, positioned, positioned_any, process_chunks


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(k, r.choice(["hot"] * 6 + ["a", "b", "", None]), r.choice([None, 1, 2, 3])) for k in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "x.parquet")
    spark.createDataFrame(rows, "i bigint, k string, v bigint").coalesce(1).sortWithinPartitions("i").write.parquet(path)
    return positioned(spark.read.parquet(path), "i", "k", "v")


def test_numbers(table, rows):
    got = {r.i: r._number for r in number_rows(table, "k").collect()}
    seen = {}
    for i, k, _ in rows:
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_chunks_are_equal(table):
    sizes = chunked(table, "k", 100).groupBy("k", "_chunk").count().collect()
    last = {}
    for r in sizes:
        last[r.k] = max(last.get(r.k, 0), r._chunk)
    assert all(r["count"] == 100 for r in sizes if r._chunk < last[r.k])


@pytest.mark.parametrize("chunk", [1, 7, 100, 10**6])
def test_states(table, rows, chunk):
    got = {r.k: r for r in key_states(table, "k", "v", chunk).collect()}
    for k, group in itertools.groupby(sorted(rows, key=lambda x: (x[1] is None, x[1] or "", x[0])), key=lambda x: x[1]):
        values = [x[2] for x in group]
        there = [v for v in values if v is not None]
        r = got.pop(k)
        assert (r.n_rows, r.n_values, r.total, r.least, r.most) == (len(values), len(there), sum(there) if there else None, min(there, default=None), max(there, default=None))
        assert (r.first_value, r.last_value) == (values[0], values[-1])
        assert r.n_changes == sum(a != b for a, b in itertools.pairwise(values))
    assert not got


def test_empty(spark):
    t = positioned_any(spark.createDataFrame([], "k string, v bigint"), "k", "v")
    assert key_states(t, "k", "v").count() == 0


def test_process(table, rows):
    got = process_chunks(table, "k", lambda p: p[["k"]].head(1).assign(n=len(p)), "k string, n bigint", 500).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: sum(x[1] == k for x in rows) for k in {x[1] for x in rows}}
