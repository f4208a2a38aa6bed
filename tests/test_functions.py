"""Functions against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import matching, sequence
from seqloom.functions.quality import Scores, error_of
from seqloom.operators import samples as sample_ops
from seqloom.operators.config import FilterConfig
from seqloom.operators.pipeline import demultiplexed
from seqloom.operators.prefix import running_sum


def scores(reads):
    return Scores(pa.array(["".join(chr(33 + q) for q in r) for r in reads]), pa.array([33] * len(reads), pa.int32()))


@pytest.fixture(scope="module")
def reads():
    r = random.Random(3)
    return [[], [5], [40] * 15, [40] * 16] + [[r.choice([2, 12, 25, 37]) for _ in range(r.randint(0, 120))] for _ in range(400)]


def trimmed(q, width, threshold):
    n, need = len(q), int(width * threshold)
    if threshold == 0 or width >= n or sum(q[n - width :]) > need:
        return n
    low = max(n >> 2, width)
    good = [i for i in range(low + 1, n - width) if sum(q[i : i + width]) >= need]
    return max(0, (max(good) + 1 if good else min(low + 1, n - width)) - width // 2)


def test_trimmed(reads):
    s = scores(reads)
    for width, threshold in ((15, 20), (4, 25), (50, 12)):
        assert s.trimmed(width, threshold, s.n).tolist() == [trimmed(q, width, threshold) for q in reads]


def test_budget_and_error(reads):
    s = scores(reads)
    p = [[float(error_of(np.array([x]))[0]) for x in q] for q in reads]
    assert np.allclose(s.accumulated_error(), [sum(x) for x in p])
    for most in (0.01, 0.7, 3):
        want = [next((i for i in range(len(x)) if sum(x[: i + 1]) >= most), len(x)) for x in p]
        assert s.budget(most, s.n).tolist() == want


def test_windows_and_median(reads):
    s = scores(reads)
    assert s.window_poor(10, 20, s.n).tolist() == [any(sum(q[i : i + 10]) < 200 for i in range(1, len(q) - 9)) for q in reads]
    assert s.median().tolist() == [sorted(q)[len(q) // 2] if q else 0 for q in reads]


def expected(p, most, alpha):
    law = [1.0] + [0.0] * (most + 2)
    for x in p:
        law = [law[0] * (1 - x)] + [law[j] * (1 - x) + law[j - 1] * x for j in range(1, most + 3)]
    before = 0.0
    for j, x in enumerate(law):
        if before + x > 1 - alpha or j == most + 2:
            return 0.0 if j == 0 else max(0.0, j - 1 + (1 - alpha - before) / (x or 1))
        before += x
    return 0.0


def test_expected_errors(reads):
    s = scores(reads)
    want = [0.0 if len(q) < 3 else expected([float(error_of(np.array([x]))[0]) for x in q], 2, 0.005) for q in reads]
    assert np.allclose(s.expected_errors(2, 0.005, s.n), want)
    assert not s.expected_errors(2, -1, s.n).any()


def test_revcomp_twice(spark):
    df = spark.createDataFrame([("ACGTRYMKWSBDHVN",), ("",), (None,), ("acgt",)], "s string")
    got = [r[0] for r in df.select(sequence.revcomp(sequence.revcomp(F.col("s")))).collect()]
    assert got == ["ACGTRYMKWSBDHVN", "", None, "ACGT"]


def test_matching(spark):
    df = spark.createDataFrame([("TTACGTAA", "ACR"), ("TTACATAA", "ACR"), ("TTTTTTTT", "ACG"), ("NNNNNNNN", "ACG"), (None, "ACG"), ("ACG", None), ("", "A"), ("AC", "ACG")], "s string, p string")
    assert [r[0] for r in df.select(matching.match_forward(F.col("s"), F.col("p"), 0, 9)).collect()] == [2, 2, -1, -1, None, None, -1, -1]
    assert [r[0] for r in df.select(matching.match_reverse(F.col("s"), F.col("p"), 0, 1.0)).collect()] == [2, 2, -1, -1, None, None, -1, -1]


def test_barcodes(spark):
    df = spark.createDataFrame([("AAAACCCC",), ("TAAAACCC",), ("AAATGGGG",), ("AATTCCCC",), ("",), (None,)], "s string")
    found = matching.find_barcode(F.col("s"), [("AAAA", 0), ("AATT", 1)], 3, 1)
    assert [tuple(r[0]) for r in df.select(found).collect()] == [(0, 0, 0, 1), (0, 1, 0, 1), (None, None, None, 2), (1, 0, 0, 1), (None, None, None, 0), (None, None, None, 0)]


def test_running_sum(spark):
    rows = [(k % 3 if k % 10 else None, k, k % 7 if k % 11 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v bigint").repartition(7)
    got = {(r.g, r.o): r.s for r in running_sum(df, ["g"], ["o"], "v", "s").collect()}
    sums = {}
    for g, o, v in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        assert got[g, o] == sums[g]
    assert running_sum(df.limit(0), ["g"], ["o"], "v", "s").count() == 0


def test_barcodes_of_two_lengths(spark):
    kinds = "sample_idx int, sample_id string, barcode_sequence string, forward_primer string, reverse_primer string, sample_id_in_head string, fastq_file string, sequencing_run string, barcode2nd_pair string"
    codes = ["AAAACCCC", "GGGGTTTT", "AAAAC", "CTCTC"]
    samples = spark.createDataFrame([(i, f"S{i}", b, None, None, None, None, None, None) for i, b in enumerate(codes)], kinds)
    body = "TGATGATGATGATGATGATG"
    texts = ["AAAACCCC" + body, "AAAAC" + body, "TCTCTC" + body, "TGTGTG" + body, "GGGATTTT" + body, "CTCTG" + body, "CTC", "", None]
    reads = spark.createDataFrame([(k, s, s and "I" * len(s), 33, 1) for k, s in enumerate(texts)], "k int, s string, quality string, qual_offset int, mate int")
    exact = {0: (0, 0), 1: (2, 0), 2: (3, 1)}
    none = dict.fromkeys(range(len(texts)), (None, None))
    got = {r.k: (r.sample_idx, r.start) for r in sample_ops.by_barcode(reads, samples, "s", 3).collect()}
    assert got == none | exact
    joined = {r.k: (r.sample_idx, r.start) for r in sample_ops.barcode_join(reads, samples, "s", "k", 3).collect()}
    assert joined == got
    fuzzy = {r.k: (r.sample_idx, r.mismatches) for r in sample_ops.by_barcode(reads, samples, "s", 1, 1).collect()}
    assert fuzzy == none | {0: (0, 0), 1: (2, 0), 4: (1, 1), 5: (3, 1)}
    graded = demultiplexed(reads.withColumnRenamed("s", "seq"), samples, FilterConfig(min_length=5, trim_threshold=0)).collect()
    assert {r.k: (r.sample_id, r.seq, len(r.quality)) for r in graded if r.sample_id} == {k: (f"S{i}", body, len(body)) for k, i in ((0, 0), (1, 2), (2, 3))}
    assert [(r.problem, r.value, r.n) for r in sample_ops.map_problems(samples).collect()] == [("barcode length", "5", 2)]
    assert sample_ops.strand_votes(reads, samples, "s").first().forward == 3


def test_too_many_header_tokens(spark, monkeypatch):
    monkeypatch.setattr(sample_ops, "MAP_ROWS", 2)
    reads = spark.createDataFrame([("@c_1",)], "header string")
    samples = spark.createDataFrame([(0, "a_"), (1, "b_"), (2, "c_")], "sample_idx int, sample_id_in_head string")
    assert sample_ops.by_header(reads, samples.filter("sample_idx > 0")).first().sample_idx == 2
    with pytest.raises(ValueError, match="over 2"):
        sample_ops.by_header(reads, samples)
