"""Signature trees against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import near_duplicates as nd


def runs(s, k=8):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def pairs_by_hand(rows, threshold):
    rows = [(i, runs(s)) for i, s in rows if s is not None and len(s) >= 8]
    return {(min(i, j), max(i, j)) for a, (i, x) in enumerate(rows) for j, y in rows[a + 1 :] if len(x & y) >= threshold * len(x | y)}


def edited(r, s):
    s = list(s)
    for _ in range(r.randint(0, 7)):
        k = r.randrange(len(s))
        if r.random() < 0.5:
            s[k] = r.choice("ACGT")
        elif r.random() < 0.5:
            del s[k]
        else:
            s.insert(k, r.choice("ACGTN"))
    if r.random() < 0.2:
        k = r.randrange(len(s))
        s = s[k:] + s[:k]
    return "".join(s)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [None, "", "ACGTACG", "ACGTACGT", "ACGTACGT", "AAAAAAAAA", "AAAAAAAAAAAAAAA", "é" * 12, "é" * 20]
    for _ in range(60):
        base = "".join(r.choice("ACGT") for _ in range(r.randint(20, 300)))
        out += [base] + [edited(r, base) for _ in range(r.randint(0, 8))]
    out += ["ACGTTGCA" * 2000, "ACGTTGCA" * 2000 + "A", out[-1], out[-1]]
    return list(enumerate(out))


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs(spark, rows, threshold):
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "id bigint, s string, text string").repartition(5)
    got = {tuple(r) for r in nd.similar_rows(df, "id", "s", threshold).collect()}
    assert got == pairs_by_hand(rows, threshold)


def test_blocks(spark):
    """A bucket that is cut into many blocks loses nothing."""
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(200))
    rows = [(k, edited(r, base)) for k in range(120)]
    classes = nd.record_classes(spark.createDataFrame(rows, "id bigint, s string"), "id", "s")
    found = [{(x.a, x.b) for x in nd.similar_records(classes, 0.6, block=b).select("a", "b").collect()} for b in (7, 2048)]
    first = {}
    for i, s in rows:
        first.setdefault(s, i)
    want = pairs_by_hand([(i, s) for s, i in first.items()], 0.6)
    assert found[0] == found[1] == want


def test_classes(spark):
    rows = [(5, "ACGTACGTTT"), (2, "ACGTACGTTT"), (3, "ACGTACGTTTA"), (4, "GGGGGCCCCC"), (6, None), (7, "ACG")]
    got = {tuple(r) for r in nd.similar_classes(spark.createDataFrame(rows, "id bigint, s string"), "id", "s", 0.6).collect()}
    assert got == {(5, 2, 2, 1), (2, 2, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)}


def test_empty(spark):
    assert nd.similar_rows(spark.createDataFrame([], "id bigint, s string"), "id", "s", 0.6).count() == 0


def test_bound_is_never_too_low():
    """No pair over the threshold is pruned at any level, and most pairs of nodes are."""
    r = random.Random(4)
    texts = []
    for _ in range(40):
        base = "".join(r.choice("ACGT") for _ in range(r.randint(100, 260)))
        texts += [edited(r, base) for _ in range(r.randint(1, 12))]
    texts.sort(key=lambda x: len(set(runs(x))))
    t = nd.Tokens(*nd.packed(texts), 8)
    size, bit, none = t.sizes(), nd.bit_of(t.mixed()), np.zeros(len(texts), np.int64)
    assert size.tolist() == [len(runs(x)) for x in texts]
    forest = nd.Forest(none, size, size - t.sizes(bit), bit, t.at, none)
    got = {(min(a, b), max(a, b)) for i, j in forest.pairs(np.array([0]), np.array([0]), 0.6) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got >= pairs_by_hand(list(enumerate(texts)), 0.6)
    assert forest.kept[1] * 2 < forest.seen[1] and len(got) * 10 < len(texts) * (len(texts) - 1) // 2


def test_records_that_meet_elsewhere():
    """Pairs of one earlier root are left out, others aren't."""
    texts = ["ACGTTGCAACGGTTAC" * 3] * 12
    t = nd.Tokens(*nd.packed(texts), 8)
    none, met = np.zeros(12, np.int64), np.array([0] * 3 + [4] * 6 + [5] * 3)
    forest = nd.Forest(none, t.sizes(), none, nd.bit_of(t.mixed()), t.at, met)
    got = {(min(a, b), max(a, b)) for i, j in forest.pairs(np.array([0]), np.array([0]), 0.6) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(a, b) for a in range(12) for b in range(a + 1, 12) if not met[a] or met[a] != met[b]}


def test_packing():
    r = random.Random(5)
    texts = ["".join(r.choice("ACGTRYMKWSBDHVN") for _ in range(n)) for n in (8, 9, 30, 0, 11)] + ["ACGT" * 9]
    for part in (texts, [*texts, "é" * 12, "acgtacgtac"]):
        letters, body, other = nd.packed(part)
        assert [nd.unpacked(int(n), body[0][body[1][i] : body[1][i + 1]], other[0][other[1][i] : other[1][i + 1]]) for i, n in enumerate(letters)] == part
        t = nd.Tokens(letters, body, other, 8)
        assert t.sizes().tolist() == [len(runs(x)) for x in part]
    # a run has one number in whatever text it stands
    assert set(nd.tokens_of("ACGTACGTNé").tolist()) >= set(nd.tokens_of("ACGTACGTN").tolist())


def test_common_stretch():
    """Texts with as many letters in common as reach() says have a root in common, wherever they stand."""
    r = random.Random(6)
    letters, _ = nd.reach(0.6)
    for _ in range(200):
        common = "".join(r.choice("ACGT") for _ in range(letters))
        two = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 90))) + common + "".join(r.choice("ACGT") for _ in range(r.randint(0, 90))) for _ in range(2)]
        row, key = nd.stretches(two, 15, letters)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_shared():
    """Small roots give pairs, large ones members, in batches of any size."""
    rows = [(1, 5), (2, 3), (2, 9), *[(3, k) for k in range(30)], (4, 1), (5, 7), (5, 8), *[(6, k) for k in range(9)], *[(7, k) for k in range(8)]]
    for size in (1, 2, 7, 9, 100):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        out = [x for b in nd._shared(iter([pa.RecordBatch.from_arrays([pa.array([x[0] for x in p], pa.int64()), pa.array([x[1] for x in p], pa.int64())], ["key", "rep"]) for p in parts])) for x in b.to_pylist()]
        assert sorted((x["key"], x["a"]) for x in out if x["b"] is None) == sorted((k, v) for k, v in rows if k in (3, 6))
        assert sorted((x["a"], x["b"]) for x in out if x["b"] is not None) == sorted([(3, 9), (7, 8), *[(a, b) for b in range(8) for a in range(b)]])


def test_periodic_texts(spark):
    """Roots that a text has many times count once; nothing pairs with itself."""
    rows = [(k, unit * 400 + end) for k, (unit, end) in enumerate((u, e) for u in ("ACGTTGCA", "AAC", "G") for e in ("", "T", "TT", "CC"))]
    got = [tuple(r) for r in nd.similar_rows(spark.createDataFrame(rows, "id bigint, s string"), "id", "s", 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_by_hand(rows, 0.6)


def test_many_copies(spark):
    """Members of a class in several blocks: all pairs, once."""
    rows = [(k, "ACGTTGCAACGGTTACCATG") for k in range(2300)] + [(5000, "ACGTTGCAACGGTTACCATGA")]
    got = nd.similar_rows(spark.createDataFrame(rows, "id bigint, s string"), "id", "s", 0.8)
    assert got.count() == got.distinct().count() == 2301 * 2300 // 2
