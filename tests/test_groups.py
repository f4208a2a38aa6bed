"""Pairs, dereplication, representatives, clusters and concatemers on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequence import revcomp_text
from seqloom.operators import clusters, concatemers, derep, pairs
from seqloom.operators.config import FilterConfig
from seqloom.operators.keyed_chunks import positioned
from seqloom.operators.pipeline import seed_config
from seqloom.operators.representatives import DEREP, Tournament, representatives
from seqloom.plans import group_queries


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def pair_frame(spark, rows):
    kind = "struct<seq: string, quality: string, qual_offset: int>"
    return spark.createDataFrame(rows, f"pair_id string, r1 {kind}, r2 {kind}")


@pytest.mark.parametrize("size", [100, 900])
def test_merge(spark, size):
    r, rows, want = random.Random(1), [], {}
    mate = lambda s: (s, "I" * len(s), 33)
    for k, overlap in enumerate([0, 5, 11, 12, 13, 40, size - 1, size]):
        whole = dna(r, 2 * size - overlap)
        rows.append((str(k), mate(whole[:size]), mate(revcomp_text(whole[-size:]))))
        want[str(k)] = (whole, overlap) if overlap >= 12 else None
    insert = dna(r, size - 30)  # the insert is shorter than the reads
    rows.append(("dovetail", mate(insert + dna(r, 30)), mate(revcomp_text(dna(r, 30) + insert))))
    want["dovetail"] = (insert, size - 30)
    rows += [("short", mate("ACGT"), mate("ACGT")), ("empty", mate(""), mate("")), ("null", (None, None, None), mate("ACGT"))]
    want |= {"short": None, "empty": None, "null": None}
    got = {x.pair_id: x.merge and (x.merge.seq, x.merge.overlap) for x in pairs.merge_pairs(pair_frame(spark, rows)).collect()}
    assert got == want


def test_merge_takes_the_better_base(spark):
    r = random.Random(2)
    whole = dna(r, 100)
    first, second = list(whole[:70]), list(whole[30:])
    first[50] = "A" if whole[50] != "A" else "C"  # wrong and poor
    second[30] = "N"
    q1 = ["I"] * 70
    q1[50] = "#"
    rows = [("a", ("".join(first), "".join(q1), 33), (revcomp_text("".join(second)), "I" * 70, 33))]
    got = pairs.merge_pairs(pair_frame(spark, rows)).first().merge
    assert got.seq == whole and got.mismatches == 2 and len(got.quality) == 100
    assert got.quality[0] == "I" and got.quality[45] == chr(33 + 40)


def brute_overlap(x, y):
    """(size, mismatches) of the longest good overlap of a read with its turned mate, by all shifts; None without one."""
    best = None
    for d in range(-len(y), len(x)):
        over = [(x[i], y[i - d]) for i in range(max(0, d), min(len(x), d + len(y)))]
        wrong = sum(a != b for a, b in over)
        if len(over) >= 12 and wrong <= len(over) // 10 and wrong / len(over) < 0.1 and (best is None or len(over) > best[0]):
            best = len(over), wrong
    return best if min(len(x), len(y)) >= 20 else None


def write_reads(spark, path, rows):
    kinds = "read_ord bigint, file_name string, seq_run string, sample_id string, mate int, header string, read_id string, sequence string, quality string, qual_offset int"
    spark.createDataFrame(rows, kinds).write.parquet(str(path / "fastx_records.parquet"))


def test_statistics_of_all_pairs(spark, tmp_path):
    r, rows, want = random.Random(5), [], {}
    for k in range(60):
        sample = [None, "s0", "s1"][k % 3]
        whole = dna(r, r.choice([15, 40, 80, 110, 145, 155, 200]))
        first, second = whole[:80], list(whole[-80:])
        for at in r.sample(range(len(second)), min(len(second), r.choice([0, 0, 1, 4, 12]))):
            second[at] = r.choice("ACGT")
        second = "".join(second)
        for mate, text in ((1, first), (2, revcomp_text(second))):
            rows.append((len(rows), "f", "run", sample if mate == 1 or k % 2 else None, mate, f"@p{k}/{mate}", f"p{k}/{mate}", text, "I" * len(text), 33))
        want.setdefault(sample, []).append(brute_overlap(first, second))
    rows.append((len(rows), "f", "run", "s0", 1, "@alone/1", "alone/1", dna(r, 50), "I" * 50, 33))  # no pair
    write_reads(spark, tmp_path, rows)
    got = {x.sample_id: x for x in group_queries.merge_statistics_pairs(spark, str(tmp_path)).collect()}
    assert set(got) == {None, "s0", "s1"}
    for sample, found in want.items():
        good = [f for f in found if f]
        assert 0 < len(good) < len(found) and any(f[1] for f in good)
        assert (got[sample].n_pairs, got[sample].n_merged) == (len(found), len(good))
        assert got[sample].mean_overlap == pytest.approx(sum(f[0] for f in good) / len(good))
        assert got[sample].mean_mismatches == pytest.approx(sum(f[1] for f in good) / len(good))


def test_consensus_of_all_reads(spark, tmp_path):
    r = random.Random(6)
    texts = [dna(r, n) for n in (10, 19, 20, 79, 80, 81, 100, 148, 149, 160, 161, 300)] + ["A" * 100, dna(r, 50) + "N" + dna(r, 50), dna(r, 40) + "A" * 60, "N" + dna(r, 60)]
    write_reads(spark, tmp_path, [(k, "f", "run", "s", 1, f"@r{k}", f"r{k}", t, "I" * len(t), 33) for k, t in enumerate(texts)])
    got = {x.read_ord: x for x in group_queries.merge_consensus_all(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        found = brute_overlap(text[:80], text[-80:])
        whole = text.strip("N") if found and (found[0] == 160 - len(text) or found[0] == len(text)) else None
        if found is None or "N" in text.strip("N"):
            assert got[k].seq is None and got[k].overlap is None and got[k].merge_length is None
        else:
            assert (got[k].overlap, got[k].mismatches) == found
            assert whole is None or (got[k].seq, got[k].merge_length) == (whole, len(whole))
    assert [k for k in got if got[k].seq is None] and got[12].overlap == 80  # a run takes a longer overlap than its own


def test_routes(spark):
    kind = "struct<tier: string>"
    rows = [("a", ("green",), ("green",)), ("b", ("green",), ("yellow",)), ("c", ("yellow",), ("failed",)), ("d", None, ("green",)), ("e", ("failed",), None)]
    got = {tuple(r) for r in pairs.routed(spark.createDataFrame(rows, f"pair_id string, r1 {kind}, r2 {kind}")).collect()}
    assert got == {("a", 1, "green", "pair1"), ("a", 2, "green", "pair2"), ("b", 1, "green", "single1"), ("b", 2, "yellow", "single2"), ("c", 1, "yellow", "single1"), ("d", 2, "green", "single2")}


def test_order_rule_and_min_copies(spark):
    rows = [(1, "A", "s0", "yellow"), (2, "A", "s0", "green"), (3, "A", "s1", "failed"), (4, "B", "s0", "yellow"), (5, "A", None, "green"), (6, "C", "s1", "green")]
    reads = spark.createDataFrame(rows, "read_ord int, seq string, sample_id string, tier string").repartition(3)
    occ = derep.occurrences(derep.opened(derep.keyed(reads), ["key"]), ["key"])
    assert {tuple(r) for r in occ.collect()} == {("A", "s0", 1), ("A", "s1", 1), ("C", "s1", 1)}
    assert derep.parse_min_copies("10:1,3:3") == [10, None, 3]
    t = spark.createDataFrame([(10, 1), (9, 2), (3, 3), (2, 3), (9, 1)], "total int, n int")
    got = [r[0] for r in t.select(derep.enough_copies("10:1,3:3", F.col("total"), F.col("n"))).collect()]
    assert got == [True, False, True, False, False]
    assert derep.dereplicated(occ.limit(0), ["key"]).count() == 0


def test_mean_quality(spark):
    reads = spark.createDataFrame([("k", "I5", 33), ("k", "5", 33), ("k", "", 33), (None, "I", 33)], "key string, quality string, qual_offset int").repartition(3)
    assert {tuple(r) for r in derep.mean_quality(reads, "key").collect()} == {("k", 0, 30), ("k", 1, 20), (None, 0, 40)}


def feature(r, i):
    return {"odd": r.choice([0, 0, 3]), "error": r.random() * 3, "quality": 20 + r.random() * 20, "length": r.choice([80, 100, 120]), "identity": None, "merge_length": r.choice([None, 150, 160]), "size": r.randint(1, 9)}


@pytest.mark.parametrize("chunk", [10**6, 5])
def test_representatives(spark, tmp_path, chunk):
    r = random.Random(3)
    rows = [{"i": i, "k": r.choice(["hot"] * 4 + ["a", None]), **feature(r, i)} for i in range(300)]
    kinds = "i int, k string, odd int, error double, quality double, length int, identity double, merge_length int, size int"
    spark.createDataFrame([tuple(x.values()) for x in rows], kinds).coalesce(1).sortWithinPartitions("i").write.parquet(str(tmp_path / "x"))
    table = positioned(spark.read.parquet(str(tmp_path / "x")), *rows[0])
    got = {x.k: x.i for x in representatives(table, "k", ["i"], chunk_rows=chunk).collect()}
    for key in {x["k"] for x in rows}:
        own = [x for x in rows if x["k"] == key]
        rounds = [own[n : n + chunk] for n in range(0, len(own), chunk)]
        best = []
        for part in rounds:
            fold = Tournament(DEREP, False)
            for x in part:
                fold.meets(x)
            best.append(fold.best)
        final = Tournament(DEREP, False)
        for x in best:
            final.meets(x)
        assert got[key] == final.best["i"]


def test_chimeras_and_matrix(spark):
    a = clusters.targets(spark.createDataFrame([(0, "r1", "o1"), (1, "r2", "o1+o2;size=3;")], "line_no int, query string, target string"))
    occ = spark.createDataFrame([("r1", "s0", 4), ("r2", "s0", 3), ("r2", "s1", 2)], "query string, sample_id string, n int")
    long = clusters.counts(a, occ)
    assert {tuple(r) for r in long.collect()} == {("o1", "s0", 5.5), ("o2", "s0", 1.5), ("o1", "s1", 1.0), ("o2", "s1", 1.0)}
    assert {tuple(r) for r in clusters.matrix(long, ["s0", "s1", "s2"]).collect()} == {("o1", 6, 1, 0), ("o2", 2, 1, 0)}


def test_matrix_of_all_samples(spark, tmp_path):
    rows = [(k, f"derep_RUN{k % 5:03d}.fa", f"r{k}") for k in range(25)]
    spark.createDataFrame(rows, "rec_ord bigint, file_name string, read_id string").write.parquet(str(tmp_path / "fasta_records.parquet"))
    got = group_queries.otu_matrix(spark, str(tmp_path))
    assert got.columns == ["otu", *(f"derep_RUN{k:03d}" for k in range(5))]
    want = {}  # each record is one read; every seventh line is no hit
    for k, f, _ in rows:
        if k % 7:
            want.setdefault(f"r{k % 5}", {})[f[:-3]] = want.get(f"r{k % 5}", {}).get(f[:-3], 0) + 1
    assert {r.otu: {c: r[c] for c in got.columns[1:] if r[c]} for r in got.collect()} == want
    assert clusters.sample_names(group_queries._otu_counts(spark, str(tmp_path))) == got.columns[1:]


def test_concatemers(spark):
    r = random.Random(4)
    fwd, rev = "GTGCMGCCGCGG", "GGACTACNVGGG"
    plain, back = "GTGCAGCCGCGG", revcomp_text("GGACTACAAGGG")
    inserts = [dna(r, 50) for _ in range(3)]
    text = "ACGTAC".join(plain + x + back for x in inserts)
    df = spark.createDataFrame([("x", text, fwd, rev), ("none", dna(r, 200), fwd, rev), ("null", None, fwd, rev), ("noprimer", text, None, rev)], "id string, s string, f string, r string")
    got = concatemers.split(df, "s", "id", "f", "r", 0).orderBy("number").collect()
    assert [(x.amplicon_id, x.insert) for x in got] == [(f"x_{k}", s) for k, s in enumerate(inserts, 1)]
    assert concatemers.split(df, "s", "id", "f", "r", 0, least=4).count() == 0
    stats = {x.n_amplicons: (x.n_reads, x.n_bases) for x in concatemers.statistics(df, "s", "f", "r", [], 0).collect()}
    assert stats == {0: (3, 0), 3: (1, 150)}


def test_map_and_reads(spark):
    occ = spark.createDataFrame([("a", 5, 0, 5), ("b", 2, 0, 2)], "query string, size int, idx int, n int")
    reads = spark.createDataFrame([("a;size=5;", "AC"), ("c", "GG")], "read_id string, seq string")
    found, lost = clusters.with_reads(occ, reads)
    assert [(r.query, r.size, r.seq) for r in found.collect()] == [("a", 5, "AC")]
    assert [r.query for r in lost.collect()] == ["b"]


def test_seed_config():
    c = seed_config(FilterConfig(min_quality=30, alpha=0.01))
    assert (c.trim_width, c.trim_threshold, c.min_quality, c.alpha) == (10, 25, 0, -1)
    assert seed_config(c, merged=True).trim_threshold == 0
