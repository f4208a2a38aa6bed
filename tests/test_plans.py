"""Tiers, pipeline, sinks, streaming and the registry."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from seqloom.operators.config import FilterConfig
from seqloom.operators.pipeline import demultiplexed
from seqloom.operators.tiers import with_tier
from seqloom.sources import fastx, sinks
from seqloom.streaming import ingest

DATA = "/root/testdata/sf0.001"
CORE = [n for n in __spark_entry__.registry.QUERIES if n in __spark_entry__.registry.ORACLES]


def graded(spark, rows, config):
    df = spark.createDataFrame([(i, s, q, 33, 1, "x") for i, (s, q) in enumerate(rows)], "i int, seq string, quality string, qual_offset int, mate int, short string").drop("short")
    return with_tier(df, config).orderBy("i").collect()


def test_tiers(spark):
    c = FilterConfig(min_length=10, min_length_2=6, max_length=30, min_quality=30, min_quality_2=20, max_ambiguous=0, max_ambiguous_2=2, trim_threshold=0, max_run=6, trim_run=0)
    good = "ACGTACGTACGT"
    rows = [(good, "I" * 12), (good[:8], "I" * 8), (good[:5], "I" * 5), (good * 3, "I" * 36), (good, "9" * 12), (good, "#" * 12), ("ACGTAAAAAAGT", "I" * 12), ("ACGTNCGTACGT", "I" * 12), ("NNGTACGTACGT", "I" * 12), ("", ""), (None, None)]
    got = graded(spark, rows, c)
    assert [r.tier for r in got] == ["green", "yellow", "failed", "failed", "yellow", "failed", "failed", "yellow", "failed", "failed", "failed"]
    assert got[3].long and got[5].low_quality and got[6].homopolymer and got[8].ambiguous and got[9].short
    only = graded(spark, rows[:2], FilterConfig(**{**c.__dict__, "second_output": False}))
    assert [r.tier for r in only] == ["green", "failed"]


def test_tail_and_binomial(spark):
    c = FilterConfig(min_length=5, min_quality=0, trim_threshold=0, max_run=99, trim_run=4, alpha=0.005, max_expected_errors=1)
    got = graded(spark, [("ACGTCAAAAA", "I" * 10), ("ACGTCAAA", "I" * 8), ("ACGTC" * 4, "#" * 20)], c)
    assert [(r.length, r.tail_trimmed) for r in got[:2]] == [(5, True), (8, False)]
    assert got[2].tier == "failed" and got[2].binomial


def test_pipeline(spark):
    samples = spark.createDataFrame([(0, "S0", "AAAACCCC", "GTGM", "CCCGGG"), (1, "S1", "GGGGTTTT", None, None)], "sample_idx int, sample_id string, barcode_sequence string, forward_primer string, reverse_primer string")
    body = "ACGTTGCATGCAACGTTGCA"
    rows = ["AAAACCCC" + "GTGC" + body + "CCCGGG", "AAAACCCC" + "TTTT" + body, "GGGGTTTT" + body, "CATCATCATCAT" + body, "", None]
    df = spark.createDataFrame([(i, s, s and "I" * len(s), 33, 1, 9) for i, s in enumerate(rows)], "i int, seq string, quality string, qual_offset int, mate int, sample_idx int")
    c = FilterConfig(min_length=10, trim_threshold=0, primer_errors=0, need_forward_primer=True, need_forward_primer_2=True)
    got = {r.i: (r.sample_id, r.tier, r.seq) for r in demultiplexed(df, samples, c).collect()}
    assert got[0] == ("S0", "green", body)
    assert got[1][:2] == ("S0", "failed") and got[2] == ("S1", "green", body) and got[3][:2] == (None, "unassigned")
    assert got[4][:2] == got[5][:2] == (None, "unassigned")


def test_sinks(spark, tmp_path):
    rows = [("a", "ACGT" * 30, "I" * 120, 33, "green", "pair1", "S0", 1), ("b", "AC", "h`", 64, "yellow", "single1", None, 1), ("c", "AC", "II", 33, "green", "pair2", "S0", 2)]
    df = spark.createDataFrame(rows, "read_id string, seq string, quality string, qual_offset int, tier string, slot string, sample_id string, mate int").withColumn("stream", F.col("tier"))
    sinks.write_tiers(df, str(tmp_path / "t"), suppress=("yellow",), gzip=True)
    assert sorted(os.listdir(tmp_path / "t" / "stream=green"))[:2] == ["slot=pair1", "slot=pair2"] and not (tmp_path / "t" / "stream=yellow").exists()
    back = fastx.read_fastx(spark, str(tmp_path / "t" / "stream=green" / "slot=pair1")).first()
    assert (back.read_id, back.sequence, back.quality) == ("a", "ACGT" * 30, "I" * 120)
    sinks.write_samples(df, str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "sample_id=S0" / "mate=1")
    sinks.write_fasta(df, str(tmp_path / "f"), max_records=1)
    assert len([x for x in os.listdir(tmp_path / "f") if x.endswith(".txt")]) >= 3
    assert df.filter("read_id = 'b'").select(sinks.qual_text(F.col("read_id"), F.col("quality"), F.col("qual_offset"))).first()[0] == ">b\n40 32"


def test_write_derep(spark, tmp_path):
    d = spark.createDataFrame([("AC", 5), ("GG", 1)], "key string, total int")
    o = spark.createDataFrame([("AC", "0:5"), ("GG", "0:1")], "key string, occurrences string")
    s = spark.createDataFrame([(0, "S0")], "sample_idx int, sample_id string")
    sinks.write_derep(d, o, s, F.col("total") > 2, str(tmp_path))
    text = lambda n: "".join(r[0] for r in spark.read.text(str(tmp_path / n), wholetext=True).collect())
    assert text("passing").endswith(";size=5;\nAC\n") and text("rest").endswith(";size=1;\nGG\n")
    assert text("map_head") == "#SMPLS\t0:S0\n" and sorted(x.split("\t")[1] for x in text("map").split("\n") if x) == ["0:1", "0:5"]


def test_stream(spark, tmp_path):
    rows = [(k, "ACGTACGTAC", "I" * 10, 33, 1, f"S{k % 2}") for k in range(20)]
    kinds = "read_ord int, seq string, quality string, qual_offset int, mate int, sample_id string"
    spark.createDataFrame(rows, kinds).repartition(4).write.parquet(str(tmp_path / "in"))
    reads = ingest.stream_reads(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_a_batch=1)
    config = FilterConfig(min_length=5, trim_threshold=0)
    for _ in range(2):  # a second start finds nothing new
        ingest.write_parts(ingest.grade_stream(reads, config), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.sample_id, r.n) for r in ingest.merged_occurrences(spark, str(tmp_path / "out")).collect()} == {("S0", 10), ("S1", 10)}
    assert {r.counter: r.n for r in ingest.merged_counters(spark, str(tmp_path / "out")).collect()}["green"] == 20


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n in CORE if n != "stream_counters"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    frame = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))
    assert got == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
