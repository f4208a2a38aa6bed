"""Whole demultiplexing runs over pairs, with the options that change them."""

from dataclasses import replace

import pytest

from seqloom.functions.sequence import revcomp_text as rc
from seqloom.operators import pipeline
from seqloom.operators.config import FilterConfig, parse_options

BODY = "ACGTTGCATGCAACGTTGCATTGACCATGA"
FWD, REV = "GTGCCAGC", "CCCGGGTT"
CONFIG = FilterConfig(min_length=10, trim_threshold=0, primer_errors=0)
MAP = "sample_idx int, sample_id string, barcode_sequence string, barcode2nd_pair string, forward_primer string, reverse_primer string"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(0, "S0", "AAAACCCC", "TTTTGGGG", FWD, REV), (1, "S1", "AAAACCCC", "GGGGTTTT", FWD, REV), (2, "S2", "CCCCAAAA", None, FWD, REV)], MAP)


def table(spark, rows, index=False):
    kinds = "struct<read_ord: bigint, seq: string, quality: string, qual_offset: int>"
    read = lambda i, s: s and (i, s, "I" * len(s), 33)
    made = [(str(i), *(read(10 * i + k, s) for k, s in enumerate(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"pair_id string, r1 {kinds}, r2 {kinds}" + (f", index_read {kinds}" if index else ""))


def run(pairs, samples, config):
    return {(int(r.pair_id), r.mate): (r.sample_id, r.tier, r.seq) for r in pipeline.demultiplexed_pairs(pairs, samples, config).collect()}


def test_two_barcodes(spark, samples):
    one, two = FWD + BODY + rc(REV), REV + rc(BODY) + rc(FWD)
    rows = [("AAAACCCC" + one, "TTTTGGGG" + two), ("AAAACCCC" + one, "GGGGTTTT" + two), ("CCCCAAAA" + one, two), ("AAAACCCC" + one, "ACACACAC" + two), ("AAAACCCC" + one, None), (None, "TTTTGGGG" + two)]
    got = run(table(spark, rows), samples, CONFIG)
    for pair, name in enumerate(("S0", "S1", "S2")):
        assert got[pair, 1] == (name, "green", BODY) and got[pair, 2] == (name, "green", rc(BODY))
    assert got[3, 1][:2] == got[3, 2][:2] == got[4, 1][:2] == got[5, 2][:2] == (None, "unassigned")
    assert len(got) == 10


def test_index_reads_and_mixed_mates(spark, samples):
    one, two = FWD + BODY + rc(REV), REV + rc(BODY) + rc(FWD)
    got = run(table(spark, [(one, two, "CCCCAAAA"), (two, one, "CCCCAAAA"), (one, two, None)], True), samples, replace(CONFIG, check_mixed_pairs=True))
    assert got[0, 1] == got[1, 1] == ("S2", "green", BODY) and got[0, 2] == got[1, 2] == ("S2", "green", rc(BODY))
    assert got[2, 1][1] == "unassigned"


def single(spark, samples, texts, config, quality=None):
    df = spark.createDataFrame([(i, s, quality or "I" * len(s), 33, 1) for i, s in enumerate(texts)], "i int, seq string, quality string, qual_offset int, mate int")
    return {r.i: r for r in pipeline.demultiplexed(df, samples, config).collect()}


def test_turned_and_extensive(spark, samples):
    """Reads on the other strand are turned; an extensive search finds primers over three quarters of a read."""
    far = "CCCCAAAA" + "ACAT" * 8 + FWD + BODY
    turned = "CCCCAAAA" + rc(FWD + BODY)
    need = replace(CONFIG, need_forward_primer=True, need_forward_primer_2=True)
    plain = single(spark, samples, [far, turned], need)
    assert [plain[k].tier for k in (0, 1)] == ["failed", "failed"]
    assert single(spark, samples, [far, turned], replace(need, check_reversed=True))[1].seq == BODY
    wide = single(spark, samples, [far, turned], replace(need, extensive_primers=True))
    assert [(wide[k].tier, wide[k].seq) for k in (0, 1)] == [("green", BODY)] * 2
    assert parse_options(["ExtensivePrimerChecks\tT", "CheckForReversedSeqs\tT", "CheckForMixedPairs\tT"]).check_mixed_pairs


def test_reverse_primer_second_try(spark, samples):
    """A reverse primer with one error is found in the second try and makes the read second tier."""
    wrong = rc(REV)[:3] + "G" + rc(REV)[4:]
    got = single(spark, samples, ["CCCCAAAA" + FWD + BODY + rc(REV), "CCCCAAAA" + FWD + BODY + wrong], replace(CONFIG, primer_errors_2=1, need_reverse_primer=True, need_reverse_primer_2=True))
    assert [(got[k].tier, got[k].seq) for k in (0, 1)] == [("green", BODY), ("yellow", BODY)]


def test_without_a_map(spark):
    """No sample is asked for; the start is cut, which with a map it is not."""
    got = single(spark, None, ["ACGTT" + BODY], replace(CONFIG, trim_start=5))
    assert (got[0].tier, got[0].seq, got[0].sample_id) == ("green", BODY, None)


def test_options_together(spark, samples):
    """Tail runs, truncation and the binomial bound in one run, the last for both mates if asked."""
    config = replace(CONFIG, trim_run=5, truncate=25, alpha=0.005, max_expected_errors=1, need_forward_primer=True)
    read = "CCCCAAAA" + FWD + BODY + "AAAAAA"
    good = single(spark, samples, [read], config)[0]
    assert (good.tier, good.length, good.tail_trimmed) == ("green", 25, True)
    poor = single(spark, samples, [read], replace(config, min_quality=0), "#" * len(read))[0]
    assert (poor.tier, poor.binomial) == ("failed", True)
    pairs = spark.createDataFrame([("0", (1, "CCCCAAAA" + FWD + BODY, "I" * 46, 33), (2, REV + rc(BODY), "#" * 38, 33))], table(spark, []).schema)
    for both, tier in ((False, "green"), (True, "failed")):
        got = run(pairs, samples, replace(config, min_quality=0, binomial_both=both))
        assert got[0, 1][1] == "green" and got[0, 2][1] == tier


def test_strand_vote(spark, samples):
    """Far more reads with the other strand's barcodes turn the map."""
    turned = [("ACGT", rc(b) + BODY) for b in ("AAAACCCC", "CCCCAAAA")] * 2600
    df = spark.createDataFrame(turned, "x string, seq string")
    assert {r.barcode_sequence for r in pipeline.voted(df, samples).collect()} == {rc("AAAACCCC"), rc("CCCCAAAA")}
    assert {r.barcode_sequence for r in pipeline.voted(df.limit(100), samples).collect()} == {"AAAACCCC", "CCCCAAAA"}
