"""Assigning reads to samples, and the checks of a sample map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching, sequence

#: A map of more rows isn't sent along with functions but joined.
MAP_ROWS = 100_000


def barcode_list(samples: DataFrame, column: str = "barcode_sequence") -> list[tuple[str, int]]:
    """(barcode, sample_idx); raises for maps over MAP_ROWS."""
    rows = samples.filter(F.col(column) != "").select(column, "sample_idx").limit(MAP_ROWS + 1).collect()
    if len(rows) > MAP_ROWS:
        raise ValueError(f"the sample map has over {MAP_ROWS} barcodes; use barcode_join")
    return [(r[0], r[1]) for r in rows]


def by_barcode(reads: DataFrame, samples: DataFrame, seq: str, scan: int = matching.SCAN, errors: int = 0) -> DataFrame:
    """reads with sample_idx, start, mismatches and candidates of their barcode."""
    found = matching.find_barcode(F.col(seq), barcode_list(samples), scan, errors)
    return reads.withColumn("_b", found).select("*", "_b.*").drop("_b")


def barcode_join(reads: DataFrame, samples: DataFrame, seq: str, key: str, scan: int = matching.SCAN) -> DataFrame:
    """The exact lookup for maps of any size: one row a start and length, an equi-join, the longest barcode and least start of each read."""
    wide = samples.filter(F.col("barcode_sequence") != "").select("barcode_sequence", F.col("sample_idx").alias("_s"), F.length("barcode_sequence").alias("_w"))
    widths = sorted(r[0] for r in wide.select("_w").distinct().collect()) or [1]
    starts = reads.select(key, seq, F.explode(F.sequence(F.lit(0), F.lit(scan - 1))).alias("start"))
    probes = starts.withColumn("_w", F.explode(F.array(*map(F.lit, widths)))).filter(F.length(seq) >= F.col("start") + F.col("_w"))
    probes = probes.select(key, "start", F.substr(seq, F.col("start") + 1, F.col("_w")).alias("barcode_sequence"))
    order = F.struct(-F.col("_w"), "start", "_s")
    first = probes.join(wide, "barcode_sequence").groupBy(key).agg(F.min_by("_s", order).alias("sample_idx"), F.min_by("start", order).alias("start"))
    return reads.join(first, key, "left")


def by_two_barcodes(first: DataFrame, second: DataFrame, samples: DataFrame, pair: str, code: str) -> DataFrame:
    """Pairs whose two barcodes are a listed combination; a map row without a second barcode takes any."""
    both = first.select(pair, F.col(code).alias("code1")).join(second.select(pair, F.col(code).alias("code2")), pair)
    listed = samples.select("sample_idx", F.col("barcode_sequence").alias("code1"), F.nullif("barcode2nd_pair", F.lit("")).alias("wanted"))
    joined = both.join(listed, "code1").filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("code2")))
    return joined.select(pair, "code1", "code2", "sample_idx")


def by_header(reads: DataFrame, samples: DataFrame, header: str = "header") -> DataFrame:
    """The first map row whose token the header holds: sample_idx, null without one; raises for maps over MAP_ROWS."""
    tokens = samples.filter(F.col("sample_id_in_head") != "").select("sample_idx", "sample_id_in_head").orderBy("sample_idx").limit(MAP_ROWS + 1).collect()
    if len(tokens) > MAP_ROWS:
        raise ValueError(f"the sample map has over {MAP_ROWS} header tokens")
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in tokens]) if tokens else F.expr("array(named_struct('i', cast(null as int), 't', cast(null as string)))")
    first = F.get(F.filter(listed, lambda x: F.contains(F.col(header), x["t"])), F.lit(0))
    return reads.withColumn("sample_idx", first["i"]).withColumn("token", first["t"])


def files_of(samples: DataFrame) -> DataFrame:
    """sample_idx, file_name for each file that a map row names."""
    return samples.select("sample_idx", "sample_id", "sequencing_run", F.explode(F.split("fastq_file", r"\s*[,;]\s*")).alias("file_name")).filter("file_name <> ''")


def by_file(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """Reads of files that belong to one sample alone: sample_idx, null otherwise."""
    single = files_of(samples).groupBy("file_name").agg(F.count("*").alias("_n"), F.min("sample_idx").alias("sample_idx")).filter("_n = 1").drop("_n")
    return reads.drop("sample_idx").join(single, "file_name", "left")


def strand_votes(reads: DataFrame, samples: DataFrame, seq: str) -> DataFrame:
    """forward, reverse, swap: reads with a barcode on either strand; all barcodes are turned if far more are reverse."""
    codes = barcode_list(samples)
    turned = [(str(sequence.revcomp_text(b)), i) for b, i in codes]
    fwd, rev = matching.find_barcode(F.col(seq), codes), matching.find_barcode(F.col(seq), turned)
    hits = reads.select(fwd["sample_idx"].isNotNull().alias("f"), rev["sample_idx"].isNotNull().alias("r"))
    votes = hits.agg(F.count_if("f").alias("forward"), F.count_if("r").alias("reverse"))
    return votes.withColumn("swap", (F.col("forward") + F.col("reverse") > 5000) & (F.col("reverse") > 8 * F.col("forward")))


def combined(counts: DataFrame, samples: DataFrame, value: str) -> DataFrame:
    """Sums of `value` by group of combined samples; a sample without group is its own."""
    group = F.coalesce(F.nullif("combine_samples", F.lit("")), "sample_id")
    return counts.join(samples.select("sample_id", group.alias("group")), "sample_id").groupBy("group").agg(F.sum(value).alias(value))


def map_problems(samples: DataFrame) -> DataFrame:
    """problem, value, n: what makes a map unusable. Repeated sample ids, barcode pairs and header tokens; a sample
    of one file in several runs; a barcode of another length than the rest."""

    def repeated(name: str, value) -> DataFrame:
        return samples.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("problem"), "value", "n")

    code = F.concat_ws("+", F.nullif("barcode_sequence", F.lit("")), F.nullif("barcode2nd_pair", F.lit("")))
    runs = files_of(samples).groupBy(F.col("file_name").alias("value")).agg(F.countDistinct("sequencing_run").alias("n")).filter("n > 1").select(F.lit("file in several runs").alias("problem"), "value", "n")
    length = samples.filter("barcode_sequence <> ''").groupBy(F.length("barcode_sequence").alias("_w")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.desc("_w")))
    other = length.withColumn("_k", rank).filter("_k > 1").select(F.lit("barcode length").alias("problem"), F.col("_w").cast("string").alias("value"), "n")
    parts = [repeated("sample id", F.col("sample_id")), repeated("barcode", code), repeated("header token", F.col("sample_id_in_head")), runs, other]
    return reduce(DataFrame.unionByName, parts)
