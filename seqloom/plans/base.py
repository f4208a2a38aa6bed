"""The tables that queries of the core start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as fq
from ..functions import sequence as fs
from ..session import spread, table


def reads(spark, sf_dir: str) -> DataFrame:
    """Reads with as many scores as bases: read_ord, seq_run, file_name, sample_id, mate, header, read_id, seq, quality, qual_offset."""
    r = table(spark, sf_dir, "fastx_records")
    r = r.filter((F.col("sequence") != "") & (F.length("sequence") == F.length("quality")) & F.col("qual_offset").isNotNull())
    return spread(r).select("read_ord", "seq_run", "file_name", "sample_id", "mate", "header", "read_id", F.upper("sequence").alias("seq"), "quality", "qual_offset")


def tagged(spark, sf_dir: str) -> DataFrame:
    """Reads with the index of their header in front of the bases, as they come from the machine: `tag`, `tagged`."""
    r = reads(spark, sf_dir)
    tag = F.regexp_extract("header", r"(?:[12]:[NY]:\d+:|bc=)([ACGTN]+)", 1)
    return r.withColumn("tag", tag).filter("tag <> ''").withColumn("tagged", F.concat("tag", "seq"))


def samples(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_map")
    upper = {c: F.upper(F.trim(c)) for c in ("barcode_sequence", "forward_primer", "reverse_primer", "barcode2nd_pair")}
    return s.withColumns(upper)


def measured(spark, sf_dir: str, *only: str) -> DataFrame:
    """Reads with the measures named."""
    r = reads(spark, sf_dir)
    return r.withColumn("m", fq.measures(F.col("quality"), F.col("qual_offset"), only)).select("*", "m.*").drop("m")


READS = """reads AS (SELECT read_ord, seq_run, file_name, sample_id, mate, header, read_id, upper(sequence) AS seq, quality, qual_offset, length(sequence) AS n
  FROM fastx_records WHERE sequence <> '' AND length(sequence) = length(quality) AND qual_offset IS NOT NULL)"""
SCORED = READS + """, scored AS (SELECT *, list_transform(string_split(quality, ''), lambda c: CAST(unicode(c) - qual_offset AS BIGINT)) AS q FROM reads)"""
TAGGED = READS + r""", tagged AS (SELECT *, tag || seq AS tagged FROM (SELECT *, regexp_extract(header, '(?:[12]:[NY]:\d+:|bc=)([ACGTN]+)', 1) AS tag FROM reads) WHERE tag <> '')"""
SAMPLES = """samples AS (SELECT sample_idx, sample_id, upper(trim(barcode_sequence)) AS barcode_sequence, upper(trim(forward_primer)) AS forward_primer, upper(trim(reverse_primer)) AS reverse_primer,
  upper(trim(barcode2nd_pair)) AS barcode2nd_pair, sample_id_in_head, combine_samples, sequencing_run, derep_min, fastq_file FROM sample_map)"""
REVCOMP = "reverse(translate(regexp_replace(upper({0}), '[^" + fs.CODES + "]', 'N', 'g'), '" + fs.CODES + "', '" + fs.COMPLEMENTS + "'))"
ERROR = "CASE WHEN {0} >= 70 THEN 1e-7 ELSE pow(10.0, -greatest({0}, 0) / 10.0) END"
