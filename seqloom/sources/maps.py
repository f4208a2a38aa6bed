"""Text tables that steer a run: sample maps, options, read subsets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.config import FilterConfig, parse_options

# fixed values: column names of sample maps and the names used here
COLUMNS = {
    "SampleID": "sample_id",
    "BarcodeSequence": "barcode_sequence",
    "LinkerPrimerSequence": "forward_primer",
    "ForwardPrimer": "forward_primer",
    "ReversePrimer": "reverse_primer",
    "fastqFile": "fastq_file",
    "fnaFile": "fna_file",
    "qualFile": "qual_file",
    "SampleIDinHead": "sample_id_in_head",
    "MIDfqFile": "index_file",
    "CombineSamples": "combine_samples",
    "Barcode2ndPair": "barcode2nd_pair",
    "HetSpacerFwd": "spacer_forward",
    "HetSpacerRev": "spacer_reverse",
    "derepMin": "derep_min",
    "SequencingRun": "sequencing_run",
}
SEQUENCES = ("barcode_sequence", "forward_primer", "reverse_primer", "barcode2nd_pair")


def read_sample_map(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated sample map: its first line, with #, names the columns in any order.

    Unknown columns are left out, absent ones null, sequences in upper case, sample_idx the place in the map. Lines
    with another number of fields than the header raise ValueError, as do maps without SampleID.
    """
    lines = [x.rstrip("\r").lstrip("﻿") for r in spark.read.text(path, wholetext=True).collect() for x in re.split("\r\n|\r|\n", r[0])]
    lines = [x for x in lines if x.strip()]
    if not lines or not lines[0].startswith("#"):
        raise ValueError("a sample map begins with a header line and #")
    names = [COLUMNS.get(x.strip()) for x in lines[0][1:].split("\t")]
    if "sample_id" not in names:
        raise ValueError("the sample map has no column SampleID")
    rows = []
    for number, line in enumerate((x for x in lines[1:] if not x.startswith("#")), 2):
        values = [x.strip() for x in line.split("\t")]
        if len(values) != len(names):
            raise ValueError(f"line {number} of the sample map has {len(values)} fields and not {len(names)}")
        row = dict.fromkeys(dict.fromkeys(COLUMNS.values())) | {n: v or None for n, v in zip(names, values, strict=True) if n}
        row |= {c: row[c].upper() for c in SEQUENCES if row[c]}
        rows.append((len(rows), *row.values()))
    fields = ", ".join(f"{c} string" for c in dict.fromkeys(COLUMNS.values()))
    made = spark.createDataFrame(rows, f"sample_idx int, {fields}")
    return made.withColumn("derep_min", F.col("derep_min").try_cast("int"))


def read_options(spark: SparkSession, path: str, base: FilterConfig | None = None) -> FilterConfig:
    text = spark.read.text(path, wholetext=True).first()
    return parse_options(re.split("\r\n|\r|\n", text[0]) if text else [], base)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """read_id, new_header, out_file of a list of reads: one to three tab-separated columns, a leading > or @ is dropped."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.regexp_replace(F.get(f, F.lit(0)), "^[>@]", "").alias("read_id"), F.get(f, F.lit(1)).alias("new_header"), F.get(f, F.lit(2)).alias("out_file"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text file that is read as one (cluster maps of programs that write one file)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
