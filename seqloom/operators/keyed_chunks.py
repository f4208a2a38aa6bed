"""Per-key results although a few keys hold most rows: exact offset chunking.

1. Count the rows of each key per input split (one map-side aggregate).
2. A prefix sum of these counts over the splits gives each (split, key) its offset.
3. offset + rank within (split, key) numbers the rows of a key 0, 1, 2 ... in input order,
   without any task holding a whole key: a split's share of a key is bounded by the split.
4. number // chunk_rows cuts each key into chunks of equal size, which are processed alone.
5. Each chunk leaves one small state; the states of a key are merged in chunk order, its
   neighbours' boundary values included.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table, written

CHUNK_ROWS = 100_000

POSITION = ("_path", "_block", "_row")


def positioned(scan: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of a file scan with each row's place in the input: file, split start, row number.

    The place is part of the data, not of the plan: it stays the same when a task runs again.
    """
    return scan.select(
        *columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.row_index").alias("_row"),
    )


def positioned_any(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The same for a frame that is no file scan: it is written to the shared folder first."""
    return positioned(written(df.select(*columns)), *[F.col(c) for c in df.select(*columns).columns])


def number_rows(rows: DataFrame, key: str, out: str = "_number") -> DataFrame:
    """rows (as positioned() gives them) with their number within the key, from 0, in input order, and the key's total `_total`.

    A null key is a key of its own. No partition of any exchange is larger than an input split
    plus what else hashes there, whatever share of the rows a key has.
    """
    split = F.xxhash64("_path", "_block")
    counts = rows.groupBy(F.col(key).alias("_k"), split.alias("_s")).agg(F.count("*").alias("_n"), F.first("_path").alias("_p"), F.first("_block").alias("_b"))
    over = Window.partitionBy("_k")
    offsets = counts.select(
        "_k",
        "_s",
        F.coalesce(F.sum("_n").over(over.orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(over).alias("_total"),
    )
    here = Window.partitionBy(key, "_split").orderBy("_row")
    ranked = rows.withColumn("_split", split).withColumn("_rank", F.row_number().over(here) - 1)
    joined = ranked.join(offsets, (F.col("_split") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn(out, F.col("_offset") + F.col("_rank")).drop("_k", "_s", "_offset", "_rank", "_split")


def chunked(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows with `_number` and `_chunk`; each (key, chunk) but a key's last has exactly chunk_rows rows."""
    return number_rows(rows, key).withColumn("_chunk", F.floor(F.col("_number") / chunk_rows).cast("long"))


def key_states(rows: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a key: n_rows, n_values, total, least, most of `value`, first_value and last_value in input order, and
    n_changes, how often the value differs from that of the key's row before (null-safe).

    Defined cases: a null key is a key; a key whose values are all null has null total, least and most;
    an empty table gives no rows.
    """
    cut = chunked(rows, key, chunk_rows)
    inside = Window.partitionBy(key, "_chunk").orderBy("_number")
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(inside)) & (F.row_number().over(inside) > 1)
    states = (
        cut.withColumn("_changed", changed.cast("long"))
        .groupBy(key, "_chunk")
        .agg(
            F.count("*").alias("n"),
            F.count(value).alias("nv"),
            F.sum(value).alias("sum"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.min_by(F.struct(value), "_number").alias("head"),
            F.max_by(F.struct(value), "_number").alias("tail"),
            F.sum("_changed").alias("changes"),
        )
    )
    before = Window.partitionBy(key).orderBy("_chunk")
    seam = (F.col("_chunk") > 0) & ~F.col("head").eqNullSafe(F.lag("tail").over(before))
    return (
        states.withColumn("_seam", F.coalesce(seam, F.lit(False)).cast("long"))
        .groupBy(key)
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("nv").alias("n_values"),
            F.sum("sum").alias("total"),
            F.min("lo").alias("least"),
            F.max("hi").alias("most"),
            F.min_by("head", "_chunk")[value].alias("first_value"),
            F.max_by("tail", "_chunk")[value].alias("last_value"),
            F.sum(F.col("changes") + F.col("_seam")).alias("n_changes"),
            F.count("*").alias("n_chunks"),
        )
    )


def process_chunks(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """fn over each chunk of each key, its rows in input order; for work that built-ins can't express.

    fn gets at most chunk_rows rows and returns rows of `schema`; merging them is the caller's.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("_number", kind="stable"))

    return chunked(rows, key, chunk_rows).groupBy(key, "_chunk").applyInPandas(one, schema)


# queries


def sample_reads(spark, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "fastx_records")
    return positioned(scan, F.col("sample_id"), F.length("sequence").cast("long").alias("n_bases"))


def sequence_reads(spark, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "fastx_records")
    return positioned(scan, F.upper("sequence").alias("sequence"), F.length("quality").cast("long").alias("n_scores"))


def sample_barcodes(spark, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "barcode_stats")
    value = F.when(F.col("barcode_detected") >= 0, F.col("barcode_detected")).cast("long")
    return positioned(scan, F.col("sample_id"), value.alias("barcode_detected"))


def p5_reads_by_sample(spark, sf_dir: str) -> DataFrame:
    return key_states(sample_reads(spark, sf_dir), "sample_id", "n_bases")


def p5_reads_by_sequence(spark, sf_dir: str) -> DataFrame:
    return key_states(sequence_reads(spark, sf_dir), "sequence", "n_scores")


def p5_barcodes_by_sample(spark, sf_dir: str) -> DataFrame:
    return key_states(sample_barcodes(spark, sf_dir), "sample_id", "barcode_detected")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Keys with more than 3 % of all rows of their table; the rows of a key come from the chunked results, those of the
    table from the files' metadata."""
    parts = [
        (p5_reads_by_sample(spark, sf_dir), "fastx_records", "sample_id"),
        (p5_reads_by_sequence(spark, sf_dir), "fastx_records", "sequence"),
        (p5_barcodes_by_sample(spark, sf_dir), "barcode_stats", "sample_id"),
    ]
    everything = {name: table(spark, sf_dir, name).count() for name in ("fastx_records", "barcode_stats")}
    found = [
        states.filter((F.col(field) != "") & (F.col("n_rows") * 100 > 3 * everything[name])).select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.col(field).alias("key_text"))
        for states, name, field in parts
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])
