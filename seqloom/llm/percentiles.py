"""Percentiles of any number of values from cumulative frequencies.

Values are reduced to (group, value, rows) before anything is shuffled. Such tables are the
mergeable state: those of separate files or days are added, and a coarser grouping is a sum.
The table is range-sorted, running sums within the range partitions get the totals of the
partitions before as offsets, and a percentile is the first value whose cumulative frequency
reaches its rank. The result is exact, or off by at most half of `resolution` where values
are rounded to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import range_sorted, running_sum
from ..session import table

PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def frequencies(df: DataFrame, groups: list[str], value: Column, resolution: float = 0) -> DataFrame:
    """groups, value (double), n: how many rows have the value; nulls and NaN left out."""
    number = value.cast("double")
    if resolution:
        number = F.round(number / resolution) * resolution
    rows = df.select(*groups, number.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))


def score_frequencies(reads: DataFrame, groups: list[str], quality: str = "quality", offset: str = "qual_offset") -> DataFrame:
    """groups, value, n over all characters of `quality`: character code less `offset`.

    Rows without quality or offset have no scores. The characters of an Arrow batch are counted as one array, so a
    batch leaves at most one row for each of its groups and scores.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"g{i}" for i in range(len(groups))]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.table([*(batch.column(i) for i in range(len(groups))), batch.column(len(groups) + 1)], [*names, "o"])
            coded = keys.append_column("i", pa.array(np.arange(len(keys)))).group_by([*names, "o"], use_threads=False).aggregate([("i", "list")])
            owner = np.zeros(len(keys), np.int64)
            lists = coded["i_list"].combine_chunks()
            owner[lists.values.to_numpy()] = np.repeat(np.arange(len(coded)), np.diff(lists.offsets.to_numpy()))
            text = batch.column(len(groups)).cast(pa.large_utf8())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
            if len(data) and data.max() > 127:  # characters, not bytes
                points = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in text.to_pylist()]
                lengths, codes = np.array([len(p) for p in points]), np.concatenate(points).astype(np.int64)
                pairs, rows = np.unique(np.repeat(owner, lengths) * 0x110000 + codes, return_counts=True)
                at, code = pairs // 0x110000, pairs % 0x110000
            else:
                both = np.bincount(np.repeat(owner * 128, np.diff(ends)) + data, minlength=1)
                pairs = np.flatnonzero(both)
                rows, at, code = both[pairs], pairs // 128, pairs % 128
            found = coded.take(pa.array(at)).combine_chunks()
            value = code - found["o"].to_numpy()
            yield from pa.table([*(found[c] for c in names), pa.array(value.astype(np.float64)), pa.array(rows.astype(np.int64))], [*names, "value", "n"]).combine_chunks().to_batches()

    kinds = ", ".join(f"g{i} {reads.schema[g].dataType.simpleString()}" for i, g in enumerate(groups))
    there = reads.select(*groups, quality, offset).filter(F.col(quality).isNotNull() & (F.col(quality) != "") & F.col(offset).isNotNull())
    counted = there.mapInArrow(count, f"{kinds}, value double, n bigint")
    named = counted.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], "value", "n")
    return merged(named, groups)


def merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Frequency tables put together, or summed up to fewer groups."""
    return parts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(freq: DataFrame, groups: list[str], probabilities: tuple[float, ...] = PROBABILITIES, resolution: float = 0) -> DataFrame:
    """groups, probability, n_values, value, error_bound: the value of rank ceil(probability * n_values), at least 1.

    A null group is a group; groups without values don't come out; an empty table gives no rows. `freq` may be
    merged from parts, but must have one row for a group and value.
    """
    ranged = range_sorted(freq.select(*groups, "value", "n"), groups, ["value"])  # from here on the values aren't read again
    cumulated = running_sum(ranged, groups, ["value"], "n", "_cum", ranged=True)
    totals = ranged.groupBy(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(groups)]).agg(F.sum("n").alias("_all"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_t{i}"))
    ranked = cumulated.join(totals, same) if groups else cumulated.withColumn("_all", F.sum("n").over(Window.partitionBy()))
    targets = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(str(p)).cast("decimal(10,9)") * F.col("_all"))).cast("long").alias("rank")) for p in probabilities])).alias("_t")
    reached = ranked.select(*groups, "value", "n", "_cum", "_all", targets).filter((F.col("_cum") >= F.col("_t.rank")) & (F.col("_cum") - F.col("n") < F.col("_t.rank")))
    return reached.select(*groups, F.col("_t.p").alias("probability"), F.col("_all").alias("n_values"), "value", F.lit(resolution / 2).alias("error_bound"))


# queries


def p2_quality_by_sample_day(spark, sf_dir: str) -> DataFrame:
    """The finest parts, of which the tables by sample and by day are sums."""
    reads = table(spark, sf_dir, "fastx_records").withColumn("read_day", F.col("read_day").cast("string"))
    return percentiles(score_frequencies(reads, ["sample_id", "read_day"]), ["sample_id", "read_day"])


def p2_quality_by_run(spark, sf_dir: str) -> DataFrame:
    return percentiles(score_frequencies(table(spark, sf_dir, "fastx_records"), ["seq_run"]), ["seq_run"])


def p2_quality_by_sample(spark, sf_dir: str) -> DataFrame:
    return percentiles(score_frequencies(table(spark, sf_dir, "fastx_records"), ["sample_id"]), ["sample_id"])


def p2_quality_by_file(spark, sf_dir: str) -> DataFrame:
    return percentiles(score_frequencies(table(spark, sf_dir, "fastx_records"), ["file_name"]), ["file_name"])


def p2_quality_by_day(spark, sf_dir: str) -> DataFrame:
    """By day, put together from the separate tables of each file and day."""
    reads = table(spark, sf_dir, "fastx_records").withColumn("read_day", F.col("read_day").cast("string"))
    return percentiles(merged(score_frequencies(reads, ["file_name", "read_day"]), ["read_day"]), ["read_day"])


def _barcodes(spark, sf_dir: str, groups: list[str]) -> DataFrame:
    detected = F.when(F.col("barcode_detected") != -1, F.col("barcode_detected"))
    stats = table(spark, sf_dir, "barcode_stats").withColumn("stat_day", F.col("stat_day").cast("string"))
    return frequencies(stats, groups, detected)


def p2_barcodes_by_sample(spark, sf_dir: str) -> DataFrame:
    return percentiles(merged(_barcodes(spark, sf_dir, ["sample_id", "stat_day"]), ["sample_id"]), ["sample_id"])


def p2_barcodes_by_day(spark, sf_dir: str) -> DataFrame:
    return percentiles(_barcodes(spark, sf_dir, ["stat_day"]), ["stat_day"])
