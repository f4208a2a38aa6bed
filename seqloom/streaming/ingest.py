"""Reads that arrive in files over time: the same functions on a stream.

Counts by key and sample are kept as a table of parts, one for each micro-batch; parts are sums,
so the state of a key never has to be held and a batch that is written again replaces its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import derep, reports
from ..operators.config import FilterConfig
from ..operators.tiers import with_tier


def stream_reads(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def grade_stream(reads: DataFrame, config: FilterConfig) -> DataFrame:
    """Stateless: the tier decision of each read."""
    return with_tier(reads, config)


def accepted_by_window(graded: DataFrame, time: str = "loaded_at", late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Reads by sample and day of arrival; a window closes when the watermark has passed it."""
    known = graded.withWatermark(time, late).groupBy(F.window(time, width), "sample_id")
    return known.agg(F.count("*").alias("n_reads"), F.count_if(F.col("tier") == "green").alias("n_green"))


def write_parts(graded: DataFrame, path: str, checkpoint: str, length: int = -1) -> StreamingQuery:
    """Dereplication parts and counters of each micro-batch below `path`, once each."""

    def part(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        have = derep.keyed(held.filter("sample_id IS NOT NULL"), length)
        derep.occurrences(have, ["key"]).write.mode("overwrite").parquet(f"{path}/occurrences/part={number}")
        reports.counters(held).write.mode("overwrite").parquet(f"{path}/counters/part={number}")
        held.unpersist()

    return graded.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/occurrences").groupBy("key", "sample_id").agg(F.sum("n").alias("n"))


def merged_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counters").groupBy("mate", "counter").agg(F.sum("n").alias("n"))
