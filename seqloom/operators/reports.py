"""Counters, histograms and statistics of graded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiers import FLAGS, REASONS


def counters(graded: DataFrame) -> DataFrame:
    """mate, counter, n: reads by tier, reasons of failed reads (a read may have several) and trims."""
    failed = F.col("tier") == "failed"
    named = {"total": F.lit(True), **{t: F.col("tier") == t for t in ("green", "yellow", "failed")}, **{r: failed & F.col(r) for r in REASONS}, **{f: F.col(f) for f in FLAGS}}
    wide = graded.groupBy("mate").agg(*[F.count_if(c).alias(k) for k, c in named.items()])
    return wide.unpivot(["mate"], list(named), "counter", "n")


def accepted_by(graded: DataFrame, groups: list[str]) -> DataFrame:
    """groups, n_reads, n_green, n_yellow, n_failed, accepted (share of green, null without reads)."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("green", "yellow", "failed")]
    return graded.groupBy(*groups).agg(F.count("*").alias("n_reads"), *tiers).withColumn("accepted", F.col("n_green") / F.col("n_reads"))


def histogram(df: DataFrame, bin_of: Column, groups: list[str]) -> DataFrame:
    """groups, bin, n for all bins between the least and the greatest of a group, 0 where there is nothing."""
    counts = df.select(*groups, bin_of.cast("int").alias("bin")).filter("bin IS NOT NULL").groupBy(*groups, "bin").agg(F.count("*").alias("n"))
    ends = counts.groupBy(*groups).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    span = ends.select(*groups, F.explode(F.sequence("_a", "_b")).alias("bin"))
    return span.join(counts, [*groups, "bin"], "left").select(*groups, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_median(hist: DataFrame, groups: list[str]) -> DataFrame:
    """groups, median: the first bin at which half of the reads (rounded down) are reached."""
    up_to = Window.partitionBy(*groups).orderBy("bin")
    cum = hist.withColumn("_c", F.sum("n").over(up_to)).withColumn("_h", F.floor(F.sum("n").over(Window.partitionBy(*groups)) * 0.5))
    return cum.filter(F.col("_c") >= F.col("_h")).groupBy(*groups).agg(F.min("bin").alias("median"))


def summary(graded: DataFrame, groups: list[str], length: str, quality: str, error: str) -> DataFrame:
    """Means, least and greatest of length, quality (cut to whole numbers in the mean) and accumulated error."""
    return graded.groupBy(*groups).agg(
        F.count("*").alias("n_reads"),
        F.avg(length).alias("mean_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(F.floor(quality)).alias("mean_quality"),
        F.avg(error).alias("mean_error"),
    )


def run_score(graded: DataFrame, groups: list[str], length: str, quality: str, min_length: int, min_quality: float) -> DataFrame:
    """groups, score: how far mean length and mean quality are above the least allowed."""
    return graded.groupBy(*groups).agg(((F.avg(length) / min_length + F.avg(quality) / min_quality) / 2).alias("score"))


def base_table(reads: DataFrame, groups: list[str], seq: str = "seq") -> DataFrame:
    """groups, base, n, and the share of all bases: counted as lengths of texts, without a row a base."""
    counts = [(F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))).alias(b) for b in "ATGC"]
    wide = reads.select(*groups, *counts, F.length(seq).alias("all")).groupBy(*groups).agg(*[F.sum(b).alias(b) for b in "ATGC"], F.sum("all").alias("all"))
    long = wide.unpivot([*groups, "all"], list("ATGC"), "base", "n")
    return long.select(*groups, "base", "n", (F.col("n") / F.col("all")).alias("share"))
