"""Queries of sources, sinks and streaming; files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import rebased
from ..operators import pairs
from ..operators.tiers import with_tier
from ..session import scratch, table, written
from ..sources import fastx, sinks
from ..streaming import ingest
from .base import READS, SCORED, reads
from .group_queries import _JOINED
from .tier_queries import _ALL, _COUNTERS, CONFIG


def fastq_render(spark, d: str) -> DataFrame:
    q = rebased(F.col("quality"), F.col("qual_offset"))
    return reads(spark, d).withColumn("q", q).select("read_ord", sinks.fastq_text(F.col("read_id"), F.col("seq"), F.col("q")).alias("record"))


def fasta_wrap(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", sinks.fasta_text(F.col("read_id"), F.col("seq")).alias("record"))


def qual_render(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", sinks.qual_text(F.col("read_id"), F.col("quality"), F.col("qual_offset")).alias("record"))


def fastq_scan(spark, d: str) -> DataFrame:
    """Reads written as FASTQ and read again."""
    path = scratch(spark)
    sinks.write_fastq(reads(spark, d).filter("read_id <> ''"), path)
    return fastx.read_fastx(spark, path, offset="33", rangebytes="300000").select("read_id", F.col("sequence").alias("seq"), "quality")


def fasta_scan(spark, d: str) -> DataFrame:
    """Records written as wrapped, compressed FASTA and read again."""
    path = scratch(spark)
    f = table(spark, d, "fasta_records").filter("sequence <> '' AND read_id <> ''").select("read_id", F.upper("sequence").alias("seq"))
    sinks.write_fasta(f, path, gzip=True)
    return fastx.read_fastx(spark, path).select("read_id", F.col("sequence").alias("seq"))


def fastq_mates_scan(spark, d: str) -> DataFrame:
    """Pairs written as two files, named by the first read of the pair, and read again as mates."""
    p = pairs.joined(reads(spark, d), ["read_ord", "seq", "quality", "qual_offset"])
    p = written(p.withColumn("n", F.coalesce("r1.read_ord", "r2.read_ord")).select("n", "r1", "r2"))
    paths = []
    for k in (1, 2):
        paths.append(scratch(spark))
        mate = p.filter(F.col(f"r{k}").isNotNull()).select(F.concat(F.lit("read"), F.col("n").cast("string"), F.lit(f"/{k}")).alias("read_id"), f"r{k}.*")
        sinks.write_fastq(mate, paths[-1])
    m = fastx.read_mates(spark, ",".join(paths), offset="33")
    return m.select(F.regexp_extract("stem", r"\d+", 0).cast("bigint").alias("n"), F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


def qual_scan(spark, d: str) -> DataFrame:
    """Reads written as FASTA and QUAL files and read again as reads with scores."""
    fasta, qual = scratch(spark), scratch(spark)
    r = reads(spark, d).withColumn("read_id", F.concat(F.lit("r"), F.col("read_ord").cast("string")))
    sinks.write_fasta(r, fasta, gzip=True)
    sinks.write_text(r, sinks.qual_text(F.col("read_id"), F.col("quality"), F.col("qual_offset")), qual)
    back = fastx.with_quality(fastx.read_fastx(spark, fasta), fastx.read_qual(spark, qual))
    return back.select(F.expr("substr(read_id, 2)").cast("bigint").alias("read_ord"), F.col("sequence").alias("seq"), "quality")


def _records(spark, path: str, *by: str) -> DataFrame:
    """Records in the folders under path."""
    return spark.read.text(path).filter(F.col("value").startswith("@read_")).groupBy(*by).agg(F.count("*").alias("n_records"))


def _named(spark, d: str) -> DataFrame:
    return with_tier(reads(spark, d), CONFIG).withColumn("read_id", F.concat(F.lit("read_"), F.col("read_ord").cast("string")))


def tiers_written(spark, d: str) -> DataFrame:
    """Mates in the outputs of their tier, as counted in the files."""
    g = _named(spark, d)
    path = scratch(spark)
    p = pairs.joined(with_tier(reads(spark, d), CONFIG), ["read_ord", "tier"])
    place = pairs.routed(p).join(p.select("pair_id", F.col("r1.read_ord").alias("_1"), F.col("r2.read_ord").alias("_2")), "pair_id")
    place = place.select(F.when(F.col("mate") == 1, F.col("_1")).otherwise(F.col("_2")).alias("read_ord"), "stream", "slot")
    sinks.write_tiers(g.join(place, "read_ord"), path)
    return _records(spark, path, "stream", "slot")


def samples_written(spark, d: str) -> DataFrame:
    """First-tier reads in a folder for each sample and mate, as counted in the files."""
    path = scratch(spark)
    sinks.write_samples(_named(spark, d), path, gzip=True)
    return _records(spark, path, "sample_id", "mate")


def reports_written(spark, d: str) -> DataFrame:
    """The counters among the report files of a run, as read again."""
    path = scratch(spark)
    sinks.write_reports(with_tier(reads(spark, d), CONFIG), path)
    return spark.read.option("sep", "\t").option("header", True).schema("mate int, counter string, n bigint").csv(f"{path}/counters")


def stream_counters(spark, d: str) -> DataFrame:
    """Counters of a stream of files, added up over its micro-batches."""
    path = scratch(spark)
    source = table(spark, d, "fastx_records")
    rows = ingest.stream_reads(spark, f"{d}/fastx_records.parquet*", source.schema)
    good = rows.filter("sequence <> '' AND length(sequence) = length(quality) AND qual_offset IS NOT NULL").withColumn("seq", F.upper("sequence"))
    ingest.write_parts(ingest.grade_stream(good, CONFIG), path, f"{path}/state").awaitTermination()
    return ingest.merged_counters(spark, path)


QUERIES = {f.__name__: f for f in (fastq_render, fasta_wrap, qual_render, fastq_scan, fasta_scan, fastq_mates_scan, qual_scan, tiers_written, samples_written, reports_written, stream_counters)}

_REBASED = "array_to_string(list_transform(q, lambda x: chr(CAST(least(126, greatest(x, 0) + 33) AS INTEGER))), '')"
ORACLES = {
    "fastq_render": f"WITH {SCORED} SELECT read_ord, '@' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || {_REBASED} AS record FROM scored",
    "fasta_wrap": f"WITH {READS} SELECT read_ord, '>' || read_id || chr(10) || CASE WHEN n > 80 THEN substr(seq, 1, 80) || chr(10) || substr(seq, 81) ELSE seq END AS record FROM reads",
    "qual_render": f"WITH {SCORED} SELECT read_ord, '>' || read_id || chr(10) || array_to_string(q[1:80], ' ') || CASE WHEN n > 80 THEN chr(10) || array_to_string(q[81:160], ' ') ELSE '' END AS record FROM scored",
    "fastq_scan": f"WITH {SCORED} SELECT regexp_extract(read_id, '^\\S*') AS read_id, seq, {_REBASED} AS quality FROM scored WHERE read_id <> ''",
    "fasta_scan": "SELECT regexp_extract(read_id, '^\\S*') AS read_id, upper(sequence) AS seq FROM fasta_records WHERE sequence <> '' AND read_id <> ''",
    "fastq_mates_scan": f"WITH {READS}, {_JOINED} SELECT coalesce(first, second) AS n, a.seq AS seq1, b.seq AS seq2 FROM p LEFT JOIN reads a ON first = a.read_ord LEFT JOIN reads b ON second = b.read_ord",
    "qual_scan": f"WITH {SCORED} SELECT read_ord, seq, array_to_string(list_transform(q, lambda x: chr(CAST(least(93, greatest(x, 0)) + 33 AS INTEGER))), '') AS quality FROM scored",
    "tiers_written": f"""WITH {_ALL}, {_JOINED}, t AS (SELECT coalesce(a.tier, 'failed') AS t1, coalesce(b.tier, 'failed') AS t2 FROM p LEFT JOIN graded a ON first = a.read_ord LEFT JOIN graded b ON second = b.read_ord),
      m AS (SELECT 1 AS mate, t1 AS mine, t2 AS other FROM t UNION ALL SELECT 2, t2, t1 FROM t) SELECT mine AS stream, CASE WHEN mine = other THEN 'pair' ELSE 'single' END || mate AS slot, count(*) AS n_records FROM m WHERE mine <> 'failed' GROUP BY 1, 2""",
    "samples_written": f"WITH {_ALL} SELECT sample_id, mate, count(*) AS n_records FROM graded WHERE tier = 'green' AND sample_id IS NOT NULL GROUP BY 1, 2",
    "reports_written": f"WITH {_ALL} " + " UNION ALL ".join(f"SELECT mate, '{k}' AS counter, CAST(count(*) FILTER ({c}) AS BIGINT) AS n FROM graded GROUP BY 1" for k, c in _COUNTERS.items()),
    "stream_counters": f"WITH {_ALL} " + " UNION ALL ".join(f"SELECT mate, '{k}' AS counter, CAST(count(*) FILTER ({c}) AS BIGINT) AS n FROM graded GROUP BY 1" for k, c in _COUNTERS.items()),
}
