"""The whole way from raw reads to samples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fs
from ..operators import pipeline, reports
from .base import READS, REVCOMP, SAMPLES, reads, samples, tagged
from .sample_queries import _EXACT, _hits
from .tier_queries import _LADDER, CONFIG

DEMULTIPLEX = replace(CONFIG, primer_errors=0, primer_errors_2=2, need_forward_primer=True, need_reverse_primer=False)
ADAPTERS = ["CATGMAGTTAAGGAAGT", "GGCCRCCTGAATGTCCC"]


def _raw(spark, d: str) -> DataFrame:
    """Reads with their barcode in front, scored high."""
    t = tagged(spark, d)
    high = F.concat(F.repeat(F.chr(F.col("qual_offset") + 40), F.length("tag")), "quality")
    return t.withColumn("quality", high).withColumn("seq", F.col("tagged")).drop("tagged", "tag")


def demultiplexed(spark, d: str) -> DataFrame:
    g = pipeline.demultiplexed(_raw(spark, d), samples(spark, d), DEMULTIPLEX)
    return g.select("read_ord", "sample_id", "tier", "length", "seq")


def demultiplexed_accepted(spark, d: str) -> DataFrame:
    g = pipeline.demultiplexed(_raw(spark, d), samples(spark, d), DEMULTIPLEX).filter("sample_id IS NOT NULL")
    return reports.accepted_by(g, ["sample_id"]).withColumn("accepted", F.round("accepted", 6))


def seed_reads(spark, d: str) -> DataFrame:
    g = pipeline.demultiplexed(_raw(spark, d), samples(spark, d), DEMULTIPLEX, quality_filter=False)
    return g.groupBy("tier").agg(F.count("*").alias("n"), F.sum("length").alias("n_bases"))


def reoriented(spark, d: str) -> DataFrame:
    """Every second read was turned before."""
    r = reads(spark, d).join(samples(spark, d).select("sample_id", "forward_primer"), "sample_id").filter("forward_primer <> ''")
    odd = F.col("read_ord") % 2 == 1
    r = r.withColumn("seq", F.when(odd, fs.revcomp(F.col("seq"))).otherwise(F.col("seq")))
    return pipeline.reoriented(r, "forward_primer", 0).select("read_ord", "seq", "turned")


def adapters_clipped(spark, d: str) -> DataFrame:
    return pipeline.clip_adapters(reads(spark, d), ADAPTERS).select("read_ord", "seq", "n_clipped")


QUERIES = {f.__name__: f for f in (demultiplexed, demultiplexed_accepted, seed_reads, reoriented, adapters_clipped)}

_P = "p AS (SELECT * FROM b WHERE forward_primer <> '')"
_RANGE = "range(0, 22)"
_CUT = f"""{_EXACT.replace('reads AS', 'raw AS', 1).replace('FROM reads) WHERE tag', 'FROM raw) WHERE tag')},
  b AS (SELECT read_ord, e.sample_idx, s.sample_id, forward_primer, reverse_primer, CASE WHEN e.start IS NULL THEN tagged ELSE substr(tagged, e.start + 11) END AS seq,
    CASE WHEN e.start IS NULL THEN repeat(chr(qual_offset + 40), 10) || quality ELSE substr(repeat(chr(qual_offset + 40), 10) || quality, e.start + 11) END AS quality, qual_offset, mate, seq_run, file_name, header, read_id,
    length(tagged) - coalesce(e.start + 10, 0) AS n FROM tagged LEFT JOIN e USING (read_ord) LEFT JOIN samples s ON e.sample_idx = s.sample_idx),
  {_P}, f1 AS ({_hits('p', 'forward_primer', _RANGE, 0, 0.5, 'min')}), f2 AS ({_hits('p', 'forward_primer', _RANGE, 2, 0.5, 'min')}),
  cut1 AS (SELECT b.*, f1.start IS NULL AND forward_primer <> '' AS second, coalesce(f1.start, f2.start) + length(forward_primer) AS behind FROM b LEFT JOIN f1 USING (read_ord) LEFT JOIN f2 USING (read_ord)),
  cut2 AS (SELECT * REPLACE (substr(seq, CAST(coalesce(behind, 0) + 1 AS BIGINT)) AS seq, substr(quality, CAST(coalesce(behind, 0) + 1 AS BIGINT)) AS quality, n - coalesce(behind, 0) AS n), {REVCOMP.format('reverse_primer')} AS rc FROM cut1),
  q AS (SELECT * FROM cut2 WHERE reverse_primer <> ''), r1 AS ({_hits('q', 'rc', 'range(CAST(ceil(n * 0.75) AS BIGINT), greatest(CAST(ceil(n * 0.75) AS BIGINT), n - length(rc) + 1))', 0, 0.9, 'max')}),
  reads AS (SELECT c.* REPLACE (CASE WHEN start IS NULL THEN seq ELSE substr(seq, 1, CAST(start AS BIGINT)) END AS seq, CASE WHEN start IS NULL THEN quality ELSE substr(quality, 1, CAST(start AS BIGINT)) END AS quality, coalesce(start, n) AS n) FROM cut2 c LEFT JOIN r1 USING (read_ord)),
  scored AS (SELECT *, list_transform(string_split(quality, ''), lambda c: CAST(unicode(c) - qual_offset AS BIGINT)) AS q FROM reads),
  {_LADDER}, tiers AS (SELECT r.read_ord, r.sample_id, r.seq, CASE WHEN r.sample_idx IS NULL THEN 'unassigned' WHEN coalesce(g.tier, 'failed') = 'green' AND coalesce(second, false) THEN 'yellow' ELSE coalesce(g.tier, 'failed') END AS tier, CAST(coalesce(g.length, r.n) AS INTEGER) AS length, coalesce(second, false) AS second
    FROM reads r LEFT JOIN graded g USING (read_ord))"""

ORACLES = {
    "demultiplexed": f"WITH {_CUT} SELECT read_ord, sample_id, tier, length, seq FROM tiers",
    "demultiplexed_accepted": f"WITH {_CUT} SELECT sample_id, count(*) AS n_reads, count(*) FILTER (tier = 'green') AS n_green, count(*) FILTER (tier = 'yellow') AS n_yellow, count(*) FILTER (tier = 'failed') AS n_failed, round(count(*) FILTER (tier = 'green') / count(*), 6) AS accepted FROM tiers WHERE sample_id IS NOT NULL GROUP BY 1",
    "seed_reads": f"WITH {_CUT} SELECT CASE WHEN sample_idx IS NULL THEN 'unassigned' WHEN coalesce(second, false) THEN 'yellow' ELSE 'green' END AS tier, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_bases FROM reads GROUP BY 1",
    "reoriented": f"""WITH {READS}, {SAMPLES}, t AS (SELECT r.* REPLACE (CASE WHEN read_ord % 2 = 1 THEN {REVCOMP.format('seq')} ELSE seq END AS seq), forward_primer FROM reads r JOIN samples USING (sample_id) WHERE forward_primer <> ''),
      h AS ({_hits('t', 'forward_primer', _RANGE, 0, 0.5, 'min')}), u AS (SELECT * REPLACE ({REVCOMP.format('seq')} AS seq) FROM t), g AS ({_hits('u', 'forward_primer', _RANGE, 0, 0.5, 'min')})
      SELECT t.read_ord, CASE WHEN h.start IS NULL AND g.start IS NOT NULL THEN {REVCOMP.format('t.seq')} ELSE t.seq END AS seq, h.start IS NULL AND g.start IS NOT NULL AS turned FROM t LEFT JOIN h USING (read_ord) LEFT JOIN g USING (read_ord)""",
    "adapters_clipped": f"""WITH {READS}, a AS (SELECT *, '{ADAPTERS[0]}' AS x, '{ADAPTERS[1]}' AS y FROM reads), h AS ({_hits('a', 'x', 'range(0, 40)', 1, 0.5, 'min')}),
      b AS (SELECT a.* REPLACE (substr(seq, CAST(coalesce(start + 17, 0) + 1 AS BIGINT)) AS seq, n - coalesce(start + 17, 0) AS n), CASE WHEN start IS NULL THEN 0 ELSE 1 END AS c FROM a LEFT JOIN h USING (read_ord)), k AS ({_hits('b', 'y', 'range(0, 40)', 1, 0.5, 'min')})
      SELECT read_ord, substr(seq, CAST(coalesce(start + 17, 0) + 1 AS BIGINT)) AS seq, CAST(c + CASE WHEN start IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_clipped FROM b LEFT JOIN k USING (read_ord)""",
}
