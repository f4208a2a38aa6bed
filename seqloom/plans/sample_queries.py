"""Queries that assign reads to samples and find primers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions import sequence as fs
from ..operators import samples as op
from .base import READS, REVCOMP, SAMPLES, TAGGED, reads, samples, tagged


def _primed(spark, d: str) -> DataFrame:
    """Reads with the primers of their sample."""
    return reads(spark, d).join(samples(spark, d).select("sample_id", "forward_primer", "reverse_primer"), "sample_id")


def iupac_primer_match(spark, d: str) -> DataFrame:
    return _primed(spark, d).filter("forward_primer <> ''").select("read_ord", matching.match_forward(F.col("seq"), F.col("forward_primer"), 1, 10).alias("start"))


def iupac_primer_match_reverse(spark, d: str) -> DataFrame:
    p = _primed(spark, d).filter("reverse_primer <> ''").withColumn("rc", fs.revcomp(F.col("reverse_primer")))
    return p.select("read_ord", matching.match_reverse(F.col("seq"), F.col("rc"), 3).alias("start"))


def mismatch_scan(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", matching.match_forward(F.col("seq"), F.lit("CATGAAGTTAAGG"), 4, 12, plain=True).alias("start"))


def primer_cut(spark, d: str) -> DataFrame:
    """The read behind its primer; a second try with more errors makes it a second-rate find."""
    p = _primed(spark, d).filter("forward_primer <> ''")
    first = matching.match_forward(F.col("seq"), F.col("forward_primer"), 0, 10)
    second = matching.match_forward(F.col("seq"), F.col("forward_primer"), 2, 10)
    p = p.withColumn("a", first).withColumn("b", F.when(F.col("a") < 0, second).otherwise(F.col("a")))
    found = F.when(F.col("a") >= 0, "first").when(F.col("b") >= 0, "second").otherwise("none")
    behind = F.when(F.col("b") >= 0, F.substr("seq", F.col("b") + F.length("forward_primer") + 1)).otherwise(F.col("seq"))
    return p.select("read_ord", found.alias("found"), behind.alias("seq"))


def barcode_exact(spark, d: str) -> DataFrame:
    return op.by_barcode(tagged(spark, d), samples(spark, d), "tagged").select("read_ord", "sample_idx", "start")


def barcode_exact_join(spark, d: str) -> DataFrame:
    return op.barcode_join(tagged(spark, d), samples(spark, d), "tagged", "read_ord").select("read_ord", "sample_idx", "start")


def barcode_fuzzy(spark, d: str) -> DataFrame:
    found = op.by_barcode(tagged(spark, d), samples(spark, d), "tagged", 2, 2)
    return found.select("read_ord", "sample_idx", "mismatches", "candidates")


def dual_barcode(spark, d: str) -> DataFrame:
    t = tagged(spark, d).withColumn("pair", F.concat("seq_run", fs.pair_stem(F.col("read_id")))).dropDuplicates(["pair", "mate"])
    return op.by_two_barcodes(t.filter("mate = 1"), t.filter("mate = 2"), samples(spark, d), "pair", "tag").groupBy("sample_idx").agg(F.count("*").alias("n_pairs"))


def _headed(spark, d: str) -> DataFrame:
    """Reads as a machine writes them that puts the token of the sample before the id."""
    token = samples(spark, d).select("sample_id", F.col("sample_id_in_head").alias("_t"))
    r = reads(spark, d).drop("header").join(token, "sample_id").drop("sample_id")
    return r.withColumn("header", F.concat(F.coalesce("_t", F.lit("")), "read_id")).drop("_t")


def header_sample(spark, d: str) -> DataFrame:
    return op.by_header(_headed(spark, d), samples(spark, d)).select("read_ord", "sample_idx", "token")


def file_sample(spark, d: str) -> DataFrame:
    return op.by_file(reads(spark, d), samples(spark, d)).select("read_ord", "sample_idx")


def barcode_strand_vote(spark, d: str) -> DataFrame:
    return op.strand_votes(tagged(spark, d), samples(spark, d), "tagged")


def barcode_removed(spark, d: str) -> DataFrame:
    found = op.by_barcode(tagged(spark, d), samples(spark, d), "tagged").filter("sample_idx IS NOT NULL")
    return found.select("read_ord", F.substr("tagged", F.col("start") + 11).alias("seq"))


def header_rewrite(spark, d: str) -> DataFrame:
    found = op.by_barcode(tagged(spark, d).drop("sample_id"), samples(spark, d), "tagged", 2, 2).filter("sample_idx IS NOT NULL")
    named = found.join(samples(spark, d).select("sample_idx", "sample_id", "barcode_sequence"), "sample_idx")
    seen = F.substr("tagged", F.col("start") + 1, F.lit(10))
    return named.select("read_ord", fs.barcode_header(F.col("sample_id"), "___", F.col("read_id"), seen, F.col("barcode_sequence"), F.col("mismatches")).alias("header"))


def header_sample_rewrite(spark, d: str) -> DataFrame:
    found = op.by_header(_headed(spark, d), samples(spark, d)).filter("sample_idx IS NOT NULL")
    named = found.join(samples(spark, d).select("sample_idx", "sample_id"), "sample_idx")
    return named.select("read_ord", fs.head_sample_header(F.col("sample_id"), "___", F.col("header"), F.col("token")).alias("header"))


def combined_samples(spark, d: str) -> DataFrame:
    counts = reads(spark, d).groupBy("sample_id").agg(F.count("*").alias("n_reads"))
    return op.combined(counts, samples(spark, d), "n_reads")


def sample_map_problems(spark, d: str) -> DataFrame:
    return op.map_problems(samples(spark, d))


def file_groups(spark, d: str) -> DataFrame:
    """Files in the order in which they are read, with their samples."""
    f = op.files_of(samples(spark, d)).groupBy("sequencing_run", "file_name").agg(F.count("*").alias("n_samples"))
    return f.orderBy("sequencing_run", "file_name")


QUERIES = {f.__name__: f for f in (iupac_primer_match, iupac_primer_match_reverse, mismatch_scan, primer_cut, barcode_exact, barcode_exact_join, barcode_fuzzy, dual_barcode, header_sample, file_sample, barcode_strand_vote, barcode_removed, header_rewrite, header_sample_rewrite, combined_samples, sample_map_problems, file_groups)}

_STANDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fs.STANDS_FOR.items()) + "}"
_STANDS_SQL = _STANDS.replace("{", "{{").replace("}", "}}")
_MATCH = f"CASE WHEN contains('ACGT', {{a}}) THEN contains({_STANDS_SQL}[{{b}}], {{a}}) WHEN contains('ACGT', {{b}}) THEN contains({_STANDS_SQL}[{{a}}], {{b}}) ELSE false END"


def _hits(source: str, pattern: str, offsets: str, errors: int, solid: float, best: str) -> str:
    """read_ord, start: the first or last start of `pattern` (columns of `source`), null without one."""
    match = _MATCH.format(a="substr(seq, CAST(o + k AS BIGINT), 1)", b=f"substr({pattern}, CAST(k AS BIGINT), 1)")
    return f"""SELECT read_ord, {best}(o) AS start FROM (SELECT *, unnest({offsets}) AS o FROM {source})
      WHERE o >= 0 AND o + length({pattern}) <= n AND list_sum(list_transform(range(1, length({pattern}) + 1), lambda k: CASE WHEN {match} THEN 0 ELSE 1 END)) <= {errors}
        AND length(replace(substr(seq, CAST(o + 1 AS BIGINT), length({pattern})), 'N', '')) >= greatest(1, floor({solid} * length({pattern}))) GROUP BY 1"""


_PRIMED = f"{READS}, {SAMPLES}, primed AS (SELECT r.*, forward_primer, {REVCOMP.format('reverse_primer')} AS rc, reverse_primer FROM reads r JOIN samples USING (sample_id))"
_EXACT = f"{TAGGED}, {SAMPLES}, o AS (SELECT read_ord, o, sample_idx FROM (SELECT read_ord, tagged, unnest(range(0, 14)) AS o FROM tagged) t JOIN samples ON substr(tagged, o + 1, 10) = barcode_sequence), e AS (SELECT read_ord, arg_min(sample_idx, o) AS sample_idx, min(o) AS start FROM o GROUP BY 1)"
_FUZZY = f"""{TAGGED}, {SAMPLES}, w AS (SELECT read_ord, o, substr(tagged, o + 1, 10) AS w FROM (SELECT read_ord, tagged, unnest(range(0, 2)) AS o FROM tagged)),
  e AS (SELECT read_ord, arg_min(sample_idx, o) AS sample_idx, min(o) AS o FROM w JOIN samples ON w = barcode_sequence GROUP BY 1),
  f AS (SELECT read_ord, sample_idx, min(o) AS o, arg_min(hamming(w, barcode_sequence), o) AS far FROM w JOIN samples ON length(w) = 10 AND length(barcode_sequence) = 10 AND hamming(w, barcode_sequence) <= 2 WHERE read_ord NOT IN (SELECT read_ord FROM e) GROUP BY 1, 2),
  g AS (SELECT read_ord, count(*) AS c, min(sample_idx) AS s, min(o) AS o, min(far) AS far FROM f GROUP BY 1),
  found AS (SELECT t.*, CASE WHEN e.read_ord IS NOT NULL THEN e.sample_idx WHEN c = 1 THEN s END AS idx, CASE WHEN e.read_ord IS NOT NULL THEN 0 WHEN c = 1 THEN far END AS mismatches,
    CASE WHEN e.read_ord IS NOT NULL THEN 1 ELSE coalesce(c, 0) END AS candidates, coalesce(e.o, g.o) AS start FROM tagged t LEFT JOIN e USING (read_ord) LEFT JOIN g USING (read_ord))"""
_FILES = f"{SAMPLES}, files AS (SELECT sample_idx, sequencing_run, unnest(string_split_regex(fastq_file, '\\s*[,;]\\s*')) AS file_name FROM samples)"
_HEAD = "d AS (SELECT read_ord, coalesce(sample_id_in_head, '') || read_id AS head FROM reads JOIN samples USING (sample_id)), h AS (SELECT read_ord, min(sample_idx) AS sample_idx FROM d JOIN samples ON sample_id_in_head <> '' AND contains(head, sample_id_in_head) GROUP BY 1)"
_STEM = "regexp_replace(regexp_extract(read_id, '^[^ \\t]*'), '([/.][12]|#[12]:0)$', '')"

ORACLES = {
    "iupac_primer_match": f"WITH {_PRIMED}, p AS (SELECT * FROM primed WHERE forward_primer <> ''), h AS ({_hits('p', 'forward_primer', 'range(0, 10)', 1, 0.5, 'min')}) SELECT read_ord, CAST(coalesce(start, -1) AS INTEGER) AS start FROM p LEFT JOIN h USING (read_ord)",
    "iupac_primer_match_reverse": f"WITH {_PRIMED}, p AS (SELECT * FROM primed WHERE reverse_primer <> ''), h AS ({_hits('p', 'rc', 'range(CAST(ceil(n * 0.75) AS BIGINT), greatest(CAST(ceil(n * 0.75) AS BIGINT), n - length(rc) + 1))', 3, 0.9, 'max')}) SELECT read_ord, CAST(coalesce(start, -1) AS INTEGER) AS start FROM p LEFT JOIN h USING (read_ord)",
    "mismatch_scan": f"WITH {READS}, h AS (SELECT read_ord, min(o) AS start FROM (SELECT read_ord, seq, n, unnest(range(0, 12)) AS o FROM reads) WHERE o + 13 <= n AND hamming(substr(seq, o + 1, 13), 'CATGAAGTTAAGG') <= 4 AND length(replace(substr(seq, o + 1, 13), 'N', '')) >= 1 GROUP BY 1) SELECT read_ord, CAST(coalesce(start, -1) AS INTEGER) AS start FROM reads LEFT JOIN h USING (read_ord)",
    "primer_cut": f"""WITH {_PRIMED}, p AS (SELECT * FROM primed WHERE forward_primer <> ''), a AS ({_hits('p', 'forward_primer', 'range(0, 10)', 0, 0.5, 'min')}), b AS ({_hits('p', 'forward_primer', 'range(0, 10)', 2, 0.5, 'min')}),
      x AS (SELECT read_ord, seq, forward_primer, a.start AS a, coalesce(a.start, b.start) AS b FROM p LEFT JOIN a USING (read_ord) LEFT JOIN b USING (read_ord))
      SELECT read_ord, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'none' END AS found, CASE WHEN b IS NOT NULL THEN substr(seq, CAST(b + length(forward_primer) + 1 AS BIGINT)) ELSE seq END AS seq FROM x""",
    "barcode_exact": f"WITH {_EXACT} SELECT t.read_ord, e.sample_idx, CAST(e.start AS INTEGER) AS start FROM tagged t LEFT JOIN e USING (read_ord)",
    "barcode_exact_join": f"WITH {_EXACT} SELECT t.read_ord, e.sample_idx, CAST(e.start AS INTEGER) AS start FROM tagged t LEFT JOIN e USING (read_ord)",
    "barcode_fuzzy": f"WITH {_FUZZY} SELECT read_ord, idx AS sample_idx, CAST(mismatches AS INTEGER) AS mismatches, CAST(candidates AS INTEGER) AS candidates FROM found",
    "dual_barcode": f"WITH {TAGGED}, {SAMPLES}, t AS (SELECT DISTINCT seq_run || {_STEM} AS pair, mate, tag FROM tagged) SELECT sample_idx, count(*) AS n_pairs FROM (SELECT a.tag AS c1, b.tag AS c2 FROM t a JOIN t b USING (pair) WHERE a.mate = 1 AND b.mate = 2) JOIN samples ON barcode_sequence = c1 AND (coalesce(barcode2nd_pair, '') IN ('', c2)) GROUP BY 1",
    "header_sample": f"WITH {READS}, {SAMPLES}, {_HEAD} SELECT r.read_ord, h.sample_idx, s.sample_id_in_head AS token FROM d r LEFT JOIN h USING (read_ord) LEFT JOIN samples s ON h.sample_idx = s.sample_idx",
    "file_sample": f"WITH {READS}, {_FILES}, one AS (SELECT file_name, min(sample_idx) AS sample_idx FROM files GROUP BY 1 HAVING count(*) = 1) SELECT read_ord, sample_idx FROM reads LEFT JOIN one USING (file_name)",
    "barcode_strand_vote": f"WITH {TAGGED}, {SAMPLES}, o AS (SELECT read_ord, substr(tagged, o + 1, 10) AS w FROM (SELECT read_ord, tagged, unnest(range(0, 14)) AS o FROM tagged)), v AS (SELECT (SELECT count(DISTINCT read_ord) FROM o JOIN samples ON w = barcode_sequence) AS forward, (SELECT count(DISTINCT read_ord) FROM o JOIN samples ON w = {REVCOMP.format('barcode_sequence')}) AS reverse) SELECT forward, reverse, forward + reverse > 5000 AND reverse > 8 * forward AS swap FROM v",
    "barcode_removed": f"WITH {_EXACT} SELECT read_ord, substr(tagged, start + 11) AS seq FROM tagged JOIN e USING (read_ord)",
    "header_rewrite": f"WITH {_FUZZY} SELECT read_ord, s.sample_id || '___' || regexp_extract(read_id, '^\\S*') || ' orig_bc=' || substr(tagged, start + 1, 10) || CASE WHEN mismatches > 0 THEN ' new_bc=' || barcode_sequence || ' bc_diffs=' || mismatches ELSE '' END AS header FROM found JOIN samples s ON idx = s.sample_idx",
    "header_sample_rewrite": f"WITH {READS}, {SAMPLES}, {_HEAD} SELECT read_ord, s.sample_id || '___' || replace(head, sample_id_in_head, '') || ' orig_hdPart=' || sample_id_in_head AS header FROM d r JOIN h USING (read_ord) JOIN samples s ON h.sample_idx = s.sample_idx",
    "combined_samples": f"WITH {READS}, {SAMPLES} SELECT coalesce(nullif(combine_samples, ''), s.sample_id) AS \"group\", CAST(count(*) AS BIGINT) AS n_reads FROM reads r JOIN samples s ON r.sample_id = s.sample_id GROUP BY 1",
    "sample_map_problems": f"""WITH {_FILES}, v AS (SELECT 'sample id' AS problem, sample_id AS value FROM samples UNION ALL SELECT 'barcode', concat_ws('+', nullif(barcode_sequence, ''), nullif(barcode2nd_pair, '')) FROM samples UNION ALL SELECT 'header token', sample_id_in_head FROM samples)
      SELECT problem, value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'file in several runs', file_name, count(DISTINCT sequencing_run) FROM files WHERE file_name <> '' GROUP BY 2 HAVING count(DISTINCT sequencing_run) > 1""",
    "file_groups": f"WITH {_FILES} SELECT sequencing_run, file_name, count(*) AS n_samples FROM files WHERE file_name <> '' GROUP BY 1, 2",
}
