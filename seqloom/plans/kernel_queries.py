"""Queries of the per-read functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as fq
from ..functions import sequence as fs
from .base import ERROR, READS, REVCOMP, SCORED, measured, reads


def revcomp(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", fs.revcomp(F.col("seq")).alias("rc"))


def cut_five_prime(spark, d: str) -> DataFrame:
    r = reads(spark, d)
    return r.select("read_ord", fs.cut(F.col("seq"), 0, 17).alias("seq"), fs.cut(F.col("quality"), 0, 17).alias("quality"), fs.cut(F.col("seq"), 10, 20).alias("inner_cut"))


def average_median_quality(spark, d: str) -> DataFrame:
    return measured(spark, d, "average", "median").select("read_ord", F.round("average", 6).alias("average"), "median")


def accumulated_error(spark, d: str) -> DataFrame:
    return measured(spark, d, "accumulated_error").select("read_ord", F.round("accumulated_error", 6).alias("accumulated_error"))


def error_budget_trim(spark, d: str) -> DataFrame:
    m = measured(spark, d, "budget_position")
    return m.select("read_ord", "budget_position", F.expr("substr(seq, 1, budget_position)").alias("kept"))


def window_trim3(spark, d: str) -> DataFrame:
    return measured(spark, d, "trimmed_length").select("read_ord", "trimmed_length")


def window_reject(spark, d: str) -> DataFrame:
    m = measured(spark, d, "window_poor", "average")
    return m.select("read_ord", "window_poor", F.round(F.when(F.col("window_poor"), 0.0).otherwise(F.col("average")), 6).alias("mean_quality"))


def expected_errors(spark, d: str) -> DataFrame:
    """Bounds over 999 are shown as that: interpolated from a vanishing part of the law, they have no meaning but "too many"."""
    return measured(spark, d, "expected_errors").select("read_ord", F.round(F.least(F.col("expected_errors"), F.lit(999.0)), 6).alias("expected_errors"), (F.col("expected_errors") > 2.5).alias("rejected"))


def ambiguity_homopolymer(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", fs.ambiguous(F.col("seq")).alias("ambiguous"), fs.has_run(F.col("seq"), 8).alias("long_run"))


def tail_homopolymer_trim(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", fs.tail_run(F.col("seq")).alias("tail_run"), fs.tail_kept(F.col("seq"), 4).alias("kept_length"))


def strip_ambiguous(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", fs.strip_ambiguous(F.col("seq")).alias("seq"))


def canonical_output(spark, d: str) -> DataFrame:
    s = F.col("seq")
    return reads(spark, d).select("read_ord", fs.canonical(s).alias("canonical"), fs.canonical(s, "N").alias("masked"), fs.canonical_quality(s, F.col("quality"), F.col("qual_offset")).alias("quality"))


def quality_rebase(spark, d: str) -> DataFrame:
    return reads(spark, d).select("read_ord", fq.rebased(F.col("quality"), F.col("qual_offset")).alias("quality"))


def header_forms(spark, d: str) -> DataFrame:
    h = F.substr(F.col("header"), F.lit(2))
    return reads(spark, d).select("read_ord", fs.pair_stem(h).alias("pair_stem"), fs.slash_mate(h).alias("slash_mate"), fs.header_stem(h).alias("stem"), fs.first_word(h).alias("word"))


def renumber_headers(spark, d: str) -> DataFrame:
    from ..operators.keyed_chunks import number_rows, positioned

    from ..session import table

    scan = positioned(table(spark, d, "fasta_records"), F.lit("all").alias("k"), "rec_ord", "sequence")
    return number_rows(scan, "k").select("rec_ord", F.concat(F.lit("p"), (F.col("_number") + 1).cast("string")).alias("new_id"))


def size_annotation(spark, d: str) -> DataFrame:
    from ..session import table

    f = table(spark, d, "fasta_records").filter("read_id IS NOT NULL")
    r, n = F.col("read_id"), F.col("rec_ord")
    return f.select("rec_ord", fs.size_of(r).alias("size"), fs.without_size(r).alias("bare"), fs.with_size(fs.without_size(r), n).alias("semicolon"), fs.with_size(r, n, "_").alias("underscore"))


def merged_base_quality(spark, d: str) -> DataFrame:
    grid = spark.range(2, 42).select(F.col("id").alias("q1"), F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(41).cast("bigint"))).alias("q2"))
    made = {a: fq.merged_score(F.col("q1").cast("double"), F.col("q2").cast("double"), F.lit(a == "agree")) for a in ("agree", "differ")}
    return grid.select("q1", "q2", *[c.alias(a) for a, c in made.items()])


def ratio_helper(spark, d: str) -> DataFrame:
    from ..session import table

    b = table(spark, d, "barcode_stats").filter("barcode_detected >= 0 AND barcode_detected_fail >= 0")
    x, y = F.col("barcode_detected").cast("double"), F.col("barcode_detected_fail").cast("double")
    return b.select("stat_id", F.round(fs.ratio(x, y), 6).alias("half"), F.round(fs.ratio(x, y, 0.25), 6).alias("quarter"))


QUERIES = {f.__name__: f for f in (revcomp, cut_five_prime, average_median_quality, accumulated_error, error_budget_trim, window_trim3, window_reject, expected_errors, ambiguity_homopolymer, tail_homopolymer_trim, strip_ambiguous, canonical_output, quality_rebase, header_forms, renumber_headers, size_annotation, merged_base_quality, ratio_helper)}

_RUNS = " OR ".join(f"contains(seq, repeat('{b}', 8))" for b in fs.CODES)
_TRIM = f"""WITH {SCORED}, c AS (SELECT read_ord, n, i, sum(q[i]) OVER (PARTITION BY read_ord ORDER BY i) AS cum FROM (SELECT read_ord, n, q, unnest(range(1, n + 1)) AS i FROM scored)),
  w AS (SELECT a.read_ord, a.n, a.i - 15 AS i, CAST(a.cum - coalesce(b.cum, 0) AS BIGINT) AS s FROM c a LEFT JOIN c b ON a.read_ord = b.read_ord AND b.i = a.i - 15 WHERE a.i >= 15),
  t AS (SELECT read_ord, n, max(CASE WHEN i = n - 15 THEN s END) AS last, max(CASE WHEN s >= 300 AND i > greatest(n // 4, 15) AND i < n - 15 THEN i END) AS good FROM w GROUP BY 1, 2)
SELECT read_ord, CAST(CASE WHEN n <= 15 OR last > 300 THEN n ELSE greatest(0, coalesce(good + 1, least(greatest(n // 4, 15) + 1, n - 15)) - 7) END AS INTEGER) AS trimmed_length
FROM (SELECT s.read_ord, s.n, t.last, t.good FROM scored s LEFT JOIN t USING (read_ord))"""

# states of 0 to 4 errors after each base, then the count at which the law passes 1 - 0.005, interpolated
_LAW = "list_reduce(list_transform(q, lambda x: [CASE WHEN x < 0 OR x > 109 THEN 1.0::DOUBLE WHEN x >= 70 THEN 1e-7 ELSE pow(10.0, -x / 10.0) END]), lambda a, p: [a[1] * (1 - p[1]), a[2] * (1 - p[1]) + a[1] * p[1], a[3] * (1 - p[1]) + a[2] * p[1], a[4] * (1 - p[1]) + a[3] * p[1], a[5] * (1 - p[1]) + a[4] * p[1]], [1.0::DOUBLE, 0, 0, 0, 0])"
_EXPECTED = f"""WITH {SCORED}, l AS (SELECT read_ord, n, {_LAW} AS a FROM scored), c AS (SELECT *, a[1] AS c0, a[1] + a[2] AS c1, a[1] + a[2] + a[3] AS c2, a[1] + a[2] + a[3] + a[4] AS c3 FROM l),
  e AS (SELECT read_ord, CASE WHEN n < 3 OR c0 > 0.995 THEN 0.0 WHEN c1 > 0.995 THEN greatest(0, (0.995::DOUBLE - c0) / a[2]) WHEN c2 > 0.995 THEN greatest(0, 1 + (0.995::DOUBLE - c1) / a[3]) WHEN c3 > 0.995 THEN greatest(0, 2 + (0.995::DOUBLE - c2) / a[4])
    ELSE greatest(0, 3 + (0.995::DOUBLE - c3) / CASE WHEN a[5] > 0 THEN a[5] ELSE 1 END) END AS e FROM c)
SELECT read_ord, round(least(CAST(e AS DOUBLE), 999.0::DOUBLE), 6) AS expected_errors, e > 2.5 AS rejected FROM e"""

ORACLES = {
    "expected_errors": _EXPECTED,
    "revcomp": f"WITH {READS} SELECT read_ord, {REVCOMP.format('seq')} AS rc FROM reads",
    "cut_five_prime": f"WITH {READS} SELECT read_ord, substr(seq, 18) AS seq, substr(quality, 18) AS quality, substr(seq, 1, 10) || substr(seq, 21) AS inner_cut FROM reads",
    "average_median_quality": f"WITH {SCORED} SELECT read_ord, round(list_sum(q) / n, 6) AS average, CAST(list_sort(q)[n // 2 + 1] AS INTEGER) AS median FROM scored",
    "accumulated_error": f"WITH {SCORED} SELECT read_ord, round(coalesce(list_sum(list_transform(list_filter(q, lambda x: x >= 0), lambda x: {ERROR.format('x')})), 0), 6) AS accumulated_error FROM scored",
    "error_budget_trim": f"WITH {SCORED}, c AS (SELECT read_ord, i, sum({ERROR.format('q[i]')}) OVER (PARTITION BY read_ord ORDER BY i) AS e FROM (SELECT read_ord, q, unnest(range(1, n + 1)) AS i FROM scored)), f AS (SELECT read_ord, min(i) - 1 AS p FROM c WHERE e >= 1.0 GROUP BY 1) SELECT s.read_ord, CAST(coalesce(p, n) AS INTEGER) AS budget_position, substr(seq, 1, CAST(coalesce(p, n) AS INTEGER)) AS kept FROM scored s LEFT JOIN f USING (read_ord)",
    "window_trim3": _TRIM,
    "window_reject": f"WITH {SCORED}, c AS (SELECT read_ord, n, i, sum(q[i]) OVER (PARTITION BY read_ord ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s FROM (SELECT read_ord, n, q, unnest(range(1, n + 1)) AS i FROM scored)), p AS (SELECT read_ord, bool_or(s < 1250) AS poor FROM c WHERE i >= 51 GROUP BY 1) SELECT s.read_ord, coalesce(poor, false) AS window_poor, round(CASE WHEN poor THEN 0.0 ELSE list_sum(q) / n END, 6) AS mean_quality FROM scored s LEFT JOIN p USING (read_ord)",
    "ambiguity_homopolymer": f"WITH {READS} SELECT read_ord, CAST(length(regexp_replace(seq, '[ACGT]', '', 'g')) AS INTEGER) AS ambiguous, ({_RUNS}) AS long_run FROM reads",
    "tail_homopolymer_trim": f"WITH {READS}, t AS (SELECT read_ord, n, CAST(n - length(rtrim(seq, seq[-1:])) AS INTEGER) AS tail_run FROM reads) SELECT read_ord, tail_run, CAST(CASE WHEN tail_run >= 4 AND 4 < n THEN greatest(1, n - tail_run) ELSE n END AS INTEGER) AS kept_length FROM t",
    "strip_ambiguous": f"WITH {READS} SELECT read_ord, regexp_replace(regexp_replace(seq, '^[^ACGT]+', ''), '[^ACGT]+$', '') AS seq FROM reads",
    "canonical_output": f"WITH {READS} SELECT read_ord, regexp_replace(seq, '[^ACGT]', 'A', 'g') AS canonical, regexp_replace(seq, '[^ACGT]', 'N', 'g') AS masked, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN contains('ACGT', seq[i]) THEN quality[i] ELSE chr(qual_offset) END), '') AS quality FROM reads",
    "quality_rebase": f"WITH {SCORED} SELECT read_ord, array_to_string(list_transform(q, lambda x: chr(CAST(least(126, greatest(x, 0) + 33) AS INTEGER))), '') AS quality FROM scored",
    "header_forms": f"""WITH {READS}, h AS (SELECT read_ord, substr(header, 2) AS h, regexp_extract(substr(header, 2), '^\\S*') AS w FROM reads), p AS (SELECT *, string_split(w, ':') AS p FROM h)
  SELECT read_ord, regexp_replace(regexp_extract(h, '^[^ \\t]*'), '([/.][12]|#[12]:0)$', '') AS pair_stem, regexp_replace(h, '^(\\S+) ([12]):.*$', '\\1/\\2') AS slash_mate,
    CASE WHEN contains(w, '/') THEN string_split(w, '/')[1] WHEN len(p) >= 7 THEN concat_ws(':', p[1], p[4], p[5], p[6], p[7]) WHEN len(p) >= 6 THEN concat_ws(':', p[1], p[3], p[4], p[5], p[6]) ELSE w END AS stem, w AS word FROM p""",
    "renumber_headers": "SELECT rec_ord, 'p' || row_number() OVER (ORDER BY rec_ord) AS new_id FROM fasta_records",
    "size_annotation": """WITH f AS (SELECT rec_ord, read_id, regexp_replace(regexp_replace(read_id, ';(size|seqs)=.*$', ''), '^centroid=', '') AS bare, regexp_extract(read_id, '(;size=|;seqs=|_)(\\d+);?$', 2) AS s FROM fasta_records WHERE read_id IS NOT NULL)
  SELECT rec_ord, CASE WHEN s <> '' THEN CAST(s AS BIGINT) END AS size, bare, bare || ';size=' || rec_ord || ';' AS semicolon, read_id || '_' || rec_ord AS underscore FROM f""",
    "merged_base_quality": """WITH g AS (SELECT a.i AS q1, b.i AS q2, pow(10.0, -a.i / 10.0) AS p, pow(10.0, -b.i / 10.0) AS q FROM range(2, 42) a(i), range(2, 42) b(i))
  SELECT q1, q2, CAST(least(40, round(-10 * log10(p * q / 3 / (1 - p - q + 4 * p * q / 3)))) AS INTEGER) AS agree, CAST(least(40, round(-10 * log10(least(p, q) * (1 - greatest(p, q) / 3) / (p + q - 4 * p * q / 3)))) AS INTEGER) AS differ FROM g""",
    "ratio_helper": """WITH b AS (SELECT stat_id, CAST(barcode_detected AS DOUBLE) AS x, CAST(barcode_detected_fail AS DOUBLE) AS y FROM barcode_stats WHERE barcode_detected >= 0 AND barcode_detected_fail >= 0)
  SELECT stat_id, round(CASE WHEN x + y <= 0 THEN 1.0 ELSE x / (x + y) + 0.5 END, 6) AS half, round(CASE WHEN x + y <= 0 THEN 1.0 ELSE 1 - (1 - (x / (x + y) + 0.5)) * 0.25 END, 6) AS quarter FROM b""",
}
