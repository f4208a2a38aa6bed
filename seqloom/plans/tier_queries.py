"""Queries of the tier decision and the reports over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.config import FilterConfig
from ..operators.tiers import with_tier
from .base import ERROR, SCORED, measured, reads, samples

CONFIG = FilterConfig(
    min_length=100, min_length_2=60, max_length=1000, min_quality=27, min_quality_2=22, max_ambiguous=0, max_ambiguous_2=2, window_threshold=20, window_threshold_2=12,
    window_width=20, trim_width=15, trim_threshold=20, max_accumulated_error=1.0, max_accumulated_error_2=3.0, max_run=8, trim_run=0,
)


def graded(spark, d: str) -> DataFrame:
    return with_tier(reads(spark, d), CONFIG)


def tier_ladder(spark, d: str) -> DataFrame:
    g = graded(spark, d)
    return g.select("read_ord", "tier", "length", F.round("mean_quality", 6).alias("mean_quality"))


def reject_reasons(spark, d: str) -> DataFrame:
    return reports.counters(graded(spark, d))


def accepted_per_sample(spark, d: str) -> DataFrame:
    """Every sample of the map, those without reads with null shares."""
    counted = reports.accepted_by(graded(spark, d).filter("sample_id IS NOT NULL"), ["sample_id"])
    listed = samples(spark, d).select("sample_idx", "sample_id")
    joined = listed.join(counted, "sample_id", "left").fillna(0, ["n_reads", "n_green", "n_yellow", "n_failed"])
    return joined.withColumn("accepted", F.round("accepted", 6))


def accepted_per_file(spark, d: str) -> DataFrame:
    g = graded(spark, d).groupBy("file_name").agg(F.count("*").alias("n_reads"), F.count_if(F.col("tier") != "failed").alias("n_accepted"), F.count_if(F.col("window_trimmed") | F.col("error_trimmed")).alias("n_trimmed"))
    share = lambda c: F.round(100 * F.col(c) / F.col("n_reads"), 4)
    return g.select("file_name", "n_reads", share("n_accepted").alias("accepted_percent"), share("n_trimmed").alias("trimmed_percent"))


def length_histogram(spark, d: str) -> DataFrame:
    return reports.histogram(graded(spark, d).filter("tier <> 'failed'"), F.col("length"), ["mate"])


def quality_histogram(spark, d: str) -> DataFrame:
    return reports.histogram(measured(spark, d, "average"), F.floor(F.col("average") + 0.5), ["mate"])


def histogram_median(spark, d: str) -> DataFrame:
    h = reports.histogram(reads(spark, d), F.length("seq"), ["seq_run"])
    return reports.histogram_median(h, ["seq_run"])


def read_summary(spark, d: str) -> DataFrame:
    s = reports.summary(measured(spark, d, "average", "accumulated_error").withColumn("n", F.length("seq")), ["seq_run", "mate"], "n", "average", "accumulated_error")
    return s.select("seq_run", "mate", "n_reads", "min_length", "max_length", *[F.round(c, 4).alias(c) for c in ("mean_length", "mean_quality", "mean_error")])


def run_quality_score(spark, d: str) -> DataFrame:
    s = reports.run_score(measured(spark, d, "average").withColumn("n", F.length("seq")), ["seq_run"], "n", "average", 100, 27)
    return s.select("seq_run", F.round("score", 5).alias("score"))


def gc_table(spark, d: str) -> DataFrame:
    t = reports.base_table(reads(spark, d), ["sample_id"])
    return t.select("sample_id", "base", "n", F.round("share", 6).alias("share"))


def length_vs_quality(spark, d: str) -> DataFrame:
    return measured(spark, d, "average", "median").select("read_ord", F.length("seq").alias("length"), F.round("average", 4).alias("average"), "median")


QUERIES = {f.__name__: f for f in (accepted_per_sample, tier_ladder, reject_reasons, accepted_per_file, length_histogram, quality_histogram, histogram_median, read_summary, run_quality_score, gc_table, length_vs_quality)}

_W, _T = CONFIG.trim_width, int(CONFIG.trim_width * CONFIG.trim_threshold)
_LADDER = f"""c AS (SELECT read_ord, n, i, sum(q[i]) OVER w AS cum, sum({ERROR.format('q[i]')}) OVER w AS err, sum(q[i]) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS s15, sum(q[i]) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20
   FROM (SELECT read_ord, n, q, unnest(range(1, n + 1)) AS i FROM scored) WINDOW w AS (PARTITION BY read_ord ORDER BY i)),
 t1 AS (SELECT read_ord, n, max(CASE WHEN i = n THEN s15 END) AS last, max(CASE WHEN i >= 15 AND s15 >= {_T} AND i - 15 > greatest(n // 4, 15) AND i < n THEN i - 15 END) AS good FROM c GROUP BY 1, 2),
 t2 AS (SELECT read_ord, n, n < 60 AS gone, n BETWEEN 60 AND 99 AS shortish, CASE WHEN n < 60 OR n <= 15 OR last > {_T} THEN n ELSE greatest(0, coalesce(good + 1, least(greatest(n // 4, 15) + 1, n - 15)) - 7) END AS l1 FROM t1),
 e3 AS (SELECT read_ord, min(CASE WHEN err >= 1.0 THEN i END) - 1 AS e1, min(CASE WHEN err >= 3.0 THEN i END) - 1 AS e2 FROM t2 JOIN c USING (read_ord) WHERE i <= l1 GROUP BY 1),
 t3 AS (SELECT t2.*, coalesce(e1, l1) AS b1, coalesce(e2, l1) AS b2 FROM t2 LEFT JOIN e3 USING (read_ord)),
 t4 AS (SELECT *, b1 < 100 AS low, CASE WHEN b1 >= 100 AND NOT gone THEN b1 ELSE l1 END AS l2, NOT gone AND l1 < n AS window_trimmed, NOT gone AND b1 >= 100 AND b1 < l1 AS error_trimmed FROM t3),
 e5 AS (SELECT read_ord, max(CASE WHEN i = l2 THEN cum END) AS total, bool_or(i >= 21 AND s20 < 400) AS p1, bool_or(i >= 21 AND s20 < 240) AS p2 FROM t4 JOIN c USING (read_ord) WHERE i <= l2 GROUP BY 1),
 t5 AS (SELECT t4.*, coalesce(total / nullif(l2, 0), 0) AS mean, coalesce(p1, false) AS p1, coalesce(p2, false) AS p2 FROM t4 LEFT JOIN e5 USING (read_ord)),
 t6 AS (SELECT t5.*, s.mate, s.sample_id, s.file_name, length(regexp_replace(substr(s.seq, 1, CAST(l2 AS BIGINT)), '[ACGT]', '', 'g')) AS odd, regexp_matches(substr(s.seq, 1, CAST(l2 AS BIGINT)), '{'|'.join(b + '{8}' for b in 'ACGTRYMKWSBDHVN')}') AS run FROM t5 JOIN scored s USING (read_ord)),
 g1 AS (SELECT *, low AND b2 < 60 AS f_acc, p1 AND p2 AS f_win, (CASE WHEN p1 THEN 0 ELSE mean END < 27 OR p1) AND CASE WHEN p2 THEN 0 ELSE mean END < 22 AS f_q, CASE WHEN p1 THEN 0 ELSE mean END < 27 AS lowq FROM t6),
 graded AS (SELECT *, CASE WHEN gone OR f_acc OR f_win OR f_q OR run OR odd >= 2 THEN 'failed' WHEN shortish OR low OR p1 OR lowq OR odd > 0 THEN 'yellow' ELSE 'green' END AS tier, l2 AS length,
   gone OR shortish AS r_short, NOT gone AND low AS r_acc, NOT gone AND NOT f_acc AND p1 AS r_win, NOT gone AND NOT f_acc AND NOT f_win AND (f_q OR (lowq AND NOT p1)) AS r_q,
   NOT (gone OR f_acc OR f_win OR f_q) AND run AS r_run, NOT (gone OR f_acc OR f_win OR f_q OR run) AND odd > 0 AS r_odd FROM g1)"""
_ALL = f"{SCORED}, {_LADDER}"
_COUNTERS = {"total": "true", "green": "tier = 'green'", "yellow": "tier = 'yellow'", "failed": "tier = 'failed'", **{k: f"tier = 'failed' AND {c}" for k, c in {"short": "r_short", "long": "n > 1000", "accumulated_error": "r_acc", "low_quality": "r_q", "window": "r_win", "binomial": "false", "homopolymer": "r_run", "ambiguous": "r_odd"}.items()}, "tail_trimmed": "false", "window_trimmed": "window_trimmed", "error_trimmed": "error_trimmed"}
_HIST = "{e} AS (SELECT {k}, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1), k AS (SELECT {k}, bin, count(*) AS n FROM b GROUP BY 1, 2)"
_MEASURED = SCORED + f", m AS (SELECT *, list_sum(q) / n AS average, list_sort(q)[n // 2 + 1] AS median, coalesce(list_sum(list_transform(list_filter(q, lambda x: x >= 0), lambda x: {ERROR.format('x')})), 0) AS acc FROM scored)"

ORACLES = {
    "tier_ladder": f"WITH {_ALL} SELECT read_ord, tier, CAST(length AS INTEGER) AS length, round(CAST(mean AS DOUBLE), 6) AS mean_quality FROM graded",
    "reject_reasons": f"WITH {_ALL} " + " UNION ALL ".join(f"SELECT mate, '{k}' AS counter, CAST(count(*) FILTER ({c}) AS BIGINT) AS n FROM graded GROUP BY 1" for k, c in _COUNTERS.items()),
    "accepted_per_sample": f"WITH {_ALL}, a AS (SELECT sample_id, count(*) AS n_reads, count(*) FILTER (tier = 'green') AS n_green, count(*) FILTER (tier = 'yellow') AS n_yellow, count(*) FILTER (tier = 'failed') AS n_failed FROM graded GROUP BY 1) SELECT s.sample_id, sample_idx, coalesce(n_reads, 0) AS n_reads, coalesce(n_green, 0) AS n_green, coalesce(n_yellow, 0) AS n_yellow, coalesce(n_failed, 0) AS n_failed, round(n_green / n_reads, 6) AS accepted FROM sample_map s LEFT JOIN a USING (sample_id)",
    "accepted_per_file": f"WITH {_ALL} SELECT file_name, count(*) AS n_reads, round(100 * count(*) FILTER (tier <> 'failed') / count(*), 4) AS accepted_percent, round(100 * count(*) FILTER (window_trimmed OR error_trimmed) / count(*), 4) AS trimmed_percent FROM graded GROUP BY 1",
    "length_histogram": f"WITH {_ALL}, b AS (SELECT mate, CAST(length AS INTEGER) AS bin FROM graded WHERE tier <> 'failed'), {_HIST.format(e='e', k='mate')} SELECT mate, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM e LEFT JOIN k USING (mate, bin)",
    "quality_histogram": f"WITH {_MEASURED}, b AS (SELECT mate, CAST(floor(average + 0.5) AS INTEGER) AS bin FROM m), {_HIST.format(e='e', k='mate')} SELECT mate, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM e LEFT JOIN k USING (mate, bin)",
    "histogram_median": f"WITH {SCORED}, k AS (SELECT seq_run, n AS bin, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY seq_run ORDER BY bin) AS cum, floor(sum(n) OVER (PARTITION BY seq_run) * 0.5) AS half FROM k) SELECT seq_run, CAST(min(bin) AS INTEGER) AS median FROM c WHERE cum >= half GROUP BY 1",
    "read_summary": f"WITH {_MEASURED} SELECT seq_run, mate, count(*) AS n_reads, CAST(min(n) AS INTEGER) AS min_length, CAST(max(n) AS INTEGER) AS max_length, round(avg(n), 4) AS mean_length, round(avg(floor(average)), 4) AS mean_quality, round(avg(acc), 4) AS mean_error FROM m GROUP BY 1, 2",
    "run_quality_score": f"WITH {_MEASURED} SELECT seq_run, round((avg(n) / 100 + avg(average) / 27) / 2, 5) AS score FROM m GROUP BY 1",
    "gc_table": f"WITH {SCORED}, u AS (SELECT sample_id, unnest(['A', 'T', 'G', 'C']) AS base, seq, n FROM scored) SELECT sample_id, base, CAST(sum(n - length(replace(seq, base, ''))) AS BIGINT) AS n, round(sum(n - length(replace(seq, base, ''))) / sum(n), 6) AS share FROM u GROUP BY 1, 2",
    "length_vs_quality": f"WITH {_MEASURED} SELECT read_ord, CAST(n AS INTEGER) AS length, round(average, 4) AS average, CAST(median AS INTEGER) AS median FROM m",
}
