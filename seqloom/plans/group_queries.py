"""Queries of pairs, dereplication, clusters, representatives and concatemers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as fq
from ..functions import sequence as fs
from ..operators import clusters, concatemers, derep, pairs
from ..operators.keyed_chunks import positioned
from ..operators.representatives import representatives
from ..session import table
from .base import ERROR, READS, SAMPLES, SCORED, reads, samples
from .sample_queries import _hits
from .tier_queries import _ALL, graded

KEY = 100
MIN_COPIES = "10:1,3:3"


def _pairs(spark, d: str) -> DataFrame:
    return pairs.joined(reads(spark, d), ["read_ord", "seq", "quality", "qual_offset", "sample_id"])


def pair_join(spark, d: str) -> DataFrame:
    return _pairs(spark, d).select("pair_id", F.col("r1.read_ord").alias("first"), F.col("r2.read_ord").alias("second"))


def pair_route(spark, d: str) -> DataFrame:
    return pairs.routed(pairs.joined(graded(spark, d), ["tier"]))


def pair_orientation(spark, d: str) -> DataFrame:
    from ..functions.matching import match_forward

    p = _pairs(spark, d).filter("r1 IS NOT NULL AND r2 IS NOT NULL").withColumn("primer", F.lit("CATGMAGTTAAGGAAGT"))
    starts = [match_forward(F.col(f"r{k}.seq"), F.col("primer"), 1, 10) for k in (1, 2)]
    o = pairs.oriented(p.withColumns({"s1": starts[0], "s2": starts[1]}), F.col("s1"), F.col("s2"))
    return o.select("pair_id", "swapped")


def _apart(r: DataFrame) -> DataFrame:
    """Reads taken apart into two mates: the first 80 bases and the last 80 from the other strand; shorter reads are both."""
    tail = F.greatest(F.lit(1), F.length("seq") - 79)
    mate = lambda s, q: F.struct(s.alias("seq"), q.alias("quality"), "qual_offset")
    return r.select(
        "read_ord",
        "sample_id",
        mate(F.substr("seq", F.lit(1), F.lit(80)), F.substr("quality", F.lit(1), F.lit(80))).alias("r1"),
        mate(fs.revcomp(F.substr("seq", tail)), F.reverse(F.substr("quality", tail))).alias("r2"),
    )


def _overlapping(spark, d: str) -> DataFrame:
    """Reads that merge without a mismatch when taken apart."""
    return _apart(reads(spark, d).filter(F.length("seq").between(90, 148) & ~fs.has_run(F.col("seq"), 12) & ~F.col("seq").rlike("[^ACGT]")))


def merge_pairs(spark, d: str) -> DataFrame:
    """The pairs of the table."""
    m = pairs.merge_pairs(_pairs(spark, d)).filter("merge IS NOT NULL")
    return m.select("pair_id", "merge.*")


def merge_consensus(spark, d: str) -> DataFrame:
    """Reads that were taken apart come out whole."""
    m = pairs.merge_pairs(_overlapping(spark, d))
    return m.select("read_ord", "merge.seq", "merge.overlap", "merge.mismatches", "merge.merge_length")


def merge_statistics(spark, d: str) -> DataFrame:
    return pairs.merge_statistics(pairs.merge_pairs(_overlapping(spark, d)), ["sample_id"])


def merge_errors(spark, d: str) -> DataFrame:
    """Reads of 90 to 130 bases taken apart, with an N in the first mate and a wrong base of low score in the second: they come out as
    they were, with the scores that both mates give. Left out are reads whose right base has a lower score than the wrong one."""
    apart = _overlapping(spark, d).join(reads(spark, d).select("read_ord", F.length("seq").alias("n")), "read_ord")
    apart = apart.filter(F.col("n").between(90, 130) & (F.ascii(F.substr("r1.quality", F.lit(76))) - F.col("r1.qual_offset") >= 2))
    put = lambda c, at, x: F.concat(F.substr(c, F.lit(1), at), x, F.substr(c, at + 2))
    one, two = F.col("n") - 76, F.col("n") - 76  # of the read, the bases n - 75 and 76
    wrong, low = F.translate(F.substr("r2.seq", two + 1, F.lit(1)), "ACGT", "CATG"), F.chr(F.col("r1.qual_offset") + 2)
    made = apart.select(
        "read_ord",
        F.struct(put(F.col("r1.seq"), one, F.lit("N")).alias("seq"), put(F.col("r1.quality"), one, low).alias("quality"), "r1.qual_offset").alias("r1"),
        F.struct(put(F.col("r2.seq"), two, wrong).alias("seq"), put(F.col("r2.quality"), two, low).alias("quality"), "r2.qual_offset").alias("r2"),
    )
    return pairs.merge_pairs(made).select("read_ord", "merge.seq", "merge.quality", "merge.overlap", "merge.mismatches")


def merge_consensus_all(spark, d: str) -> DataFrame:
    """All reads taken apart; those that don't merge come out with nulls."""
    m = pairs.merge_pairs(_apart(reads(spark, d)))
    return m.select("read_ord", "merge.seq", "merge.overlap", "merge.mismatches", "merge.merge_length")


def merge_statistics_pairs(spark, d: str) -> DataFrame:
    """All pairs of the table by the sample of their first mate, or of the second if that has none."""
    p = _pairs(spark, d).withColumn("sample_id", F.coalesce("r1.sample_id", "r2.sample_id"))
    return pairs.merge_statistics(pairs.merge_pairs(p), ["sample_id"])


def _wanted(spark, d: str) -> DataFrame:
    """A list of reads: those that open their sample."""
    return reads(spark, d).filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min_by("read_id", "read_ord").alias("read_id")).select("read_id", F.concat("sample_id", F.lit(".fq")).alias("out_file"))


def subset_semi(spark, d: str) -> DataFrame:
    return pairs.subset(reads(spark, d), _wanted(spark, d)).select("read_ord", "read_id")


def subset_anti(spark, d: str) -> DataFrame:
    return pairs.excluded(reads(spark, d), _wanted(spark, d)).select("read_ord", "read_id")


def _opened(spark, d: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    return derep.opened(derep.keyed(graded(spark, d), KEY), list(keys))


def _occurrences(spark, d: str, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    return derep.occurrences(_opened(spark, d, keys), list(keys))


def derep_counts(spark, d: str) -> DataFrame:
    return derep.dereplicated(derep.occurrences(derep.keyed(graded(spark, d).filter("sample_id IS NOT NULL"), KEY), ["key"]), ["key"])


def derep_order_rule(spark, d: str) -> DataFrame:
    return derep.dereplicated(_occurrences(spark, d), ["key"])


def derep_occurrence(spark, d: str) -> DataFrame:
    return derep.occurrence_text(_occurrences(spark, d), samples(spark, d), ["key"])


def derep_min_copies(spark, d: str) -> DataFrame:
    t = derep.dereplicated(_occurrences(spark, d), ["key"])
    return t.select("key", "total", "n_samples", derep.enough_copies(MIN_COPIES, F.col("total"), F.col("n_samples")).alias("passes"))


def derep_sample_min_copies(spark, d: str) -> DataFrame:
    return derep.enough_in_sample(_occurrences(spark, d), samples(spark, d), ["key"])


def derep_per_run(spark, d: str) -> DataFrame:
    return derep.dereplicated(_occurrences(spark, d, ("seq_run", "key")), ["seq_run", "key"])


def derep_mean_quality(spark, d: str) -> DataFrame:
    return derep.mean_quality(derep.keyed(reads(spark, d)), "key")


def derep_report(spark, d: str) -> DataFrame:
    t = derep.dereplicated(_occurrences(spark, d), ["key"])
    r = derep.report(t, derep.enough_copies(MIN_COPIES, F.col("total"), F.col("n_samples")))
    return r.withColumn("mean_key_length", F.round("mean_key_length", 4))


def derep_ranked(spark, d: str) -> DataFrame:
    return derep.ranked(derep.dereplicated(_occurrences(spark, d), ["key"]), ["key"]).select("key", "total")


def derep_best_subgroup(spark, d: str) -> DataFrame:
    """Reads of a short key by their length, as if that were what they merged to; those of odd length as unmerged."""
    r = derep.keyed(reads(spark, d), 30).withColumn("merge_length", F.when(F.length("seq") % 2 == 0, F.length("seq")))
    return derep.best_subgroup(r, "key", "merge_length")


def _assignments(spark, d: str) -> DataFrame:
    """A cluster map in UC lines, made from the FASTA table: records of one file belong to the file's first record."""
    f = table(spark, d, "fasta_records").filter("read_id IS NOT NULL")
    first = f.groupBy("file_name").agg(F.min_by("read_id", "rec_ord").alias("t"))
    q = f.join(first, "file_name")
    chimera = F.when(F.col("rec_ord") % 31 == 0, F.concat("t", F.lit("+"), "read_id")).otherwise(F.col("t"))
    line = F.concat_ws("\t", F.when(F.col("rec_ord") % 7 == 0, "N").otherwise("H"), F.lit("0"), F.lit("200"), (97 + F.col("rec_ord") % 4).cast("string"), F.lit("+"), F.lit("0"), F.lit("0"), F.lit("="), "read_id", chimera)
    return q.select(F.col("rec_ord").alias("line_no"), line.alias("line"))


def cluster_parse(spark, d: str) -> DataFrame:
    return clusters.parsed(_assignments(spark, d), "uc").select("line_no", "query", "target", "identity")


def chimera_split(spark, d: str) -> DataFrame:
    return clusters.targets(clusters.parsed(_assignments(spark, d), "uc")).select("line_no", "otu", "n_targets")


def _otu_counts(spark, d: str) -> DataFrame:
    f = table(spark, d, "fasta_records").filter("read_id IS NOT NULL").groupBy(F.col("read_id").alias("query"), F.substring_index("file_name", ".", 1).alias("sample_id")).agg(F.count("*").alias("n"))
    return clusters.counts(clusters.targets(clusters.parsed(_assignments(spark, d), "uc")), f)


def otu_matrix_long(spark, d: str) -> DataFrame:
    return _otu_counts(spark, d).withColumn("n", F.round("n", 4))


def otu_matrix(spark, d: str) -> DataFrame:
    """A column for each sample of the counts."""
    c = _otu_counts(spark, d)
    return clusters.matrix(c, clusters.sample_names(c))


def otu_added_counts(spark, d: str) -> DataFrame:
    """Counts of a map and, as further reads, of its even lines once more."""
    t = clusters.targets(clusters.parsed(_assignments(spark, d), "uc"))
    f = table(spark, d, "fasta_records").filter("read_id IS NOT NULL").groupBy(F.col("read_id").alias("query"), F.substring_index("file_name", ".", 1).alias("sample_id")).agg(F.count("*").alias("n"))
    return clusters.added(clusters.counts(t, f), clusters.counts(t.filter("line_no % 2 = 0"), f)).withColumn("n", F.round("n", 4))


def otu_unknown(spark, d: str) -> DataFrame:
    t = clusters.targets(clusters.parsed(_assignments(spark, d), "uc"))
    known = t.filter("n_targets = 1").select("otu").distinct()
    return clusters.resolved(t, known)[1]


def seed_percentiles(spark, d: str) -> DataFrame:
    r = reads(spark, d).select("seq_run", F.length("seq").alias("n"))
    return clusters.indexed_percentiles(r, ["seq_run"], "n")


def best_representative(spark, d: str) -> DataFrame:
    scan = positioned(table(spark, d, "fastx_records"), "read_ord", F.upper("sequence").alias("seq"), "quality", "qual_offset")
    scan = scan.filter("seq <> '' AND length(seq) = length(quality) AND qual_offset IS NOT NULL")
    m = scan.withColumn("m", fq.measures(F.col("quality"), F.col("qual_offset"), ("average", "accumulated_error"))).withColumn("key", F.substr("seq", F.lit(1), F.lit(40)))
    none = F.lit(None).cast("double")
    rows = m.select("key", "read_ord", "_path", "_block", "_row", fs.ambiguous(F.col("seq")).alias("odd"), F.col("m.accumulated_error").alias("error"), F.col("m.average").alias("quality"), F.length("seq").alias("length"), none.alias("identity"), none.alias("merge_length"), F.lit(1).alias("size"))
    return representatives(rows, "key", ["read_ord"])


def _concatemers(spark, d: str) -> DataFrame:
    """Long reads: primer, insert and reversed primer of up to three reads one after another."""
    s = samples(spark, d).filter("forward_primer <> '' AND reverse_primer <> ''").select("sample_id", "forward_primer", "reverse_primer")
    r = reads(spark, d).join(s, "sample_id").withColumn("g", F.floor(F.col("read_ord") / 3))
    plain = F.translate("forward_primer", "MRYWSKBDHVN", "AACACGCAAAA")
    piece = F.concat(plain, F.substr("seq", F.lit(30)), fs.revcomp(F.col("reverse_primer")))
    return r.groupBy("g", "sample_id", "forward_primer", "reverse_primer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", piece.alias("p")))), lambda x: x["p"]), "ACGT").alias("seq"), F.count("*").alias("n"))


def concatemer_split(spark, d: str) -> DataFrame:
    c = concatemers.split(_concatemers(spark, d).withColumn("id", F.concat_ws(".", "g", "sample_id")), "seq", "id", "forward_primer", "reverse_primer", 0)
    return c.select("amplicon_id", "insert", "n_amplicons")


def concatemer_statistics(spark, d: str) -> DataFrame:
    return concatemers.statistics(_concatemers(spark, d), "seq", "forward_primer", "reverse_primer", ["sample_id"], 0)


def demux_bp_budget(spark, d: str) -> DataFrame:
    """Reads of each run until its budget of bases is used up, in input order."""
    from ..operators.prefix import running_sum

    r = reads(spark, d).select("read_ord", "seq_run", F.length("seq").alias("n"))
    return running_sum(r, ["seq_run"], ["read_ord"], "n", "used", inclusive=False).filter("used < 20000").select("read_ord", "seq_run", "used")


QUERIES = {f.__name__: f for f in (pair_join, pair_route, pair_orientation, merge_pairs, merge_consensus, merge_errors, merge_statistics, merge_consensus_all, merge_statistics_pairs, subset_semi, subset_anti, derep_counts, derep_order_rule, derep_occurrence, derep_min_copies, derep_sample_min_copies, derep_per_run, derep_mean_quality, derep_report, derep_ranked, derep_best_subgroup, cluster_parse, chimera_split, otu_matrix_long, otu_matrix, otu_added_counts, otu_unknown, seed_percentiles, best_representative, concatemer_split, concatemer_statistics, demux_bp_budget)}

_STEM = "seq_run || '|' || regexp_replace(regexp_extract(read_id, '^[^ \\t]*'), '([/.][12]|#[12]:0)$', '')"
_JOINED = "p AS (SELECT {stem} AS pair_id, arg_min(read_ord, read_ord) FILTER (mate = 1) AS first, arg_min(read_ord, read_ord) FILTER (mate = 2) AS second FROM reads GROUP BY 1)".replace("{stem}", _STEM)
_KEYED = f"{_ALL}, keyed AS (SELECT g.*, s.seq_run, substr(s.seq, 1, {KEY}) AS key FROM graded g JOIN scored s USING (read_ord) WHERE g.sample_id IS NOT NULL)"
_OCC = _KEYED + ", o AS (SELECT {k}, min(read_ord) AS o FROM keyed WHERE tier = 'green' GROUP BY ALL), occ AS (SELECT {k}, sample_id, count(*) AS n FROM keyed JOIN o USING ({k}) WHERE read_ord >= o GROUP BY ALL)"
_OPEN = _OCC.replace("{k}", "key")
_TOTAL = "SELECT key, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_samples, max(n) AS largest FROM occ GROUP BY 1"
_PASS = "(n_samples >= 1 AND total >= 10) OR (n_samples >= 3 AND total >= 3)"
_UC = """a AS (SELECT f.rec_ord, f.read_id, f.file_name, t, CASE WHEN rec_ord % 31 = 0 THEN t || '+' || read_id ELSE t END AS target FROM fasta_records f JOIN (SELECT file_name, arg_min(read_id, rec_ord) AS t FROM fasta_records WHERE read_id IS NOT NULL GROUP BY 1) USING (file_name) WHERE read_id IS NOT NULL),
  h AS (SELECT * FROM a WHERE rec_ord % 7 <> 0), x AS (SELECT rec_ord AS line_no, read_id AS query, unnest(string_split(target, '+')) AS o, len(string_split(target, '+')) AS n_targets FROM h),
  z AS (SELECT line_no, query, n_targets, regexp_replace(regexp_replace(trim(o), ';(size|seqs)=.*$', ''), '^centroid=', '') AS otu FROM x),
  f AS (SELECT read_id AS query, string_split(file_name, '.')[1] AS sample_id, count(*) AS n FROM fasta_records WHERE read_id IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT otu, sample_id, sum(n / n_targets) AS n FROM z JOIN f USING (query) GROUP BY 1, 2)"""

_APART = READS + ", apart AS (SELECT * FROM reads WHERE n BETWEEN 90 AND 148 AND NOT regexp_matches(seq, '[^ACGT]') AND NOT regexp_matches(seq, 'A{12}|C{12}|G{12}|T{12}'))"

_SCORE = "CAST(least(40, greatest(0, floor(-10 * log10(greatest(1e-12, {x})) + 0.5))) AS INTEGER)"
_AGREE = _SCORE.format(x="e * e / 3 / greatest(1e-12, 1 - 2 * e + 4 * e * e / 3)")
_DIFFER = _SCORE.format(x="least(e, o) * (1 - greatest(e, o) / 3) / (e + o - 4 * e * o / 3)")

ORACLES = {
    "merge_errors": f"""WITH {SCORED}, f AS (SELECT * FROM scored WHERE n BETWEEN 90 AND 130 AND NOT regexp_matches(seq, '[^ACGT]') AND NOT regexp_matches(seq, 'A{{12}}|C{{12}}|G{{12}}|T{{12}}') AND q[76] >= 2),
      b AS (SELECT read_ord, n, i, q, {ERROR.format('q')} AS e, pow(10.0, -0.2) AS o FROM (SELECT read_ord, n, i, q[i] AS q FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f))),
      m AS (SELECT read_ord, string_agg(chr(33 + CASE WHEN i < n - 79 OR i > 80 THEN CAST(least(93, greatest(0, q)) AS INTEGER) WHEN i = n - 75 OR i = 76 THEN {_DIFFER} ELSE {_AGREE} END), '' ORDER BY i) AS quality FROM b GROUP BY 1)
      SELECT read_ord, seq, m.quality, CAST(160 - n AS INTEGER) AS overlap, CAST(2 AS INTEGER) AS mismatches FROM f JOIN m USING (read_ord)""",
    "pair_orientation": f"""WITH {READS}, {_JOINED}, t AS (SELECT pair_id, a.read_ord, a.seq, a.n, b.seq AS seq2, b.n AS n2, 'CATGMAGTTAAGGAAGT' AS primer FROM p JOIN reads a ON first = a.read_ord JOIN reads b ON second = b.read_ord),
      u AS (SELECT pair_id, read_ord, seq2 AS seq, n2 AS n, primer FROM t), h AS ({_hits('t', 'primer', 'range(0, 10)', 1, 0.5, 'min')}), g AS ({_hits('u', 'primer', 'range(0, 10)', 1, 0.5, 'min')})
      SELECT pair_id, g.start IS NOT NULL AND h.start IS NULL AS swapped FROM t LEFT JOIN h USING (read_ord) LEFT JOIN g USING (read_ord)""",
    "merge_consensus": f"WITH {_APART} SELECT read_ord, seq, CAST(160 - n AS INTEGER) AS overlap, CAST(0 AS INTEGER) AS mismatches, CAST(n AS INTEGER) AS merge_length FROM apart",
    "merge_statistics": f"WITH {_APART} SELECT sample_id, count(*) AS n_pairs, count(*) AS n_merged, avg(160.0 - n) AS mean_overlap, CAST(0 AS DOUBLE) AS mean_mismatches FROM apart GROUP BY 1",
    "pair_join": f"WITH {READS}, {_JOINED} SELECT pair_id, first, second FROM p",
    "pair_route": f"""WITH {_ALL}, q AS (SELECT g.*, {_STEM} AS pair_id FROM graded g JOIN (SELECT read_ord, seq_run, read_id FROM scored) USING (read_ord)),
      p AS (SELECT pair_id, coalesce(arg_min(tier, read_ord) FILTER (mate = 1), 'failed') AS t1, coalesce(arg_min(tier, read_ord) FILTER (mate = 2), 'failed') AS t2 FROM q GROUP BY 1)
      SELECT pair_id, 1 AS mate, t1 AS stream, CASE WHEN t1 = t2 THEN 'pair1' ELSE 'single1' END AS slot FROM p WHERE t1 <> 'failed' UNION ALL SELECT pair_id, 2, t2, CASE WHEN t1 = t2 THEN 'pair2' ELSE 'single2' END FROM p WHERE t2 <> 'failed'""",
    "subset_semi": f"WITH {READS} SELECT read_ord, read_id FROM reads WHERE read_id IN (SELECT arg_min(read_id, read_ord) FROM reads WHERE sample_id IS NOT NULL GROUP BY sample_id)",
    "subset_anti": f"WITH {READS} SELECT read_ord, read_id FROM reads WHERE read_id IS NULL OR read_id NOT IN (SELECT arg_min(read_id, read_ord) FROM reads WHERE sample_id IS NOT NULL GROUP BY sample_id)",
    "derep_counts": f"WITH {READS}, occ AS (SELECT substr(seq, 1, {KEY}) AS key, sample_id, count(*) AS n FROM reads WHERE sample_id IS NOT NULL GROUP BY 1, 2) {_TOTAL}",
    "derep_order_rule": f"WITH {_OPEN} {_TOTAL}",
    "derep_occurrence": f"WITH {_OPEN} SELECT key, CAST(sum(n) AS BIGINT) AS total, string_agg(sample_idx || ':' || n, chr(9) ORDER BY sample_idx) AS occurrences FROM occ JOIN sample_map USING (sample_id) GROUP BY 1",
    "derep_min_copies": f"WITH {_OPEN}, t AS ({_TOTAL}) SELECT key, total, n_samples, {_PASS} AS passes FROM t",
    "derep_sample_min_copies": f"WITH {_OPEN} SELECT DISTINCT key FROM occ JOIN sample_map USING (sample_id) WHERE n >= derep_min",
    "derep_per_run": f"WITH {_OCC.replace('{k}', 'seq_run, key')} SELECT seq_run, key, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_samples, max(n) AS largest FROM occ GROUP BY 1, 2",
    "derep_mean_quality": f"WITH {READS}, s AS (SELECT seq AS key, unnest(range(0, n)) AS position, unnest(list_transform(string_split(quality, ''), lambda c: greatest(0, unicode(c) - qual_offset))) AS v FROM reads) SELECT key, CAST(position AS INTEGER) AS position, CAST(floor(sum(v) / count(*) + 0.5) AS INTEGER) AS mean FROM s GROUP BY 1, 2",
    "derep_report": f"WITH {_OPEN}, t AS ({_TOTAL}) SELECT count(*) AS uniques, CAST(sum(total) AS BIGINT) AS reads, count(*) FILTER ({_PASS}) AS passing, count(*) FILTER (NOT ({_PASS})) AS not_passing, round(avg(length(key)), 4) AS mean_key_length FROM t",
    "derep_ranked": f"WITH {_OPEN} SELECT key, CAST(sum(n) AS BIGINT) AS total FROM occ GROUP BY 1",
    "derep_best_subgroup": f"WITH {READS}, c AS (SELECT substr(seq, 1, 30) AS key, CAST(CASE WHEN n % 2 = 0 THEN n END AS INTEGER) AS merge_length, count(*) AS n FROM reads GROUP BY 1, 2), s AS (SELECT *, n * CASE WHEN merge_length IS NULL THEN 0.8 ELSE merge_length / max(merge_length) OVER w END AS score, CAST(sum(n) OVER w AS BIGINT) AS total FROM c WINDOW w AS (PARTITION BY key)) SELECT key, merge_length, n, total FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, merge_length NULLS FIRST) = 1",
    "cluster_parse": f"WITH {_UC} SELECT rec_ord AS line_no, read_id AS query, target, CAST(97 + rec_ord % 4 AS DOUBLE) AS identity FROM h",
    "chimera_split": f"WITH {_UC} SELECT line_no, otu, CAST(n_targets AS INTEGER) AS n_targets FROM z",
    "otu_matrix_long": f"WITH {_UC} SELECT otu, sample_id, round(n, 4) AS n FROM c",
    "otu_matrix": f"WITH {_UC}, m AS (SELECT otu, sample_id, CAST(round(n) AS BIGINT) AS n FROM c UNION ALL SELECT otu, sample_id, CAST(0 AS BIGINT) FROM (SELECT DISTINCT otu FROM c), (SELECT DISTINCT sample_id FROM c)) FROM (PIVOT m ON sample_id USING CAST(sum(n) AS BIGINT) GROUP BY otu)",
    "otu_added_counts": f"WITH {_UC} SELECT otu, sample_id, round(sum(n / n_targets * CASE WHEN line_no % 2 = 0 THEN 2 ELSE 1 END), 4) AS n FROM z JOIN f USING (query) GROUP BY 1, 2",
    "otu_unknown": f"WITH {_UC} SELECT otu, count(*) AS n FROM z WHERE otu NOT IN (SELECT otu FROM z WHERE n_targets = 1) GROUP BY 1",
    "seed_percentiles": f"WITH {READS}, r AS (SELECT seq_run, n, row_number() OVER (PARTITION BY seq_run ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY seq_run) AS c FROM reads) SELECT seq_run, CAST(p AS INTEGER) AS point, CAST(n AS INTEGER) AS value FROM r JOIN (SELECT unnest([0, 10, 50, 90, 100]) AS p) ON i = floor((c - 1) * p / 100)",
    "demux_bp_budget": f"WITH {READS}, u AS (SELECT read_ord, seq_run, CAST(sum(n) OVER (PARTITION BY seq_run ORDER BY read_ord) - n AS BIGINT) AS used FROM reads) SELECT * FROM u WHERE used < 20000",
}
