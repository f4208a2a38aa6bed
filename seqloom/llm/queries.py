"""The pN_ queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, table
from . import heavy_hitters, mixing, near_duplicates, percentiles, subjects, tokens

TOP = 20
#: How far shares may be from the wanted ones: a source of a hundred documents can't be cut finer.
CLOSE = 0.01


SIMILAR = 0.6


def _fasta(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fasta_records").withColumn("sequence", F.upper("sequence"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_rows(_fasta(spark, sf_dir), "rec_ord", "sequence", SIMILAR)


def p1_classes(spark, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_classes(_fasta(spark, sf_dir), "rec_ord", "sequence", SIMILAR)


def _sequences():
    return F.nullif(F.upper("sequence"), F.lit(""))


def _frequent(spark, sf_dir: str) -> DataFrame:
    return heavy_hitters.most_frequent(table(spark, sf_dir, "fastx_records"), _sequences(), "sequence", TOP)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("sequence")


def p4_counts(spark, sf_dir: str) -> DataFrame:
    """With exact counts, whether estimates are nowhere too low and whether no other value can have more rows."""
    return _frequent(spark, sf_dir).select("sequence", "n_rows", (F.col("approx_count") >= F.col("n_rows")).alias("never_low"), "guaranteed")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return tokens.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def p6_decoded(spark, sf_dir: str) -> DataFrame:
    """Each text through the encoder and back; `same` is false where anything got lost."""
    ids = tokens.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id", "text"])
    back = tokens.decode_column(ids, ["doc_id", "text"])
    return back.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_mixture(spark, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    return mixing.shares(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checks(spark, sf_dir: str) -> DataFrame:
    """Of each target source: whether it has documents, none is used too often and its share is within CLOSE of the wanted one (that of
    sources without documents spread over the others)."""
    s = p7_shares(spark, sf_dir)
    there = table(spark, sf_dir, "documents").filter("n_chars > 0").select("source").distinct().withColumn("has_documents", F.lit(True))
    s = s.join(there, "source", "left").fillna(False, ["has_documents"])
    wanted = F.when(F.col("has_documents"), F.col("target_share")).otherwise(0.0)
    wanted = wanted / F.sum(wanted).over(Window.partitionBy(F.lit(1)))
    return s.select("source", "has_documents", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - wanted) <= CLOSE).alias("share_kept"))


def _subjects(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return subjects.subjects_of(docs, table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_examples"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject_code")


def p8_composition(spark, sf_dir: str) -> DataFrame:
    """Mails by subject; a mail with several counts for each."""
    areas = table(spark, sf_dir, "subject_areas").select("subject_code", "title")
    counted = _subjects(spark, sf_dir).groupBy("subject_code").agg(F.count("*").alias("n_mails"), F.sum("n_sentences").alias("n_sentences"))
    return areas.join(counted, "subject_code", "left").fillna(0, ["n_mails", "n_sentences"])


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    **{name: getattr(percentiles, name) for name in ("p2_quality_by_sample_day", "p2_quality_by_run", "p2_quality_by_sample", "p2_quality_by_file", "p2_quality_by_day", "p2_barcodes_by_sample", "p2_barcodes_by_day")},
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}


def _percentiles(values: str, group: str) -> str:
    marks = " UNION ALL ".join(f"SELECT CAST({p} AS DECIMAL(10, 9)) AS p" for p in percentiles.PROBABILITIES)
    return f"""WITH v AS ({values}), f AS (SELECT g, value, count(*) AS n FROM v GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY value) AS cum, sum(n) OVER (PARTITION BY g) AS total FROM f), q AS ({marks})
    SELECT g AS {group}, CAST(p AS DOUBLE) AS probability, CAST(total AS BIGINT) AS n_values, CAST(value AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS error_bound
    FROM c JOIN q ON cum >= greatest(1, ceil(p * total)) AND cum - n < greatest(1, ceil(p * total))"""


def _scores(group: str, key: str = "") -> str:
    return _percentiles(f"SELECT {key or group} AS g, unicode(unnest(string_split(quality, ''))) - qual_offset AS value FROM fastx_records WHERE quality <> '' AND qual_offset IS NOT NULL", group)


def _barcodes(group: str, key: str = "") -> str:
    return _percentiles(f"SELECT {key or group} AS g, barcode_detected AS value FROM barcode_stats WHERE barcode_detected <> -1", group)


_RUNS = """WITH t AS (SELECT rec_ord, unnest(list_distinct(list_transform(range(1, length(sequence) - 6), lambda i: substr(upper(sequence), i, 8)))) AS k
      FROM fasta_records WHERE length(sequence) >= 8), z AS (SELECT rec_ord, count(*) AS n FROM t GROUP BY 1),
    o AS (SELECT a.rec_ord AS rec_a, b.rec_ord AS rec_b, count(*) AS n FROM t a JOIN t b USING (k) WHERE a.rec_ord < b.rec_ord GROUP BY 1, 2),
    s AS (SELECT rec_a, rec_b FROM o JOIN z x ON rec_a = x.rec_ord JOIN z y ON rec_b = y.rec_ord WHERE o.n * 10 >= 6 * (x.n + y.n - o.n))
    """

ORACLES = {
    "p2_quality_by_sample_day": _scores("k", "{'sample_id': sample_id, 'read_day': CAST(read_day AS VARCHAR)}").replace("g AS k", "g.sample_id AS sample_id, g.read_day AS read_day"),
    "p1_found": _RUNS + "SELECT rec_a, rec_b FROM s",
    "p1_classes": _RUNS + """, c AS (SELECT upper(sequence) AS q, min(rec_ord) AS class_id, count(*) AS n_copies FROM fasta_records WHERE length(sequence) >= 8 GROUP BY 1),
    m AS (SELECT rec_ord AS id, class_id, n_copies FROM fasta_records JOIN c ON upper(sequence) = q),
    l AS (SELECT class_id, count(*) AS n_links FROM (SELECT rec_a AS class_id, rec_b AS other FROM s UNION ALL SELECT rec_b, rec_a FROM s)
      WHERE class_id IN (SELECT class_id FROM c) AND other IN (SELECT class_id FROM c) GROUP BY 1)
    SELECT id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l USING (class_id)""",
    "p2_quality_by_run": _scores("seq_run"),
    "p2_quality_by_sample": _scores("sample_id"),
    "p2_quality_by_file": _scores("file_name"),
    "p2_quality_by_day": _scores("read_day", "CAST(read_day AS VARCHAR)"),
    "p2_barcodes_by_sample": _barcodes("sample_id"),
    "p2_barcodes_by_day": _barcodes("stat_day", "CAST(stat_day AS VARCHAR)"),
    "p4_found": f"SELECT sequence FROM (SELECT upper(sequence) AS sequence, count(*) AS n FROM fastx_records WHERE sequence <> '' GROUP BY 1 ORDER BY n DESC, sequence LIMIT {TOP})",
    "p4_counts": f"SELECT upper(sequence) AS sequence, count(*) AS n_rows, true AS never_low, true AS guaranteed FROM fastx_records WHERE sequence <> '' GROUP BY 1 ORDER BY n_rows DESC, sequence LIMIT {TOP}",
    "p7_checks": "SELECT source, source IN (SELECT source FROM documents WHERE n_chars > 0 AND source IS NOT NULL) AS has_documents, true AS repeats_kept, true AS share_kept FROM mix_targets",
    "p6_decoded": "SELECT doc_id, true AS same FROM documents",
}
