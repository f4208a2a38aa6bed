"""SQL for the p3_ and p5_ queries, written from the statements of the problems."""

from __future__ import annotations


def _states(source: str, key: str, value: str) -> str:
    return f"""
    WITH r AS (SELECT {key}, {value}, o FROM ({source})),
    w AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o) AS n, lag({value}) OVER (PARTITION BY {key} ORDER BY o) AS was FROM r)
    SELECT {key}, count(*) AS n_rows, count({value}) AS n_values, CAST(sum({value}) AS BIGINT) AS total, min({value}) AS least, max({value}) AS most,
      list({value} ORDER BY o)[1] AS first_value, list({value} ORDER BY o)[-1] AS last_value,
      CAST(sum(CASE WHEN n > 1 AND {value} IS DISTINCT FROM was THEN 1 ELSE 0 END) AS BIGINT) AS n_changes,
      CAST((count(*) + 99999) // 100000 AS BIGINT) AS n_chunks
    FROM w GROUP BY {key}"""


def _heavy(table: str, field: str, expression: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{field}' AS field_name, k AS key_text FROM (SELECT {expression} AS k, count(*) AS n FROM {table} GROUP BY 1)
    WHERE k <> '' AND n * 100 > 3 * (SELECT count(*) FROM {table})"""


_WS = "chr(9) || chr(10) || chr(13) || ' '"
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_CAPTURE = f"({_FIELD}),({_FIELD}),({_FIELD})"
_TRIM = f"rtrim(raw_text, {_WS})"
_PARSE = f"""
    WITH t AS (SELECT raw_id, layout, {_TRIM} AS t FROM raw_records),
    a AS (SELECT *, CASE WHEN t IS NULL OR t = '' THEN 'empty'
        WHEN layout = 'csv' AND NOT regexp_full_match(t, '{_FIELD}(,{_FIELD})*', 's') THEN 'quoting'
        WHEN layout = 'csv' AND NOT regexp_full_match(t, '{_FIELD}(,{_FIELD}){{2}}', 's') THEN 'columns'
        WHEN layout = 'fastq' AND len(string_split(t, chr(10))) <> 4 THEN 'columns' END AS early FROM t),
    f AS (SELECT *, CASE WHEN early IS NULL AND layout = 'fastq' THEN list_transform(string_split(t, chr(10)), lambda x: rtrim(x, {_WS})) END AS l,
        CASE WHEN early IS NULL AND layout = 'csv' THEN [regexp_extract(t, '^{_CAPTURE}$', 1, 's'), regexp_extract(t, '^{_CAPTURE}$', 2, 's'), regexp_extract(t, '^{_CAPTURE}$', 3, 's')] END AS c FROM a),
    u AS (SELECT *, list_transform(c, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM f),
    g AS (SELECT raw_id, layout, early, coalesce(l[1], v[1]) AS header, coalesce(l[2], v[2]) AS sequence, l[3] AS plus, coalesce(l[4], v[3]) AS quality FROM u),
    p AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
        WHEN NOT regexp_matches(header, '^@[^ \\t\\r\\n]') THEN 'header'
        WHEN layout = 'fastq' AND NOT starts_with(plus, '+') THEN 'separator'
        WHEN NOT regexp_full_match(sequence, '[ACGTRYMKWSBDHVNacgtrymkwsbdhvn]+') THEN 'sequence'
        WHEN NOT regexp_full_match(quality, '[!-~]*') THEN 'quality'
        WHEN length(sequence) <> length(quality) THEN 'length' END AS reason FROM g)
    """

_SAMPLE = "SELECT read_ord AS o, sample_id, CAST(length(sequence) AS BIGINT) AS n_bases FROM fastx_records"
_SEQUENCE = "SELECT read_ord AS o, upper(sequence) AS sequence, CAST(length(quality) AS BIGINT) AS n_scores FROM fastx_records"
_BARCODE = "SELECT stat_id AS o, sample_id, CASE WHEN barcode_detected >= 0 THEN CAST(barcode_detected AS BIGINT) END AS barcode_detected FROM barcode_stats"

ORACLES = {
    "p3_found": _PARSE + "SELECT raw_id, reason FROM p WHERE reason IS NOT NULL",
    "p3_valid": _PARSE + "SELECT raw_id, header, sequence, quality FROM p WHERE reason IS NULL",
    "p5_found": " UNION ALL ".join([_heavy("fastx_records", "sample_id", "sample_id"), _heavy("fastx_records", "sequence", "upper(sequence)"), _heavy("barcode_stats", "sample_id", "sample_id")]),
    "p5_reads_by_sample": _states(_SAMPLE, "sample_id", "n_bases"),
    "p5_reads_by_sequence": _states(_SEQUENCE, "sequence", "n_scores"),
    "p5_barcodes_by_sample": _states(_BARCODE, "sample_id", "barcode_detected"),
}
