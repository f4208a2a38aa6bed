"""The queries of the core, by name, and their SQL."""

from __future__ import annotations

from ..operators import keyed_chunks, parse_records
from . import group_queries, io_queries, kernel_queries, pipeline_queries, problem_sql, sample_queries, tier_queries

_PLANS = (tier_queries, kernel_queries, sample_queries, group_queries, io_queries, pipeline_queries)

QUERIES = {
    "p3_found": parse_records.p3_found,
    "p3_valid": parse_records.p3_valid,
    "p5_found": keyed_chunks.p5_found,
    "p5_reads_by_sample": keyed_chunks.p5_reads_by_sample,
    "p5_reads_by_sequence": keyed_chunks.p5_reads_by_sequence,
    "p5_barcodes_by_sample": keyed_chunks.p5_barcodes_by_sample,
    **{name: query for plan in _PLANS for name, query in plan.QUERIES.items()},
}

ORACLES = problem_sql.ORACLES | {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
