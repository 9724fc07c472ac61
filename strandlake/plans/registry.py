"""The registered queries of the core and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import alignments, coverage, oracle_alignments, oracle_coverage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p3_found": coverage.p3_found,
    "p3_periods": coverage.p3_periods,
    "p6_found": coverage.p6_found,
    "p6_contig_profile": coverage.p6_contig_profile,
    **alignments.QUERIES,
}

ORACLES: dict[str, str] = {**oracle_coverage.ORACLES, **oracle_alignments.ORACLES}
