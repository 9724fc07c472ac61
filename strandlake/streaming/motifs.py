"""Motif counts over arriving reads (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.matching import hits
from strandlake.schema import Strand
from strandlake.sources.tables import included


def motif_counts(reads: DataFrame, patterns: list[str], window: str = "1 day", late: str = "7 days", strand: Strand = Strand.COMPLETE) -> DataFrame:
    """window, pattern, strand, n: occurrences in included reads per window of ingested_at; works on a stream and on a
    table. State is one row per open window, pattern and strand. Reads without ingested_at, and reads more than `late`
    behind the newest, are left out of a stream's counts."""
    rows = included(reads).where(dna.has_sequence(F.col("seq")))
    if rows.isStreaming:
        rows = rows.withWatermark("ingested_at", late)
    rows = rows.select("ingested_at", dna.bases(F.col("seq")).alias("seq"))
    found = hits(rows, patterns, strand)
    return found.groupBy(F.window("ingested_at", window), "pattern", "strand").agg(F.count(F.lit(1)).alias("n"))


def new_reads(reads: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without rows that were delivered again: same file and place in it, within the watermark."""
    return reads.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["source_file_id", "bam_offset"])
