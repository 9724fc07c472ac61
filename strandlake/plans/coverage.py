"""Queries p3 (coverage periods and gaps) and p6 (per-contig results under skew)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar, dna
from strandlake.operators.intervals import interval_gaps, merge_intervals
from strandlake.operators.skew import salted_aggregate
from strandlake.session import materialize
from strandlake.sources.tables import contig_names, included_reads, resolve_chrom, table

ENTITY = ["origin", "source_file_id", "chrom_id"]


def _stretches(spark: SparkSession, folder: str) -> DataFrame:
    reads = included_reads(spark, folder, "cigar", "source_file_id")
    reads = reads.withColumn("span", cigar.ref_span(F.col("cigar"))).where("span > 0")
    reads = reads.select(F.lit("read").alias("origin"), "source_file_id", "chrom_id", F.col("pos").alias("a"), (F.col("pos") + F.col("span") - 1).alias("b"))
    hits = table(spark, folder, "motif_matches").select("chrom", "source_file_id", "p_min", "p_max").where("p_max is not null and p_min is not null")
    hits = resolve_chrom(hits, contig_names(spark, folder))
    hits = hits.select(F.lit("match").alias("origin"), "source_file_id", "chrom_id", F.least("p_min", "p_max").alias("a"), F.greatest("p_min", "p_max").alias("b"))
    return reads.unionByName(hits)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return interval_gaps(_stretches(spark, folder), ENTITY, "a", "b")


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(_stretches(spark, folder), ENTITY, "a", "b")


def _sides(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    raw = table(spark, folder, "reads_raw")
    raw = resolve_chrom(raw.select("chrom", "record_id", "qname", "seq", "pos"), contig_names(spark, folder), "left")
    return [("reads_raw", raw), ("ordered_reads", table(spark, folder, "ordered_reads"))]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs with at least 5 % of all rows of a table: counts by salted aggregation, rows that resolve to no contig
    staying in the total as the null group."""
    out = None
    for name, df in _sides(spark, folder):
        counts = salted_aggregate(df.select("chrom_id", "record_id"), "chrom_id", {"n": ("count", F.lit(1))}, ["record_id"])
        counts = materialize(counts, "contig_counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        part = counts.where((F.col("n") * 100 >= total * 5) & F.col("chrom_id").isNotNull())
        part = part.select(F.lit(name).alias("in_table"), F.col("chrom_id").cast("bigint").alias("chrom_id"))
        out = part if out is None else out.unionByName(part)
    return out


def p6_contig_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and contig: rows, distinct read names (reads_raw) or read ids, bases, and the outermost positions."""
    (_, raw), (_, ordered) = _sides(spark, folder)
    raw = raw.select("chrom_id", dna.read_name(F.col("qname")).alias("name"), F.length(dna.bases(F.col("seq"))).alias("l_seq"), "pos")
    ordered = ordered.select("chrom_id", F.col("read_id").alias("name"), "l_seq", "pos")
    out = None
    for label, df in (("reads_raw", raw), ("ordered_reads", ordered)):
        part = salted_aggregate(
            df,
            "chrom_id",
            {
                "n_rows": ("count", F.lit(1)),
                "n_names": ("count_distinct", F.col("name")),
                "n_bases": ("sum", F.col("l_seq").cast("bigint")),
                "first_pos": ("min", F.col("pos")),
                "last_pos": ("max", F.col("pos")),
            },
            ["name"],
        )
        part = part.select(F.lit(label).alias("in_table"), "*")
        out = part if out is None else out.unionByName(part)
    return out
