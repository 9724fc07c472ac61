"""The Parquet tables of a data folder, and the derived views on reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chrom_key(chrom: Column) -> Column:
    """The form in which contig names are compared: without outer blanks, in lower case."""
    return F.lower(F.trim(chrom))


def contig_names(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom_key, chrom_id): every contig name and alias. A key with several ids takes the smallest."""
    names = table(spark, folder, "contigs").select(chrom_key(F.col("contig_name")).alias("chrom_key"), "chrom_id")
    alts = table(spark, folder, "contig_aliases").select(chrom_key(F.col("alt_name")).alias("chrom_key"), "chrom_id")
    return names.union(alts).where("chrom_key is not null").groupBy("chrom_key").agg(F.min("chrom_id").alias("chrom_id"))


def resolve_chrom(df: DataFrame, names: DataFrame, how: str = "inner") -> DataFrame:
    """df with chrom_id for its chrom. The dictionary is a dimension of some hundred names: its measured size decides
    whether Catalyst broadcasts it (spark.sql.autoBroadcastJoinThreshold), so no hint is forced here."""
    kept = df.drop("chrom_id").withColumn("__chrom_key", chrom_key(F.col("chrom")))
    named = names.select(F.col("chrom_key").alias("__chrom_key"), "chrom_id")
    return kept.join(named, "__chrom_key", how).drop("__chrom_key")


def included(df: DataFrame) -> DataFrame:
    """The rows kept by the flag and position half of the inclusion rule."""
    return df.where((F.col("pos") >= 1) & dna.included_flags(F.col("flag")))


def included_reads(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Included rows of reads_raw with chrom_id; only the named columns are read."""
    raw = table(spark, folder, "reads_raw")
    if columns:
        raw = raw.select(*dict.fromkeys([*columns, "flag", "pos", "chrom"]))
    return resolve_chrom(included(raw), contig_names(spark, folder))
