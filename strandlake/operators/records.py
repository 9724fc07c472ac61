"""Reads in the engine's scope, and the streams made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.ordering import with_running_sum
from strandlake.schema import EngineError, ErrorCode
from strandlake.session import small_or_none
from strandlake.sources.tables import included_reads, table

STREAMS = ("seq", "qual", "meta", "map")


def indexed_reads(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The reads of all builds: included, with bases, ingested before their build was closed. record_id, build_id,
    chrom_id, pos, l_seq and the named columns of reads_raw, seq as bases. source_files is a dimension with a row per
    file; its measured size decides how it is joined. No read is shuffled."""
    rows = included_reads(spark, folder, "record_id", "seq", "source_file_id", "ingested_at", *columns)
    rows = rows.where(dna.has_sequence(F.col("seq")))
    files = table(spark, folder, "source_files").select("source_file_id", "build_id", "sealed_at")
    rows = rows.join(files, "source_file_id").where("ingested_at <= sealed_at")
    rows = rows.withColumn("l_seq", F.length("seq").cast("bigint"))
    keep = dict.fromkeys(["record_id", "build_id", "chrom_id", "pos", "l_seq", *[c for c in columns if c != "seq"]])
    # As a generator's output, seq is made once a row: the optimizer would copy its expression into every test on it.
    return rows.select(*keep, *([F.explode(F.array(dna.bases(F.col("seq")))).alias("seq")] if "seq" in columns else []))


def with_read_ids(rows: DataFrame, spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """rows with read_id and the named columns of the given order table."""
    order = table(spark, folder, "ordered_reads").select("record_id", "read_id", *columns)
    return rows.join(order, "record_id")


def delta_positions(reads: DataFrame) -> DataFrame:
    """read_id, chrom_id, delta: the first read of a contig in a build absolute, then the distance to the read before.

    The read before has the read_id before, so this is a join on read_id - 1 and no contig is sorted in one task.
    """
    before = reads.select((F.col("read_id") + 1).alias("read_id"), F.col("build_id").alias("__b"), F.col("chrom_id").alias("__c"), F.col("pos").alias("__p"))
    joined = reads.join(before, "read_id", "left")
    same = (F.col("__b") == F.col("build_id")) & (F.col("__c") == F.col("chrom_id"))
    return joined.select("read_id", "build_id", "chrom_id", F.when(same, F.col("pos") - F.col("__p")).otherwise(F.col("pos")).alias("delta"))


def block_directory(reads: DataFrame, length: Column, block_size: int = 1024) -> DataFrame:
    """block_id, first_read_id, n_reads, block_length, block_offset: blocks of consecutive reads in a stream."""
    rows = reads.select("read_id", length.alias("len"), F.floor(F.col("read_id") / block_size).cast("bigint").alias("block_id"))
    blocks = rows.groupBy("block_id").agg(F.min("read_id").alias("first_read_id"), F.count(F.lit(1)).alias("n_reads"), F.sum("len").alias("block_length"))
    whole = with_running_sum(blocks.withColumn("__all", F.lit(0)), "__all", "block_id", "block_length", "block_offset")
    return whole.select("block_id", "first_read_id", "n_reads", "block_length", "block_offset")


def directory(reads: DataFrame, block_size: int = 1024) -> DataFrame:
    """stream, block_id, first_read_id, n_reads, block_length, block_offset for each of the streams seq, qual, meta and map
    (in bases, values, bytes of the packed record, and entries). With a block size of 1 it is the directory per read."""
    lengths = {
        "seq": F.col("l_seq"),
        "qual": F.greatest(F.coalesce(F.size("qual"), F.lit(0)), F.lit(0)).cast("bigint"),
        "meta": meta_length(F.col("cigar"), F.col("aux")),
        "map": F.lit(1).cast("bigint"),
    }
    rows = reads.select("read_id", F.inline(F.array(*[F.struct(F.lit(n).alias("stream"), c.alias("len")) for n, c in lengths.items()])))
    rows = rows.withColumn("block_id", F.floor(F.col("read_id") / block_size).cast("bigint"))
    blocks = rows.groupBy("stream", "block_id").agg(F.min("read_id").alias("first_read_id"), F.count(F.lit(1)).alias("n_reads"), F.sum("len").alias("block_length"))
    whole = with_running_sum(blocks, "stream", "block_id", "block_length", "block_offset")
    return whole.select("stream", "block_id", "first_read_id", "n_reads", "block_length", "block_offset")


def meta_length(cigar: Column, aux: Column) -> Column:
    """Bytes of a record's packed metadata (TYPED_SPLIT), without packing it."""
    bytes_of = lambda v: F.lit(1) + sum(F.when(v >= F.lit(1 << 7 * k), 1).otherwise(0) for k in range(1, 6))
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)[MIDNSHP=X]"), 1)
    each = F.aggregate(parts, F.lit(0), lambda total, n: total + bytes_of(n.cast("bigint") * 16))
    return (F.lit(2) + bytes_of(F.size(parts)) + each + F.coalesce(F.octet_length(aux), F.lit(0))).cast("bigint")


def reconstruct(reads: DataFrame, streams: list[str] | None = None, read_ids: list[int] | None = None, lossless: bool = True, allow_lossy: bool = False) -> DataFrame:
    """Records as they came, with the streams that aren't selected blanked: seq as N, qual as 255, meta as flag 0 and one
    M over the read, map as no contig and position 0. mapq and qname always stay. read_ids selects, in their order and
    with their repetitions; an id that doesn't exist is refused."""
    chosen = STREAMS if streams is None else tuple(streams)
    if bad := [s for s in chosen if s not in STREAMS]:
        raise EngineError(ErrorCode.INVALID_STREAM, ", ".join(bad))
    if not lossless and not allow_lossy:
        raise EngineError(ErrorCode.LOSSY_RECONSTRUCTION, "qualities were binned; ask for it explicitly")
    if read_ids:
        wanted = reads.sparkSession.createDataFrame([(r, i) for i, r in enumerate(read_ids)], "read_id bigint, request bigint")
        missing = small_or_none(wanted.join(reads.select("read_id"), "read_id", "left_anti"), 10)
        if missing is None or missing:
            raise EngineError(ErrorCode.INVALID_READ_ID, str([r["read_id"] for r in missing or []]))
        reads = wanted.join(reads, "read_id")
    size = F.length("seq")
    change = {
        "seq": [] if "seq" in chosen else [("seq", F.repeat(F.lit("N"), size))],
        "qual": [] if "qual" in chosen else [("qual", F.array_repeat(F.lit(255), size))],
        "meta": [] if "meta" in chosen else [("flag", F.lit(0).cast("bigint")), ("cigar", F.concat(size.cast("string"), F.lit("M"))), ("aux", F.lit(None).cast("binary"))],
        "map": [] if "map" in chosen else [("chrom", F.lit(None).cast("string")), ("pos", F.lit(0).cast("bigint"))],
    }
    blank = {n: c for cols in change.values() for n, c in cols if n in reads.columns}
    return reads.select(*[blank.get(c, F.col(c)).alias(c) for c in reads.columns])


def reads_without(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads that hold none of the searched patterns."""
    return reads.join(hits.select("record_id").distinct(), "record_id", "left_anti")


def invariants(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """check, bad: how many rows break each rule of the order: dense ids, ascending order (repeated rows may share a key), text places that follow each
    other, known contigs, positions from 1, lengths above 0. Neighbours are compared by a join on read_id."""
    before = reads.select((F.col("read_id") + 1).alias("read_id"), *[F.col(c).alias(f"b_{c}") for c in ("build_id", "chrom_id", "pos", "source_file_id", "bam_offset", "record_id", "s_start", "l_seq")])
    pairs = reads.join(before, "read_id", "left")
    key = lambda p: F.struct(*[F.col(f"{p}{c}") for c in ("build_id", "chrom_id", "pos", "source_file_id", "bam_offset", "record_id")])
    known = contigs.select(F.col("chrom_id").alias("__known"))
    rows = pairs.join(known, pairs["chrom_id"] == known["__known"], "left")
    follows = F.when(F.col("b_build_id") == F.col("build_id"), F.col("s_start") == F.col("b_s_start") + F.col("b_l_seq") + 1).otherwise(F.col("s_start") == 0)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    checks = {
        "dense_ids": n(F.col("b_build_id").isNull() & (F.col("read_id") != 0)),
        "order": n(F.col("b_build_id").isNotNull() & (key("b_") > key(""))),
        "text_places": n(~follows),
        "contigs": n(F.col("__known").isNull()),
        "positions": n(F.col("pos") < 1),
        "lengths": n(F.col("l_seq") < 1),
    }
    row = rows.agg(*[c.alias(name) for name, c in checks.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("bad")) for name in checks])))
