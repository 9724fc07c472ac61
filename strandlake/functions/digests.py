"""Digests: of headers, of the order of reads, of tables."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import materialize


def manifest(headers: list[tuple[str, bytes]]) -> str:
    """SHA-256 over (length of the name, name, SHA-256 of the header) of every file, in the order given."""
    whole = hashlib.sha256()
    for name, header in headers:
        raw = name.encode()
        whole.update(struct.pack("<I", len(raw)) + raw + hashlib.sha256(header).digest())
    return whole.hexdigest()


def little_endian(value: Column, size: int) -> Column:
    """The low `size` bytes of an integer, low byte first, as binary."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def order_record(chrom_id: Column, pos: Column, source_file_id: Column, bam_offset: Column) -> Column:
    """The 24 bytes that stand for one read in the ordering digest."""
    return F.concat(little_endian(chrom_id, 4), little_endian(pos, 8), little_endian(source_file_id, 4), little_endian(bam_offset, 8))


def ordering_digest(reads: DataFrame) -> str:
    """SHA-256 of the order records in read_id order. One pass on the driver, which takes one partition at a time: the
    digest is defined over one byte stream. For large tables use ordering_tree."""
    rows = reads.select("read_id", order_record(*[F.col(c) for c in ("chrom_id", "pos", "source_file_id", "bam_offset")]).alias("b")).orderBy("read_id")
    whole = hashlib.sha256()
    for r in rows.toLocalIterator():
        whole.update(r["b"])
    return whole.hexdigest()


def ordering_tree(reads: DataFrame, leaf: int = 4096) -> str:
    """A digest of the same order for any size, of another value: SHA-256 over runs of `leaf` reads, then over runs of
    those digests, until one is left."""
    rows = reads.select(F.col("read_id").alias("i"), order_record(*[F.col(c) for c in ("chrom_id", "pos", "source_file_id", "bam_offset")]).alias("b"))
    while True:
        parts = rows.groupBy(F.floor(F.col("i") / leaf).cast("bigint").alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", F.hex("b").alias("h")))).alias("x"))
        rows = materialize(parts.select(F.col("g").alias("i"), F.unhex(F.sha2(F.unhex(F.array_join(F.transform("x", lambda y: y["h"]), "")), 256)).alias("b")), "tree")
        if rows.limit(2).count() < 2:
            first = rows.first()
            return first["b"].hex() if first else hashlib.sha256().hexdigest()


def table_checksum(df: DataFrame) -> int:
    """An order-free checksum of a table's rows: the sum of their 64-bit hashes, held within 64 bits."""
    return stream_checksums(df, {"all": sorted(df.columns)})["all"]


def stream_checksums(df: DataFrame, streams: dict[str, list[str]]) -> dict[str, int]:
    """The same of several column groups, in one pass."""
    hashes = [F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")).alias(name) for name, columns in streams.items()]
    row = df.agg(*hashes).first()
    return {name: int(row[name] or 0) & (1 << 64) - 1 for name in streams}
