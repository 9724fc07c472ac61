"""Expressions on CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ops(cigar: Column) -> Column:
    """ARRAY<STRUCT<op STRING, len BIGINT>> of a CIGAR string; null and '*' give an empty array."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            F.substring(x, -1, 1).alias("op"),
            F.rtrim(x, F.lit("MIDNSHP=X")).cast("bigint").alias("len"),
        ),
    )


def _total(cigar: Column, letters: str) -> Column:
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(rf"(\d+)[{letters}]"), 1)
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, n: total + n.cast("bigint"))


def ref_span(cigar: Column) -> Column:
    """Bases of the reference covered: the lengths of M, D, N, = and X. One-op CIGARs skip the regular expression list."""
    one = F.regexp_extract(cigar, r"^(\d+)[MDN=X]$", 1)
    return F.when(one != "", one.cast("bigint")).otherwise(_total(cigar, "MDN=X"))


def read_span(cigar: Column) -> Column:
    """Bases of the read consumed: the lengths of M, I, S, = and X."""
    return _total(cigar, "MIS=X")
