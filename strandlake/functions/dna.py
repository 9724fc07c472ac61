"""Expressions on bases, read names and flags; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits that exclude a record: unmapped, secondary, supplementary.
EXCLUDED_FLAGS = 0x4 | 0x100 | 0x800
DUPLICATE, QC_FAIL, MATE_BITS = 0x400, 0x200, 0xC0

#: Seven colon-separated fields; whatever stands around them is decoration.
READ_NAME = r"([A-Za-z0-9]+(?::[A-Za-z0-9]+){6})"


def has_sequence(seq: Column) -> Column:
    """True where seq holds bases: null, '' and '*' mean no sequence."""
    return seq.isNotNull() & ~seq.isin("", "*")


def bases(seq: Column) -> Column:
    """Upper case, everything but A, C, G, T read as N; null, '' and '*' give null."""
    up = F.upper(seq)
    return F.when(has_sequence(seq), F.when(up.rlike("[^ACGT]"), F.regexp_replace(up, "[^ACGT]", "N")).otherwise(up))


def reverse_complement(seq: Column) -> Column:
    """Reverse the bases and exchange A-T and C-G; N stays."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def included_flags(flag: Column) -> Column:
    """The flag half of the inclusion rule; a null flag excludes."""
    return flag.bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0


def read_name(qname: Column) -> Column:
    """The seven fields of a read name in upper case, without decoration; null where there are none."""
    found = F.upper(F.regexp_extract(qname, READ_NAME, 1))
    return F.when(found != "", found)


def usable_mapq(mapq: Column) -> Column:
    """mapq, or null where it is null or 255 (not available)."""
    return F.when(mapq != 255, mapq)
