"""Parsing and orienting of patterns and regions, at plan time."""

from __future__ import annotations

from typing import NamedTuple

from strandlake.schema import EngineError, ErrorCode, Strand

LAST = (1 << 63) - 1
_PAIRS = str.maketrans("ACGT", "TGCA")


def parse(text: str) -> str:
    """Case-insensitive A, C, G, T; every other character stands for N; an empty pattern is refused."""
    if not text:
        raise EngineError(ErrorCode.EMPTY_PATTERN, "a pattern needs at least one base")
    return "".join(c if c in "ACGT" else "N" for c in text.upper())


def reverse_complement(word: str) -> str:
    return word[::-1].translate(_PAIRS)


def orientations(pattern: str, strand: Strand = Strand.COMPLETE) -> list[tuple[str, str]]:
    """(word, '+' or '-'): a pattern that is its own reverse complement is searched once, as '+'."""
    word = parse(pattern)
    other = reverse_complement(word)
    return [(word, "+")] if strand is Strand.SINGLE or other == word else [(word, "+"), (other, "-")]


class Region(NamedTuple):
    chrom: str
    start: int = 0
    end: int = LAST


def parse_region(text: str) -> Region:
    """chr:a-b; 'chr:' is the whole contig; an open end runs to the largest position."""
    chrom, colon, span = text.rpartition(":")
    if not colon or not chrom:
        raise EngineError(ErrorCode.INVALID_REGION, text)
    first, dash, last = span.partition("-")
    try:
        return Region(chrom, int(first) if dash and first else 0, int(last) if dash and last else LAST)
    except ValueError:
        raise EngineError(ErrorCode.INVALID_REGION, text) from None
