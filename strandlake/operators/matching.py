"""Exact pattern queries on reads: count, existence, locate, and their region and batch forms.

A match lies inside one read, so every query is a scan of the reads' own bases: no index decides the result, column
pruning leaves seq (and, to locate, pos and cigar), a `contains` test drops nearly all rows before any position is looked
for, and coordinates come from the row itself. Nothing is shuffled before the hits, which are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.mapping import match_intervals, with_match_interval
from strandlake.functions.patterns import Region, orientations, parse
from strandlake.operators.ordering import with_rank
from strandlake.schema import EngineError, ErrorCode, Overlap, Strand
from strandlake.session import materialize

#: Up to so many words are searched by one expression each; more are joined by hash on all substrings of their lengths.
MANY_WORDS = 64
LONG = 1024

_HIT = "array<struct<pattern:string,strand:string,offset:bigint,width:bigint>>"


def _words(patterns: list[str], strand: Strand) -> list[tuple[str, str, str]]:
    """(pattern, word, strand), patterns without repetition."""
    return [(p, w, s) for p in dict.fromkeys(parse(x) for x in patterns) for w, s in orientations(p, strand)]


def _places(seq: Column, word: Column) -> Column:
    n = F.length(word)
    return F.filter(F.sequence(F.lit(0), F.length(seq) - n), lambda i: seq.substr(i + 1, n) == word)


def _offsets(seq: Column, word: Column) -> Column:
    """Starts of the word in seq, which contains it. substr() counts characters from the start, so a long sequence is
    searched in overlapping blocks of LONG bases, each only if it contains the word."""

    # each block is made once, as an element of an array: an expression inside a lambda would be made for every place
    cut = F.transform(F.sequence(F.lit(0), F.length(seq) - 1, F.lit(LONG)), lambda start: F.struct(start.alias("start"), seq.substr(start + 1, F.length(word) + (LONG - 1)).alias("bases")))

    def inside(block: Column) -> Column:
        found = F.transform(_places(block["bases"], word), lambda i: i + block["start"])
        return F.when(block["bases"].contains(word), found).otherwise(F.array().cast("array<int>"))

    blocks = F.flatten(F.transform(cut, inside))
    return F.when(F.length(seq) <= 2 * LONG, _places(seq, word)).otherwise(blocks)


def _any(seq: Column, words: list[tuple[str, str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [seq.contains(w) for _, w, _ in words])


def _found(seq: Column, words: list[tuple[str, str, str]]) -> Column:
    """The occurrences of all words in a read, as an array of _HIT entries: one expression over a constant list of words,
    so that the plan doesn't grow with their number."""
    known = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("word"), F.lit(sign).alias("strand")) for p, w, sign in words])

    def entries(x: Column) -> Column:
        width = F.length(x["word"]).cast("bigint").alias("width")
        one = lambda i: F.struct(x["pattern"].alias("pattern"), x["strand"].alias("strand"), i.cast("bigint").alias("offset"), width)
        return F.when(seq.contains(x["word"]), F.transform(_offsets(seq, x["word"]), one)).otherwise(F.array().cast(_HIT))

    return F.flatten(F.transform(known, entries))


def _taken(places: Column, width: int) -> Column:
    """How many of the ascending places stand when each must start at or after the end of the last one taken."""
    kind = "struct<end:int,n:int>"

    def step(state: Column, i: Column) -> Column:
        return F.when(i >= state["end"], F.struct((i + width).alias("end"), (state["n"] + 1).alias("n"))).otherwise(state).cast(kind)

    return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")).cast(kind), step, lambda state: state["n"])


def hits(reads: DataFrame, patterns: list[str], strand: Strand = Strand.COMPLETE, seq: str = "seq") -> DataFrame:
    """The columns of reads and pattern, strand, offset (0-based), width: every, also overlapping, occurrence.

    Null and short sequences have no occurrences; N matches only N; repeated patterns count once; repeated rows each give
    their hits; an empty table gives none. A column of reads named like an output column is replaced.
    """
    words = _words(patterns, strand)
    reads = reads.drop("pattern", "strand", "offset", "width")
    s = F.col(seq)
    if len(words) <= MANY_WORDS:
        return reads.where(_any(s, words)).select("*", F.inline(_found(s, words)))
    spark = reads.sparkSession
    table = spark.createDataFrame([(w, p, sign, len(w)) for p, w, sign in words], "__word string, pattern string, strand string, width bigint")
    out = None
    for n in sorted({len(w) for _, w, _ in words}):
        starts = F.sequence(F.lit(0).cast("bigint"), F.length(s).cast("bigint") - n)
        parts = reads.where(F.length(s) >= n).select("*", F.explode(starts).alias("offset")).withColumn("__word", s.substr((F.col("offset") + 1).cast("int"), F.lit(n)))
        part = parts.join(table.where(F.col("width") == n), "__word").drop("__word")
        part = part.select(*reads.columns, "pattern", "strand", "offset", "width")
        out = part if out is None else out.unionByName(part)
    return out


def count_matches(reads: DataFrame, patterns: list[str], strand: Strand = Strand.COMPLETE, overlap: Overlap = Overlap.ALL, seq: str = "seq") -> DataFrame:
    """pattern, n: a row for every pattern, 0 included.

    All occurrences of up to MANY_WORDS words are counted by one expression per word and one partial aggregation, without
    positions; those of more by the hash join of hits(). Without
    overlaps, the occurrences of both strands are taken from left to right within a read, each if it starts at or after
    the end of the last one taken.
    """
    words = _words(patterns, strand)
    names = list(dict.fromkeys(p for p, _, _ in words))
    if len(words) > MANY_WORDS:
        if overlap is Overlap.ALL:  # one hash join, whatever their number
            found = hits(reads.select(seq), names, strand, seq).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
            asked = reads.sparkSession.createDataFrame([(n,) for n in names], "pattern string")
            return asked.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        parts = [count_matches(reads, names[i : i + MANY_WORDS // 2], strand, overlap, seq) for i in range(0, len(names), MANY_WORDS // 2)]
        return reduce(DataFrame.unionByName, parts)
    s = F.col(seq)
    if overlap is Overlap.ALL:
        each = [F.sum(reduce(lambda a, b: a + b, [F.when(s.contains(w), F.regexp_count(s, F.lit(f"(?={w})"))).otherwise(0) for p, w, _ in words if p == name])) for name in names]
    else:
        each = []
        for name in names:
            own = [w for p, w, _ in words if p == name]
            places = F.array_sort(F.concat(*[F.when(s.contains(w), _offsets(s, F.lit(w))).otherwise(F.array().cast("array<int>")) for w in own]))
            each.append(F.sum(F.when(reduce(lambda a, b: a | b, [s.contains(w) for w in own]), _taken(places, len(name))).otherwise(0)))
    row = reads.agg(*[F.coalesce(e, F.lit(0)).cast("bigint").alias(f"c{i}") for i, e in enumerate(each)])
    pairs = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)])
    return row.select(F.inline(pairs))


def exists(reads: DataFrame, pattern: str, threshold: int = 1, strand: Strand = Strand.COMPLETE, seq: str = "seq") -> DataFrame:
    """One row, exists: whether there are at least max(1, threshold) occurrences. The scan ends once enough are found."""
    need = max(1, threshold)
    found = hits(reads.select(seq), [pattern], strand, seq) if need > 1 else reads.where(reduce(lambda a, b: a | b, [F.col(seq).contains(w) for _, w, _ in _words([pattern], strand)])).select(seq)
    return found.limit(need).agg((F.count(F.lit(1)) >= need).alias("exists"))


def locate(reads: DataFrame, patterns: list[str], strand: Strand = Strand.COMPLETE) -> DataFrame:
    """Every occurrence with its place on the contig: pattern, strand, chrom_id, p_min, p_max, record_id, offset, sa_key,
    then the other columns of reads but seq and cigar.

    reads: record_id, chrom_id, pos, cigar, seq. sa_key orders matches of one read as a suffix array over the build's text
    would ($ < A < C < G < T < N < #): no two suffixes of a read are equal before its separator.
    """
    reads = reads.drop("p_min", "p_max", "sa_key", "pattern", "strand", "offset", "width")
    words = _words(patterns, strand)
    if len(words) <= MANY_WORDS:
        s = F.col("seq")
        # as a generator's output a read's matches are made once, and placed together: long reads hold many
        held = reads.where(_any(s, words)).select("*", F.explode(F.array(_found(s, words))).alias("__hits"))
        held = held.withColumn("__ends", match_intervals(F.col("cigar"), F.col("pos"), F.col("__hits")))
        both = F.zip_with("__hits", "__ends", lambda h, e: F.struct(*[h[c].alias(c) for c in ("pattern", "strand", "offset", "width")], *[e[c].alias(c) for c in ("p_min", "p_max")]))
        found = held.select(*reads.columns, F.inline(both))
    else:
        found = with_match_interval(hits(reads, patterns, strand))
    key = F.concat(F.translate(F.col("seq").substr((F.col("offset") + 1).cast("int"), F.length("seq")), "ACGTN", "ABCDE"), F.lit("F"))
    return found.withColumn("sa_key", key).drop("seq", "cigar", "width")


#: Order of reported matches: forward before reverse, then contig, place, read, suffix.
LOCATE_ORDER = ["strand_rank", "chrom", "p_min", "p_max", "read_id", "sa_key"]


#: Order of the suffixes that matches begin, forward block first; suffixes that agree up to the read's end go by read.
SUFFIX_ORDER = ["strand_rank", "sa_key", "read_id"]


def sorted_matches(matches: DataFrame, limit: int | None = None, by_suffix: bool = False) -> DataFrame:
    """matches (with chrom and read_id) and ord, their place per pattern in the reported order, or in suffix order; the
    first `limit` only, if given: a top-k, of which each task keeps no more than k."""
    ranked = matches.withColumn("strand_rank", (F.col("strand") != "+").cast("int"))
    order = ["pattern", *(SUFFIX_ORDER if by_suffix else LOCATE_ORDER)]
    if limit is not None:
        ranked = ranked.orderBy(*order).limit(limit)
    # a range sort samples its input first: the search behind it should run once
    return with_rank(materialize(ranked, "matches"), order, "ord").drop("strand_rank", "sa_key")


def in_region(matches: DataFrame, chrom_id: int | None, region: Region) -> DataFrame:
    """Matches that overlap a region, ends included; an unknown contig (None) has none."""
    if chrom_id is None:
        return matches.where(F.lit(False))
    return matches.where((F.col("chrom_id") == chrom_id) & (F.col("p_min") <= region.end) & (F.col("p_max") >= region.start))


def near_region(reads: DataFrame, chrom_id: int | None, region: Region, longest_span: int | None = None) -> DataFrame:
    """Reads that may hold a match in the region: the contig and pos reach the Parquet scan as filters; no base of a read
    lies before its pos, and none after pos + span - 1. longest_span, where it is known, bounds pos from below too."""
    if chrom_id is None:
        return reads.where(F.lit(False))
    near = reads.where((F.col("chrom_id") == chrom_id) & (F.col("pos") <= region.end))
    return near if longest_span is None else near.where(F.col("pos") >= region.start - max(longest_span, 1) + 1)


def region_batch(matches: DataFrame, regions: DataFrame, bin_width: int = 1 << 16) -> DataFrame:
    """region, pattern, n for every pair of region (region, chrom_id, start, end) and pattern with matches: an interval
    join by bins. A match takes the bins it touches, a region those it touches; a pair counts in its first common bin."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width).cast("bigint"), F.floor(F.col(b) / bin_width).cast("bigint"))).alias("bin")
    m = matches.select("pattern", "chrom_id", "p_min", "p_max", span("p_min", "p_max"))
    r = regions.select("region", "chrom_id", "start", "end", span("start", "end"))
    first = F.floor(F.greatest("p_min", "start") / bin_width).cast("bigint")
    joined = m.join(r, ["chrom_id", "bin"]).where((F.col("p_min") <= F.col("end")) & (F.col("p_max") >= F.col("start")) & (F.col("bin") == first))
    return joined.groupBy("region", "pattern").agg(F.count(F.lit(1)).alias("n"))


def approximate(*_: object, **__: object) -> None:
    """Approximate search is refused: results are exact or none."""
    raise EngineError(ErrorCode.NOT_IMPLEMENTED, "approximate matching")
