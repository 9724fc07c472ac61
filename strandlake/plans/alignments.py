"""Registered queries for the read operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import cigar, codecs, dna, quality
from strandlake.functions.mapping import with_placed_ops
from strandlake.functions.patterns import Region, orientations
from strandlake.operators import bits, fm, matching, ordering, postings, records, windows
from strandlake.plans.index import ReadIndex
from strandlake.schema import BuildConfig, Overlap, Strand
from strandlake.session import drop_later, materialize, shared_dir
from strandlake.sources import alignment_files, sinks
from strandlake.sources.tables import contig_names, included_reads, table

MOTIFS = ["ACGT", "CCTAACAG", "GGATCCTA", "AGCAGCAG", "TGACGTCA", "ATTCCATTCG", "TTGGGATTGGGA", "GATTACA", "TTAGGG", "CCGGTTAA"]
PALINDROMES = ["TGACGTCA", "CCGGTTAA", "GAATTC"]
REGIONS = [("chr1_left", "chr1", 1, 30_000_000), ("chr7_all", "chr7", 0, (1 << 40)), ("chrM_mid", "chrM", 5_000, 12_000)]
WINDOW = 20_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _contigs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "contigs").select("chrom_id", F.col("contig_name").alias("chrom"))


def _chrom_id(spark: SparkSession, folder: str, chrom: str) -> int | None:
    row = contig_names(spark, folder).where(F.col("chrom_key") == chrom.strip().lower()).first()
    return row["chrom_id"] if row else None


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return records.indexed_reads(spark, folder, "seq")


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    return records.indexed_reads(spark, folder, "seq", "cigar")


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ordered_reads")


def _named(matches: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Matches with contig names and read ids: joined to the hits, after the scan."""
    return records.with_read_ids(matches, spark, folder).join(_contigs(spark, folder), "chrom_id")


def _report(matches: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return _named(matches, spark, folder).select("pattern", *sinks.MATCH)


# --- ingest and order


@query
def ingest_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = included_reads(spark, folder, "record_id", "mapq", "seq")
    return rows.select("record_id", "chrom_id", "pos", "flag", "mapq", F.length(dna.bases(F.col("seq"))).cast("bigint").alias("l_seq"))


@query
def normalised_bases(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder).select("record_id", "seq")


@query
def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Ids by byte order of the names; the dictionary has a fixed number of rows."""
    names = table(spark, folder, "contigs").select("contig_name").distinct()
    return names.select((F.row_number().over(Window.orderBy("contig_name")) - 1).cast("bigint").alias("chrom_id"), "contig_name")


@query
def order_reads(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.indexed_reads(spark, folder, "source_file_id", "bam_offset")
    return ordering.order_reads(rows).select("read_id", "build_id", "record_id", "chrom_id", "pos", "source_file_id", "bam_offset", "l_seq", "s_start")


@query
def read_starts(spark: SparkSession, folder: str) -> DataFrame:
    return order_reads(spark, folder).select("read_id", "s_start")


@query
def s_length(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.text_lengths(_ordered(spark, folder))


# --- CIGAR and bases


@query
def cigar_ops(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_placed_ops(records.indexed_reads(spark, folder, "cigar"), F.col("cigar"), F.col("pos"), "ops")
    return rows.select("record_id", F.posexplode("ops").alias("op_idx", "o")).select("record_id", F.col("op_idx").cast("bigint").alias("op_idx"), "o.*")


@query
def cigar_ref_span(spark: SparkSession, folder: str) -> DataFrame:
    return records.indexed_reads(spark, folder, "cigar").select("record_id", cigar.ref_span(F.col("cigar")).alias("span"))


@query
def reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder).select("record_id", dna.reverse_complement(F.col("seq")).alias("rc"))


@query
def pattern_orientations(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(p, w, s) for p in [*MOTIFS, *PALINDROMES, "ACGNT"] for w, s in orientations(p)]
    return spark.createDataFrame(sorted(set(rows)), "pattern string, word string, strand string")


# --- the five queries


@query
def batch_motif_count(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), MOTIFS)


@query
def global_count_complete(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), ["ACGTA"])


@query
def global_count_single(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), MOTIFS, Strand.SINGLE)


@query
def global_count_palindrome(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), PALINDROMES)


@query
def global_count_nonoverlap(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), ["AAA", "ACAGACAG", *MOTIFS], overlap=Overlap.NONE)


@query
def global_count_with_n(spark: SparkSession, folder: str) -> DataFrame:
    return matching.count_matches(_scan(spark, folder), ["NNNN", "ANC", "brca1"])


@query
def global_exists(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exists(_scan(spark, folder), "GATTACA")


@query
def global_exists_absent(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exists(_scan(spark, folder), "ACGTNACGTNACGT")


@query
def global_exists_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exists(_scan(spark, folder), "ACGT", threshold=50)


@query
def locate_all(spark: SparkSession, folder: str) -> DataFrame:
    """All matches of the motifs with their place in the reported order."""
    found = _named(matching.locate(_aligned(spark, folder), MOTIFS), spark, folder)
    return matching.sorted_matches(found).select("ord", "pattern", *sinks.MATCH)


@query
def locate_single_strand(spark: SparkSession, folder: str) -> DataFrame:
    return _report(matching.locate(_aligned(spark, folder), MOTIFS, Strand.SINGLE), spark, folder)


@query
def locate_clipped(spark: SparkSession, folder: str) -> DataFrame:
    rows = _aligned(spark, folder).where(F.col("cigar").contains("S"))
    return _report(matching.locate(rows, MOTIFS), spark, folder)


@query
def locate_indel(spark: SparkSession, folder: str) -> DataFrame:
    rows = _aligned(spark, folder).where(F.col("cigar").rlike("[IDN]"))
    return _report(matching.locate(rows, ["ACG", "TTG", "CCA"]), spark, folder)


@query
def locate_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = _named(matching.locate(_aligned(spark, folder), ["ACGT"]), spark, folder)
    return matching.sorted_matches(found, 25).select("ord", "pattern", *sinks.MATCH)


@query
def locate_suffix_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first matches in suffix order, forward strand first: what a capped unsorted search reports."""
    found = _named(matching.locate(_aligned(spark, folder), ["TTAGGG"]), spark, folder)
    return matching.sorted_matches(found, 40, by_suffix=True).select("ord", "pattern", *sinks.MATCH)


@query
def locate_many_words(spark: SparkSession, folder: str) -> DataFrame:
    """The hash-join form of the search: all 6-base words that begin with GA, on both strands."""
    words = ["GA" + a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]
    return matching.hits(_scan(spark, folder), words).groupBy("pattern", "strand").agg(F.count(F.lit(1)).alias("n"))


@query
def locate_bed(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.bed(_named(matching.locate(_aligned(spark, folder), ["TTAGGG"]), spark, folder))


@query
def locate_json_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.json_summary(matching.locate(_aligned(spark, folder), ["TTAGGG"]))


@query
def locate_json_document(spark: SparkSession, folder: str) -> DataFrame:
    """One document of the first 25 matches in the reported order."""
    found = _named(matching.locate(_aligned(spark, folder), ["ACGT"]), spark, folder)
    return sinks.json_document(matching.sorted_matches(found, 25))


@query
def word_postings(spark: SparkSession, folder: str) -> DataFrame:
    """How many reads hold each word of six bases."""
    reads = _scan(spark, folder).select(F.col("record_id").alias("read_id"), "seq")
    return postings.build_postings(reads, 6).groupBy("word").agg(F.count(F.lit(1)).alias("n_reads"))


@query
def count_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    """A count by way of postings of eight bases."""
    reads = _scan(spark, folder).select(F.col("record_id").alias("read_id"), "seq")
    found = postings.candidates(reads, materialize(postings.build_postings(reads, 8), "postings"), 8, "TTGGGATTGGGA")
    return matching.count_matches(found, ["TTGGGATTGGGA"])


def _in_region(spark: SparkSession, folder: str, pattern: str, region: Region) -> DataFrame:
    chrom = _chrom_id(spark, folder, region.chrom)
    near = matching.near_region(_aligned(spark, folder), chrom, region)
    return matching.in_region(matching.locate(near, [pattern]), chrom, region)


@query
def region_count(spark: SparkSession, folder: str) -> DataFrame:
    return _in_region(spark, folder, "ACGT", Region("chrM", 1_000, 9_000)).agg(F.count(F.lit(1)).alias("region_count"))


@query
def region_count_unknown_chrom(spark: SparkSession, folder: str) -> DataFrame:
    return _in_region(spark, folder, "ACGT", Region("no_such_contig")).agg(F.count(F.lit(1)).alias("region_count"))


@query
def region_exists_t1(spark: SparkSession, folder: str) -> DataFrame:
    return _in_region(spark, folder, "GATTACA", Region("chrM")).limit(1).agg((F.count(F.lit(1)) >= 1).alias("region_exists"))


@query
def region_exists_t5(spark: SparkSession, folder: str) -> DataFrame:
    return _in_region(spark, folder, "ACGT", Region("chr1")).limit(5).agg((F.count(F.lit(1)) >= 5).alias("region_exists"))


def _pruned(spark: SparkSession, folder: str, pattern: str, region: Region) -> DataFrame:
    """Matches in a region by way of the windows: only reads of windows that touch the region are searched. Windows lie in
    one contig, so only this contig's reads are cut into them."""
    chrom = _chrom_id(spark, folder, region.chrom)
    if chrom is None:
        return matching.in_region(matching.locate(_aligned(spark, folder), [pattern]), None, region)
    order = _ordered(spark, folder).where(F.col("chrom_id") == chrom)
    spans = records.indexed_reads(spark, folder, "cigar").where(F.col("chrom_id") == chrom).select("record_id", cigar.ref_span(F.col("cigar")).alias("span"))
    made = windows.window_table(order.join(spans, "record_id"), WINDOW)
    kept = windows.windows_of_region(made, chrom, region.start, region.end).select("build_id", "first_read_id", "last_read_id")
    inside = order.join(kept, "build_id").where("read_id between first_read_id and last_read_id")
    reads = matching.near_region(_aligned(spark, folder), chrom, region).join(inside.select("record_id"), "record_id", "left_semi")
    return matching.in_region(matching.locate(reads, [pattern]), chrom, region)


@query
def region_count_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return _pruned(spark, folder, "ACGT", Region("chrM", 1_000, 9_000)).agg(F.count(F.lit(1)).alias("region_count"))


@query
def region_exists_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Existence by the windows, at two thresholds."""
    found = _pruned(spark, folder, "GATTACA", Region("chrM", 1_000, 9_000))
    return found.limit(3).agg((F.count(F.lit(1)) >= 1).alias("once"), (F.count(F.lit(1)) >= 3).alias("thrice"))


# --- batches and reports


@query
def batch_region_motif_count(spark: SparkSession, folder: str) -> DataFrame:
    regions = spark.createDataFrame(REGIONS, "region string, chrom string, start bigint, end bigint").join(_contigs(spark, folder), "chrom")
    # an open region ends at the last match of its contig, so that its bins are bounded and no match is lost
    found = materialize(matching.locate(_aligned(spark, folder), MOTIFS).select("pattern", "chrom_id", "p_min", "p_max"), "matches")
    last = found.groupBy("chrom_id").agg(F.max("p_max").alias("last"))
    regions = regions.join(last, "chrom_id").withColumn("end", F.least("end", "last")).where("start <= end")
    return matching.region_batch(found, regions)


@query
def count_by_chrom(spark: SparkSession, folder: str) -> DataFrame:
    found = matching.hits(_scan(spark, folder), ["ACGT"]).groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n"))
    return _contigs(spark, folder).join(found, "chrom_id", "left").select("chrom", F.coalesce("n", F.lit(0)).alias("n"))


@query
def count_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return matching.hits(_scan(spark, folder), ["TTAGGG"]).rollup("chrom_id", "strand").agg(F.count(F.lit(1)).alias("n"))


@query
def reads_containing(spark: SparkSession, folder: str) -> DataFrame:
    """Reads with the motif as written, beside its occurrences: what a line count would give, and their ratio."""
    found = matching.hits(_scan(spark, folder), ["ACGT", "TTAGGG", "GATTACA"], Strand.SINGLE)
    out = found.groupBy("pattern").agg(F.count_distinct("record_id").alias("n_reads"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ratio", F.col("n") / F.col("n_reads"))


@query
def reads_without_motif(spark: SparkSession, folder: str) -> DataFrame:
    reads = _scan(spark, folder)
    return records.reads_without(reads.select("record_id"), matching.hits(reads, ["ACGT"]))


@query
def quality_postfilter(spark: SparkSession, folder: str) -> DataFrame:
    """Matches on reads of mean quality 20 or more over all bases; a base without a value counts as 0."""
    reads = records.indexed_reads(spark, folder, "seq", "cigar", "qual")
    total = F.aggregate(quality.filled(F.col("qual"), F.col("l_seq")), F.lit(0).cast("bigint"), lambda s, q: s + q)
    return _report(matching.locate(reads.where(total >= 20 * F.col("l_seq")), ["ACGT", "TTAGGG"]), spark, folder)


@query
def repeated_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the same file and place that were delivered more than once."""
    rows = table(spark, folder, "reads_raw").groupBy("source_file_id", "bam_offset").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
    return rows.where("n > 1")


# --- windows and text places


@query
def windows_table(spark: SparkSession, folder: str) -> DataFrame:
    spans = records.indexed_reads(spark, folder, "cigar").select("record_id", cigar.ref_span(F.col("cigar")).alias("span"))
    return windows.window_table(_ordered(spark, folder).join(spans, "record_id"), WINDOW)


@query
def window_prune_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return windows.windows_of_region(windows_table(spark, folder), 27, 1_000, 9_000)


@query
def read_to_window(spark: SparkSession, folder: str) -> DataFrame:
    return windows.with_window(_ordered(spark, folder), WINDOW).select("read_id", "build_id", F.col("l").alias("window_start"))


@query
def text_place_to_read(spark: SparkSession, folder: str) -> DataFrame:
    """Text places of hits, and of every read's end, back to reads: the as-of join of places with read starts."""
    order = _ordered(spark, folder)
    found = records.with_read_ids(matching.hits(_scan(spark, folder), ["TTAGGG"]).drop("build_id"), spark, folder, "build_id", "s_start")
    places = found.select("build_id", (F.col("s_start") + F.col("offset")).alias("s_pos"))
    places = places.unionByName(order.select("build_id", (F.col("s_start") + F.col("l_seq")).alias("s_pos")))
    return windows.read_at(places, order)


def _starts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The bit vector of read starts in every build's text, and the order table."""
    order = _ordered(spark, folder)
    lengths = ordering.text_lengths(order).withColumnRenamed("s_length", "length")
    return bits.bit_vector(order, lengths, "build_id", "s_start"), order


@query
def bits_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The rank of every read's last base among the read starts: the number of the read in its build, from 1."""
    vector, order = _starts(spark, folder)
    return bits.rank(vector, order.select("build_id", (F.col("s_start") + F.col("l_seq") - 1).alias("place")), "build_id", "place")


@query
def bits_select(spark: SparkSession, folder: str) -> DataFrame:
    """The start of the k-th read of every build, for every k up to the number of all reads."""
    vector, order = _starts(spark, folder)
    return bits.select(vector, order.select("build_id", (F.col("read_id") + 1).alias("k")), "build_id", "k")


@query
def bits_access(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a read starts at each read's start, and at the place behind it."""
    vector, order = _starts(spark, folder)
    places = order.select("build_id", F.explode(F.array(F.col("s_start"), F.col("s_start") + 1)).alias("place"))
    return bits.access(vector, places, "build_id", "place")


# --- encodings


@query
def map_delta_encode(spark: SparkSession, folder: str) -> DataFrame:
    return records.delta_positions(_ordered(spark, folder)).select("read_id", "delta")


@query
def map_delta_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Positions back from the deltas: a running sum over the whole order by blocks. The absolute value at a contig's
    first read makes the sums before it cancel."""
    coded = records.delta_positions(_ordered(spark, folder)).withColumn("all", F.lit(0))
    sums = ordering.with_running_sum(coded, "all", "read_id", "delta", "before").withColumn("sum", F.col("before") + F.col("delta"))
    first = sums.groupBy("build_id", "chrom_id").agg(F.min_by("before", "read_id").alias("start"))
    return sums.join(first, ["build_id", "chrom_id"]).select("read_id", (F.col("sum") - F.col("start")).alias("pos"))


@query
def abs_pos_dense(spark: SparkSession, folder: str) -> DataFrame:
    """The position of every read, from the deltas."""
    return map_delta_decode(spark, folder)


@query
def abs_pos_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """The reads with an absolute entry: the first of every contig in a build."""
    first = _ordered(spark, folder).groupBy("build_id", "chrom_id").agg(F.min(F.struct("read_id", "pos")).alias("first"))
    return first.select("first.read_id", "build_id", "chrom_id", "first.pos")


def _qualities(spark: SparkSession, folder: str) -> DataFrame:
    """Of every read as many values as it has bases: null arrays, null elements, 255 and an absent tail are 0."""
    rows = records.indexed_reads(spark, folder, "qual")
    return rows.select("record_id", quality.filled(F.col("qual"), F.col("l_seq")).alias("qual"))


@query
def qual_fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _qualities(spark, folder)


@query
def qual_lossy_bin(spark: SparkSession, folder: str) -> DataFrame:
    return _qualities(spark, folder).select("record_id", quality.binned(F.col("qual"), 8).alias("qual"))


@query
def qual_rans_delta(spark: SparkSession, folder: str) -> DataFrame:
    return _qualities(spark, folder).select("record_id", quality.delta(F.col("qual")).alias("qual"))


@query
def qual_rans_undelta(spark: SparkSession, folder: str) -> DataFrame:
    return _qualities(spark, folder).select("record_id", quality.undelta(quality.delta(F.col("qual"))).alias("qual"))


@query
def qual_cycle_transpose(spark: SparkSession, folder: str) -> DataFrame:
    return _qualities(spark, folder).select("record_id", quality.cycle_order(F.col("qual"), 10).alias("qual"))


@query
def qual_block_directory(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.with_read_ids(records.indexed_reads(spark, folder, "qual"), spark, folder)
    return records.block_directory(rows, F.greatest(F.coalesce(F.size("qual"), F.lit(0)), F.lit(0)).cast("bigint"))


def _meta(spark: SparkSession, folder: str, codec: str) -> DataFrame:
    rows = records.indexed_reads(spark, folder, "flag", "cigar", "aux")
    cig = F.when(F.col("cigar") != "*", F.col("cigar")).otherwise("")
    return rows.select("record_id", codecs.meta_bytes(F.col("flag"), cig, F.col("aux"), codec).alias("packed"))


@query
def stream_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The directory of all four streams by blocks of 1024 reads."""
    rows = records.with_read_ids(records.indexed_reads(spark, folder, "qual", "cigar", "aux"), spark, folder)
    rows = rows.withColumn("qual", quality.filled(F.col("qual"), F.col("l_seq"))).withColumn("cigar", F.when(F.col("cigar") != "*", F.col("cigar")))
    return records.directory(rows)


@query
def meta_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every record's packed metadata, in both layouts."""
    split, fixed = (_meta(spark, folder, c).select("record_id", F.octet_length("packed").cast("bigint").alias(n)) for c, n in (("TYPED_SPLIT", "n_bytes"), ("ZSTD_FALLBACK", "n_fixed")))
    return split.join(fixed, "record_id")


@query
def meta_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Flag, CIGAR and aux back from the packed metadata."""
    return _meta(spark, folder, "TYPED_SPLIT").select("record_id", codecs.meta_fields(F.col("packed")).alias("m")).select("record_id", "m.*")


@query
def meta_decode_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _meta(spark, folder, "ZSTD_FALLBACK").select("record_id", codecs.meta_fields(F.col("packed"), "ZSTD_FALLBACK").alias("m")).select("record_id", "m.*")


# --- suffix arrays, on the texts of seq_bundles


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "seq_bundles").select(F.col("bundle_id").alias("text_id"), "s")


@query
def suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return fm.suffix_array(_texts(spark, folder)).select("text_id", "row", "s_pos")


@query
def bwt(spark: SparkSession, folder: str) -> DataFrame:
    return fm.suffix_array(_texts(spark, folder)).select("text_id", "row", F.col("bwt").alias("symbol"))


@query
def c_array(spark: SparkSession, folder: str) -> DataFrame:
    return fm.c_array(_texts(spark, folder))


@query
def lf_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return fm.lf_mapping(fm.bwt_blocks(fm.suffix_array(_texts(spark, folder)))).select("text_id", "row", "lf")


@query
def occ_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return fm.occ_checkpoints(fm.suffix_array(_texts(spark, folder)))


@query
def bwt_runs(spark: SparkSession, folder: str) -> DataFrame:
    return fm.bwt_runs(fm.suffix_array(_texts(spark, folder)))


@query
def sa_samples(spark: SparkSession, folder: str) -> DataFrame:
    return fm.sa_samples(fm.suffix_array(_texts(spark, folder)), 64)


@query
def isa_samples(spark: SparkSession, folder: str) -> DataFrame:
    return fm.isa_samples(fm.suffix_array(_texts(spark, folder)), 64)


@query
def sa_range_count(spark: SparkSession, folder: str) -> DataFrame:
    samples = fm.sa_samples(fm.suffix_array(_texts(spark, folder)), 8)
    return fm.range_count(samples, 10, 60, 100, 900)


@query
def occ_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How often each symbol stands in the transform before some rows, at and off the blocks' bounds."""
    blocks = fm.bwt_blocks(fm.suffix_array(_texts(spark, folder)))
    places = F.array(*[F.lit(p).cast("bigint") for p in (0, 1, 63, 64, 65, 128, 500)])
    asked = table(spark, folder, "seq_bundles").select(F.col("bundle_id").alias("text_id"), F.explode(places).alias("place"))
    asked = asked.select("*", F.explode(F.array(*map(F.lit, fm.SYMBOLS))).alias("symbol"))
    return fm.rank_at(blocks, asked, "symbol", "place", "n")


@query
def backward_search(spark: SparkSession, folder: str) -> DataFrame:
    return fm.backward_search(fm.bwt_blocks(fm.suffix_array(_texts(spark, folder))), "ACGT")


def _index_of_texts(spark: SparkSession, folder: str, *kinds: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the transform, and the rows of every 16th row of the suffix array (sa) or text position (isa)."""
    sa = materialize(fm.suffix_array(_texts(spark, folder)), "suffixes")
    rows = {
        "sa": fm.sa_samples(sa, 16).select("text_id", (F.col("k") * 16).alias("row"), "s_pos"),
        "isa": fm.isa_samples(sa, 16).select("text_id", "row", (F.col("k") * 16).alias("s_pos")),
    }
    known = rows[kinds[0]]
    for kind in kinds[1:]:
        known = known.unionByName(rows[kind])
    return fm.bwt_blocks(sa), known


@query
def fm_locate(spark: SparkSession, folder: str) -> DataFrame:
    """Places of a pattern by backward search and walks to sampled rows."""
    return fm.locate_rows(*_index_of_texts(spark, folder, "sa"), "ACGT")


@query
def fm_locate_bidir(spark: SparkSession, folder: str) -> DataFrame:
    """The same with samples of both the suffix array and its inverse, which shorten the walks."""
    return fm.locate_rows(*_index_of_texts(spark, folder, "sa", "isa"), "GATTACA")


@query
def text_from_bwt(spark: SparkSession, folder: str) -> DataFrame:
    return fm.text_from_bwt(*_index_of_texts(spark, folder, "sa"))


@query
def mtf_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = fm.suffix_array(_texts(spark, folder)).select("text_id", "row", "bwt")
    return codecs.mtf_blocks(rows, ["text_id"], "row", "bwt")


@query
def rle_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = fm.suffix_array(_texts(spark, folder)).select("text_id", "row", "bwt")
    return codecs.run_lengths(rows, ["text_id"], "row", "bwt")


@query
def seq_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the transformed text, packed to bytes and unpacked again."""
    rows = fm.suffix_array(_texts(spark, folder)).select("text_id", "row", "bwt")
    return codecs.unpacked_blocks(codecs.packed_blocks(rows, ["text_id"], "row", "bwt"), ["text_id"])


@query
def bundle_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The reads of every bundle, cut at their starts."""
    rows = table(spark, folder, "seq_bundles").select("bundle_id", F.posexplode(F.split("s", "#")).alias("read_idx", "seq"))
    return rows.select("bundle_id", F.col("read_idx").cast("bigint").alias("read_idx"), "seq")


# --- files


def _round_trip(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All ordered reads, written as files to the shared folder and read again."""
    alignment_files.register(spark)
    rows = _full(spark, folder).withColumn("source_file_id", F.lit(0).cast("bigint")).withColumn("bam_offset", F.col("read_id"))
    names = [(r["contig_name"], r["contig_length"]) for r in table(spark, folder, "contigs").orderBy("chrom_id").collect()]  # the file's header
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    rows.select("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "aux").write.format(kind).mode("append").option("contigs", json.dumps(names)).save(path)
    drop_later(spark, path)
    back = spark.read.format(kind).load(path)
    return back.select("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "aux")


@query
def bam_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "bam")


@query
def sam_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "sam").drop("aux")


@query
def bam_header_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """The contigs of written files' headers, with and without reads, numbered in byte order by an index of them."""
    alignment_files.register(spark)
    names = [(r["contig_name"], r["contig_length"]) for r in table(spark, folder, "contigs").orderBy("contig_name").collect()]
    path = f"{shared_dir(spark)}/header-{uuid.uuid4().hex}"
    _full(spark, folder).select("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "aux").write.format("bam").mode("append").option("contigs", json.dumps(names)).save(path)
    drop_later(spark, path), drop_later(spark, path + "-index")
    found = list(dict.fromkeys(n for f in alignment_files.files_of(path) for n, _ in alignment_files.header_contigs(f)))
    index = ReadIndex.build(spark, spark.read.format("bam").load(path), path + "-index", header_contigs=found)
    return index.contigs.select("chrom_id", F.col("chrom").alias("contig_name"), "n_reads")


# --- the index on disk, built of all ordered reads


def _index(spark: SparkSession, folder: str, **config) -> ReadIndex:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    drop_later(spark, path)
    rows = records.indexed_reads(spark, folder, "seq", "qname", "flag", "mapq", "cigar", "qual", "aux", "source_file_id", "bam_offset")
    rows = rows.join(_contigs(spark, folder), "chrom_id").drop("chrom_id", "l_seq")
    return ReadIndex.build(spark, rows, path, BuildConfig(**config), contigs=_contigs(spark, folder))


@query
def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by an index with postings."""
    index = _index(spark, folder, word_size=8)
    rows = [(p, index.count(p)) for p in MOTIFS]
    return spark.createDataFrame(rows, "pattern string, n bigint")


@query
def index_locate(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).locate("TTAGGG").select("ord", *sinks.MATCH)


@query
def index_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Region counts and existence by an index that asks its windows first."""
    index = _index(spark, folder, enhanced=True, window_size=WINDOW)
    rows = [(name, index.region_count("ACGT", Region(*r)), index.region_exists("ACGT", Region(*r), 50)) for name, *r in REGIONS]
    return spark.createDataFrame(rows, "region string, n bigint, fifty boolean")


@query
def index_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The order that a build gives: ids and text places of all reads."""
    return _index(spark, folder).reads.select("record_id", "read_id", "build_id", "s_start", "chrom_id", "l_seq")


@query
def index_verify(spark: SparkSession, folder: str) -> DataFrame:
    """All checks of a fresh index, and of one whose reads have lost a base: which of them tell."""
    index = _index(spark, folder)
    good = index.checks(True).select("check", F.col("bad").alias("fresh"))
    seq = F.when(F.col("read_id") == 11, F.concat(F.lit("N"), F.expr("substring(seq, 2)"))).otherwise(F.col("seq"))
    index.reads = index.reads.withColumn("seq", seq)
    return good.join(index.checks(True).select("check", (F.col("bad") > 0).alias("damaged")), "check")


@query
def index_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the info document tells of an index."""
    d = _index(spark, folder, window_size=WINDOW).document()
    row = (d["N_reads"], d["S_length"], d["N_windows"], d["chrom_count"], d["source_file_count"], d["window_size_T"], d["is_lossless"], d["mode"], d["strand_mode_name"])
    return spark.createDataFrame([row], "n_reads bigint, s_length bigint, n_windows bigint, chrom_count bigint, n_files bigint, window_size bigint, is_lossless boolean, mode string, strand_mode string")


# --- management


@query
def index_info(spark: SparkSession, folder: str) -> DataFrame:
    order = _ordered(spark, folder)
    per = order.groupBy("build_id").agg(
        F.count(F.lit(1)).alias("n_reads"),
        (F.sum("l_seq") + F.count(F.lit(1)) - 1).alias("s_length"),
        F.count_distinct("chrom_id").alias("n_contigs_with_reads"),
        F.count_distinct("source_file_id").alias("n_files"),
        F.min("l_seq").alias("shortest"),
        F.max("l_seq").alias("longest"),
    )
    n = windows_table(spark, folder).groupBy("build_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return per.join(n, "build_id")


@query
def verify_windows(spark: SparkSession, folder: str) -> DataFrame:
    order = _ordered(spark, folder)
    spans = records.indexed_reads(spark, folder, "cigar").select("record_id", cigar.ref_span(F.col("cigar")).alias("span"))
    made = materialize(windows.window_table(order.join(spans, "record_id"), WINDOW), "windows")
    return windows.window_invariants(order, made)


@query
def verify_text_index(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of suffix array, transform, LF, search and samples, on all bundles."""
    texts = _texts(spark, folder)
    return fm.invariants(texts, materialize(fm.suffix_array(texts), "suffixes"), "ACGT")


@query
def verify_text_index_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The same where the symbols of rows 3 and 7 of each text's transform were both read as N."""
    texts = _texts(spark, folder)
    sa = fm.suffix_array(texts).withColumn("bwt", F.when(F.col("row").isin(3, 7), F.lit("N")).otherwise(F.col("bwt")))
    bad = fm.invariants(texts, materialize(sa, "suffixes"), "ACGT")
    return bad.select("check", (F.col("bad") > 0).alias("found"))


@query
def verify_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The same checks on a damaged order: a position 0, a length 0, a text place moved, an unknown contig (which
    also breaks the order) and a read that is missing."""
    rows = _ordered(spark, folder)
    hit = lambda n: F.col("read_id") == n
    rows = rows.where(~hit(30)).withColumn("pos", F.when(hit(4), 0).otherwise(F.col("pos")).cast("bigint"))
    rows = rows.withColumn("l_seq", F.when(hit(9), 0).otherwise(F.col("l_seq")).cast("bigint")).withColumn("s_start", F.when(hit(15), F.col("s_start") + 3).otherwise(F.col("s_start")))
    rows = rows.withColumn("chrom_id", F.when(hit(20), 999).otherwise(F.col("chrom_id")).cast("bigint"))
    return records.invariants(rows, table(spark, folder, "contigs"))


@query
def verify_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return records.invariants(_ordered(spark, folder), table(spark, folder, "contigs"))

def _full(spark: SparkSession, folder: str) -> DataFrame:
    """The records with all four streams: qual as many values as bases, missing ones 0, and aux as it came."""
    rows = records.indexed_reads(spark, folder, "seq", "qname", "flag", "mapq", "cigar", "qual", "aux")
    rows = rows.withColumn("qual", quality.filled(F.col("qual"), F.col("l_seq")))
    return _named(rows, spark, folder).select("read_id", "qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "aux")


@query
def reconstruct_all(spark: SparkSession, folder: str) -> DataFrame:
    return records.reconstruct(_full(spark, folder))


@query
def reconstruct_streams(spark: SparkSession, folder: str) -> DataFrame:
    return records.reconstruct(_full(spark, folder), ["map"])


@query
def reconstruct_qual_meta(spark: SparkSession, folder: str) -> DataFrame:
    """The other half of the streams: bases blanked, no place."""
    return records.reconstruct(_full(spark, folder), ["qual", "meta"])


@query
def reconstruct_read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A request list is the operator's argument: order and repetitions are kept."""
    return records.reconstruct(_full(spark, folder), read_ids=[5, 3, 3, 40])
