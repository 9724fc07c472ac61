"""A read index on disk: a folder of Parquet tables and an info file.

build() filters, orders and numbers the reads, and writes them range-partitioned by contig and place, so that row groups
have narrow ranges of chrom_id, pos and read_id and Parquet's own statistics are the zone map of region queries: the
longest stretch of a read on each contig is kept, so both ends of a region bound pos. In an enhanced index the windows'
ranges of read_id are asked first. Opening is lazy: a query loads the columns it needs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import __version__
from strandlake.functions import cigar, digests, dna, quality
from strandlake.functions.patterns import Region, parse
from strandlake.operators import fm, matching, ordering, postings, records, windows
from strandlake.schema import MAP_CODECS, META_CODECS, QUALITY_CODECS, BuildConfig, EngineError, ErrorCode, Overlap, Strand
from strandlake.session import broadcast_if_small, intermediates, materialize

FORMAT = 2
MAGIC = "STLK"
_READ_COLUMNS = ["read_id", "qname", "flag", "chrom_id", "chrom", "pos", "mapq", "cigar", "seq", "l_seq", "qual", "aux", "source_file_id", "bam_offset", "record_id", "build_id", "s_start", "span"]


#: The streams of the reads table, each with a checksum of its own.
STREAMS = {"seq": ["seq"], "qual": ["qual"], "meta": ["flag", "cigar", "aux", "mapq", "qname"], "map": ["chrom_id", "chrom", "pos", "span"], "order": ["source_file_id", "bam_offset", "record_id", "build_id", "s_start", "l_seq"]}


def _repeated(df: DataFrame, column: str) -> bool:
    return not df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _checksums(reads: DataFrame, others: dict[str, DataFrame | None]) -> dict[str, int]:
    """A checksum of every stream of the reads and of every other table."""
    out = digests.stream_checksums(reads, {k: ["read_id", *v] for k, v in STREAMS.items()})
    return out | {name: digests.table_checksum(df) for name, df in others.items() if df is not None}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(hpath, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    try:
        return "\n".join(r["value"] for r in spark.read.text(path).collect())
    except Exception as e:
        raise EngineError(ErrorCode.IO_ERROR, path) from e


class ReadIndex:
    """An opened index. All query results are DataFrames but the scalar ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.info = json.loads(_read_text(spark, f"{self.path}/info.json"))
        if self.info.get("format", 0) > FORMAT:
            raise EngineError(ErrorCode.VERSION_MISMATCH, str(self.info.get("format")))
        self.strand = Strand(self.info["config"]["strand"])
        self.reads = spark.read.parquet(f"{self.path}/reads")
        self.windows = spark.read.parquet(f"{self.path}/windows")
        self.contigs = spark.read.parquet(f"{self.path}/contigs")
        self.directory = spark.read.parquet(f"{self.path}/directory")
        self.enhanced = self.info["config"]["enhanced"]
        self.overlap = Overlap(self.info["config"]["overlap"])
        self.word_size = self.info["config"].get("word_size", 0)
        self.postings = spark.read.parquet(f"{self.path}/postings") if self.word_size else None

    # --- build

    @classmethod
    def build(cls, spark: SparkSession, raw: DataFrame, path: str, config: BuildConfig | None = None, contigs: DataFrame | None = None, manifest: str = "", header_contigs: list[str] | None = None, aliases: DataFrame | None = None) -> ReadIndex:
        """raw: qname, flag, chrom, pos, mapq, cigar, seq, qual, aux, source_file_id, bam_offset (BAM and SAM sources give
        these). contigs: chrom_id, chrom, each name once. Without it, the names in raw and those of header_contigs (of the
        files' headers, also such as no read lies on), numbered in byte order. aliases: alt_name, chrom, each alt_name once:
        other spellings. Names are compared exactly; reads of contigs that aren't listed are left out. No read at all is
        refused."""
        config = config or BuildConfig()
        path = path.rstrip("/")
        with intermediates():
            return cls._build(spark, raw, path, config, contigs, manifest, header_contigs, aliases)

    @classmethod
    def _build(cls, spark: SparkSession, raw: DataFrame, path: str, config: BuildConfig, contigs: DataFrame | None, manifest: str, header_contigs: list[str] | None, aliases: DataFrame | None) -> ReadIndex:
        spelled = None
        if aliases is not None:
            spelled = aliases.select(F.col("alt_name").alias("__given"), F.col("chrom").alias("__name"))
            raw = raw.join(broadcast_if_small(spelled), raw["chrom"] == spelled["__given"], "left").withColumn("chrom", F.coalesce("__name", "chrom")).drop("__given", "__name")
        if contigs is None:
            names = raw.where("chrom is not null and chrom <> '*'").select("chrom")
            if header_contigs:
                names = names.union(spark.createDataFrame([(n,) for n in header_contigs], "chrom string"))
            contigs = ordering.with_rank(names.distinct(), ["chrom"], "chrom_id").select("chrom_id", "chrom")
        elif _repeated(contigs, "chrom") or _repeated(contigs, "chrom_id"):
            raise EngineError(ErrorCode.INVALID_CONFIG, "a contig name or id stands twice")
        if spelled is not None and _repeated(spelled, "__given"):
            raise EngineError(ErrorCode.INVALID_CONFIG, "an alias stands twice")
        names = contigs.select("chrom_id", F.col("chrom").alias("__name"))
        kept = raw.drop("chrom_id").where((F.col("pos") >= 1) & dna.included_flags(F.col("flag")) & dna.has_sequence(F.col("seq")))
        kept = kept.join(broadcast_if_small(names), F.col("chrom") == F.col("__name")).drop("__name")
        for name, default in (("build_id", F.lit(0).cast("bigint")), ("record_id", F.xxhash64("source_file_id", "bam_offset", "qname", "flag", "mapq", "cigar", "seq"))):
            if name not in kept.columns:
                kept = kept.withColumn(name, default)
        qual = quality.binned(quality.filled(F.col("qual"), F.length("seq")), config.quality_bins or (8 if config.quality_codec == "BINNED_RANGE" else 0))
        kept = kept.withColumn("seq", dna.bases(F.col("seq"))).withColumn("qual", qual).withColumn("l_seq", F.length("seq").cast("bigint")).withColumn("span", cigar.ref_span(F.col("cigar")))
        kept = kept.select(*[c for c in _READ_COLUMNS if c not in ("read_id", "s_start")]).withColumn("__width", F.col("l_seq") + 1)
        placed = ordering.with_rank_and_sum(kept, ordering.ORDER, "read_id", "build_id", "__width", "s_start")
        placed.select(*_READ_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/reads")
        reads = spark.read.parquet(f"{path}/reads")
        if reads.isEmpty():
            raise EngineError(ErrorCode.INVALID_BAM_INPUT, "no read passed the inclusion rule")
        windows.window_table(reads, config.window_size).write.mode("overwrite").parquet(f"{path}/windows")
        if config.word_size:
            postings.build_postings(reads, config.word_size).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        held = reads.groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n_reads"), F.max("span").alias("longest_span"))
        whole = contigs.select("chrom_id", "chrom").join(held, "chrom_id", "left").na.fill(0, ["n_reads", "longest_span"])
        whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/contigs")
        records.directory(reads, config.block_size).write.mode("overwrite").parquet(f"{path}/directory")
        facts = reads.agg(F.count(F.lit(1)).alias("n_reads"), F.sum("l_seq").alias("n_bases"), F.count_distinct("build_id").alias("n_builds"), F.count_distinct("source_file_id").alias("n_files"), F.min("l_seq").alias("shortest"), F.max("l_seq").alias("longest")).first().asDict()
        info = {
            "format": FORMAT,
            "engine_version": __version__,
            "built_at": int(time.time()),
            **facts,
            "s_length": facts["n_bases"] + facts["n_reads"] - facts["n_builds"],
            "n_windows": spark.read.parquet(f"{path}/windows").count(),
            "n_contigs": spark.read.parquet(f"{path}/contigs").count(),
            "mode": "ENHANCED" if config.enhanced or config.word_size else "BASE",
            "is_lossless": config.lossless,
            "manifest": manifest,
            "ordering_digest": digests.ordering_tree(reads),
            "checksums": _checksums(reads, {n: spark.read.parquet(f"{path}/{n}") for n in ("windows", "contigs", "directory", *(["postings"] if config.word_size else []))}),
            "config": asdict(replace(config, strand=config.strand.value, overlap=config.overlap.value)),
        }
        _write_text(spark, f"{path}/info.json", json.dumps(info, indent=1))
        return cls(spark, path)

    # --- properties

    @property
    def n_reads(self) -> int:
        return self.info["n_reads"]

    @property
    def s_length(self) -> int:
        return self.info["s_length"]

    @property
    def n_windows(self) -> int:
        return self.info["n_windows"]

    @property
    def chrom_count(self) -> int:
        return self.info["n_contigs"]

    @property
    def is_lossless(self) -> bool:
        return self.info["is_lossless"]

    def chrom_name(self, chrom_id: int) -> str:
        row = self.contigs.where(F.col("chrom_id") == chrom_id).first()
        if row is None:
            raise EngineError(ErrorCode.INVALID_REGION, f"contig {chrom_id}")
        return row["chrom"]

    def chrom_id(self, chrom: str) -> int | None:
        row = self.contigs.where(F.col("chrom") == chrom).first()
        return row["chrom_id"] if row else None

    # --- queries

    def _reads_for(self, pattern: str, strand: Strand | None) -> DataFrame:
        """The reads a search must look at: all, or those the postings leave."""
        if self.postings is None:
            return self.reads
        return postings.candidates(self.reads, self.postings, self.word_size, pattern, strand or self.strand)

    def count(self, pattern: str, strand: Strand | None = None, overlap: Overlap | None = None) -> int:
        return matching.count_matches(self._reads_for(pattern, strand), [pattern], strand or self.strand, overlap or self.overlap).first()["n"]

    def timed_count(self, pattern: str, strand: Strand | None = None) -> dict:
        """count with seconds: load (opening the tables), search, total."""
        began = time.time()
        self.spark.read.parquet(f"{self.path}/reads").schema  # noqa: B018
        loaded = time.time()
        n = self.count(pattern, strand)
        done = time.time()
        return {"count": n, "load_seconds": loaded - began, "search_seconds": done - loaded, "total_seconds": done - began}

    def counts(self, patterns: list[str], strand: Strand | None = None) -> DataFrame:
        return matching.count_matches(self.reads, patterns, strand or self.strand, self.overlap)

    def exists(self, pattern: str, threshold: int = 1, strand: Strand | None = None) -> bool:
        return matching.exists(self._reads_for(pattern, strand), pattern, threshold, strand or self.strand).first()["exists"]

    def _locate(self, reads: DataFrame, pattern: str, strand: Strand | None) -> DataFrame:
        own = reads.select("read_id", "record_id", "chrom_id", "chrom", "pos", "cigar", "seq")
        return matching.locate(own, [pattern], strand or self.strand)

    def locate(self, pattern: str, strand: Strand | None = None, ordered: bool = True, limit: int | None = None) -> DataFrame:
        """strand, chrom, p_min, p_max, read_id. Ordered: in the reported order, with `ord`. Unordered with a limit: the
        first in suffix order, forward strand first. Unordered without: as they are found."""
        found = self._locate(self._reads_for(pattern, strand), pattern, strand)
        if not ordered and limit is None:
            return found.select("strand", "chrom", "p_min", "p_max", "read_id")
        return matching.sorted_matches(found, limit, not ordered).select("ord", "strand", "chrom", "p_min", "p_max", "read_id").orderBy("ord")

    def iterate(self, pattern: str, strand: Strand | None = None) -> Iterator[dict]:
        for row in self.locate(pattern, strand).toLocalIterator():
            yield row.asDict()

    def near_region(self, region: Region) -> DataFrame:
        """The reads that may hold a match in a region. contig and both bounds of pos reach the Parquet scan as filters; in
        an enhanced index so do the read ids of the windows that touch the region."""
        row = self.contigs.where(F.col("chrom") == region.chrom).first()
        if row is None:
            return self.reads.where(F.lit(False))
        near = matching.near_region(self.reads, row["chrom_id"], region, row["longest_span"])
        if self.enhanced:
            touched = windows.windows_of_region(self.windows, row["chrom_id"], region.start, region.end)
            ids = touched.agg(F.min("first_read_id").alias("a"), F.max("last_read_id").alias("z")).first()
            near = near.where(F.lit(False)) if ids["a"] is None else near.where((F.col("read_id") >= ids["a"]) & (F.col("read_id") <= ids["z"]))
        return near

    def in_region(self, pattern: str, region: Region, strand: Strand | None = None) -> DataFrame:
        return matching.in_region(self._locate(self.near_region(region), pattern, strand), self.chrom_id(region.chrom), region)

    def region_count(self, pattern: str, region: Region, strand: Strand | None = None) -> int:
        return self.in_region(pattern, region, strand).count()

    def region_exists(self, pattern: str, region: Region, threshold: int = 1, strand: Strand | None = None) -> bool:
        need = max(1, threshold)
        return self.in_region(pattern, region, strand).limit(need).count() >= need

    def locate_approximate(self, pattern: str, distance: int) -> None:
        matching.approximate(parse(pattern), distance)

    # --- management

    def document(self, with_bwt: bool = False) -> dict:
        """All that is known of the index, under the names of the info contract. The last row, runs and ratio of the
        Burrows-Wheeler transform are computed only on request: they need the suffix array of every build's text."""
        i, c = self.info, self.info["config"]
        strand = {"complete": (0, "strand_complete"), "single": (1, "single_strand")}[c["strand"]]
        out = {
            "magic": MAGIC, "format_version": i["format"], "engine_version": i["engine_version"], "build_timestamp_utc": i["built_at"], "is_lossless": i["is_lossless"],
            "source_file_count": i["n_files"], "source_manifest_hash": i["manifest"] or "0" * 64, "ordering_hash": i["ordering_digest"],
            "S_length": i["s_length"], "N_reads": i["n_reads"], "N_windows": i["n_windows"], "sample_step_s": c["sample_step"], "has_isa_samples": c["isa_step"] > 0,
            "sample_step_s_prime": c["isa_step"], "enable_sarange": c["enhanced"], "enable_bidirectional": False, "recommended_seed_length": c["seed_length"],
            "window_size_T": c["window_size"], "entropy_order_k": c["entropy_k"], "qual_codec_id": QUALITY_CODECS.index(c["quality_codec"]) + 1, "qual_lossy_bins": c["quality_bins"],
            "meta_codec_id": META_CODECS.index(c["meta_codec"]) + 1, "map_codec_id": MAP_CODECS.index(c["map_codec"]) + 1, "strand_mode": strand[0], "sentinel_row": None,
            "seq_block_size": c["block_size"], "qual_block_size": c["block_size"], "allow_parallel_sa": True, "reference_based_encoding": bool(c["reference"]),
            "sa_samples_count": -(-(i["s_length"] + i["n_builds"]) // c["sample_step"]), "chrom_count": i["n_contigs"],
            "chrom_name_table": [{"chrom_id": r["chrom_id"], "name": r["chrom"]} for r in self.contigs.orderBy("chrom_id").toLocalIterator()],
            "mode": i["mode"], "strand_mode_name": strand[1], "bwt_runs": None, "S_over_r": None,
        }
        if with_bwt:
            rows = self.bwt_facts().orderBy("build_id").collect()  # one per build
            out["sentinel_row"] = rows[0]["sentinel_row"] if len(rows) == 1 else [r["sentinel_row"] for r in rows]
            out["bwt_runs"] = sum(r["runs"] for r in rows)
            out["S_over_r"] = round(i["s_length"] / out["bwt_runs"], 2)
        return out

    def build_texts(self) -> DataFrame:
        """text_id, s: the text of every build. A build's text is made by one task and must fit it."""
        parts = self.reads.groupBy("build_id").agg(F.array_sort(F.collect_list(F.struct("read_id", "seq"))).alias("x"))
        return parts.select(F.col("build_id").alias("text_id"), F.array_join(F.transform("x", lambda r: r["seq"]), "#").alias("s"))

    def bwt_facts(self) -> DataFrame:
        """build_id, sentinel_row, runs, ratio of each build's text."""
        sa = materialize(fm.suffix_array(self.build_texts()), "suffixes")
        row = sa.where("s_pos = 0").select("text_id", F.col("row").alias("sentinel_row"))
        return row.join(fm.bwt_runs(sa), "text_id").select(F.col("text_id").alias("build_id"), "sentinel_row", "runs", "ratio")

    def texts(self) -> DataFrame:
        """text_id, s: one text per read. Suffix order inside a read is the order in the build's text."""
        return self.reads.select(F.col("read_id").alias("text_id"), F.col("seq").alias("s"))

    def suffix_array(self) -> DataFrame:
        return fm.suffix_array(self.texts())

    def checks(self, strict: bool = False) -> DataFrame:
        """check, bad: the stored checksum of every stream and table; with strict, also counts, order and invariants."""
        now = _checksums(self.reads, {"windows": self.windows, "contigs": self.contigs, "directory": self.directory, "postings": self.postings})
        out = {f"checksum_{k}": int(now.get(k) != v) for k, v in self.info["checksums"].items()}
        if strict:
            out["n_reads"] = int(self.reads.count() != self.n_reads)
            out["n_windows"] = int(self.windows.count() != self.n_windows)
            out["n_contigs"] = int(self.contigs.count() != self.chrom_count)
            out["ordering_digest"] = int(digests.ordering_tree(self.reads) != self.info["ordering_digest"])
            out |= {r["check"]: r["bad"] for r in records.invariants(self.reads, self.contigs).collect()}
            out |= {r["check"]: r["bad"] for r in windows.window_invariants(self.reads, self.windows).collect()}
        return self.spark.createDataFrame(list(out.items()), "check string, bad bigint")

    def verify(self, strict: bool = False) -> bool:
        return self.checks(strict).where("bad > 0").isEmpty()

    def reconstruct(self, streams: list[str] | None = None, read_ids: list[int] | None = None, allow_lossy: bool = False) -> DataFrame:
        columns = ["read_id", "qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "aux", "source_file_id", "bam_offset"]
        return records.reconstruct(self.reads.select(*columns), streams, read_ids, self.is_lossless, allow_lossy)
