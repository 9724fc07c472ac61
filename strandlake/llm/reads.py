"""Queries on the read tables: shared spans, percentiles, frequent sequences, surviving records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import dna
from strandlake.llm import lossy, qdigest, spans, survivor
from strandlake.session import materialize
from strandlake.sources.tables import included_reads, table

BITS = 8
EPSILON = 0.01
PERCENTS = [10, 25, 50, 75, 90]
#: Percentile and the limit below which it is reported.
LIMITS = {10: 8, 50: 20}
SLICE = ["metric", "chrom_id", "source_file_id"]


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "reads_raw").select(F.lit("read").alias("rec_kind"), F.col("record_id").alias("rec_id"), dna.bases(F.col("seq")).alias("seq"))
    bundles = table(spark, folder, "seq_bundles").select(F.lit("bundle").alias("rec_kind"), F.col("bundle_id").alias("rec_id"), F.upper("s").alias("seq"))
    return reads.unionByName(bundles).where("seq is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(p1_records(spark, folder))


def p1_shared_amount(spark: SparkSession, folder: str) -> DataFrame:
    """Per record with shared spans: how many there are, their bases and the longest."""
    size = F.col("span_end") - F.col("span_start")
    return p1_found(spark, folder).groupBy("rec_kind", "rec_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(size).alias("shared_bases"), F.max(size).alias("longest"))


def _digests(spark: SparkSession, folder: str, keys: list[str], bits: int = BITS, epsilon: float = EPSILON) -> DataFrame:
    """Digests of every usable mapq and of every element 0 .. 93 of qual of the included reads, made in one pass each."""
    rest = [k for k in keys if k not in ("metric", "chrom_id")]
    sides = []
    for metric, value, last in (("mapq", dna.usable_mapq(F.col("mapq")), None), ("qual", F.col("qual"), 93)):
        rows = included_reads(spark, folder, metric, *rest).withColumn("metric", F.lit(metric))
        sides.append(qdigest.digest(rows, keys, value, bits, epsilon, last))
    return sides[0].unionByName(sides[1])


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """metric, chrom_id, v: the values themselves."""
    mapq = included_reads(spark, folder, "mapq").select(F.lit("mapq").alias("metric"), "chrom_id", dna.usable_mapq(F.col("mapq")).alias("v"))
    qual = included_reads(spark, folder, "qual").select(F.lit("qual").alias("metric"), "chrom_id", F.explode("qual").alias("v"))
    return mapq.where("v is not null").unionByName(qual.where("v between 0 and 93").withColumn("v", F.col("v").cast("bigint")))


def p2_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The digests of every source file and contig, to be put together later."""
    return _digests(spark, folder, SLICE)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    whole = qdigest.merge(p2_slices(spark, folder), ["metric", "chrom_id"], BITS, EPSILON)
    return qdigest.percentiles(whole, ["metric", "chrom_id"], BITS, PERCENTS)


def p2_found(spark: SparkSession, folder: str, epsilon: float = EPSILON) -> DataFrame:
    """Percentiles below their limits. The digest's bounds decide; only where a limit lies between the two bounds are the
    values of that contig and metric counted exactly. Digests of tasks are put together as those of p2_slices are, but by
    contig from the start."""
    whole = _digests(spark, folder, ["metric", "chrom_id"], epsilon=epsilon)
    bounds = qdigest.percentiles(whole, ["metric", "chrom_id"], BITS, list(LIMITS))
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.col("pct").cast("int")]
    bounds = materialize(bounds.withColumn("limit", limit.cast("bigint")), "bounds")
    sure = bounds.where("high < `limit`").select("metric", "pct", "chrom_id")
    open_ = bounds.where("low < `limit` and high >= `limit`").select("metric", "pct", "chrom_id", "limit")
    if not open_.isEmpty():
        values = _values(spark, folder).join(open_.select("metric", "chrom_id").distinct(), ["metric", "chrom_id"], "left_semi")
        counts = values.groupBy("metric", "chrom_id", "v").agg(F.count(F.lit(1)).alias("n"))
        reach = counts.join(open_, ["metric", "chrom_id"]).groupBy("metric", "pct", "chrom_id").agg(
            F.sum(F.when(F.col("v") < F.col("limit"), F.col("n")).otherwise(0)).alias("below"), F.sum("n").alias("n")
        )
        sure = sure.unionByName(reach.where("below * 100 >= pct * n").select("metric", "pct", "chrom_id"))
    enough = included_reads(spark, folder, "flag").groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    return sure.join(enough.select("chrom_id"), "chrom_id", "left_semi").select("metric", "pct", "chrom_id")


def _quality_sum(bits: int) -> Column:
    """The sum of a read's usable qualities, held at 2^bits - 1; null without an array."""
    total = F.aggregate(F.filter("qual", lambda q: q.between(0, 93)), F.lit(0).cast("bigint"), lambda s, q: s + q)
    return F.when(F.col("qual").isNotNull(), F.least(total, F.lit((1 << bits) - 1)))


def p2_rank_error(spark: SparkSession, folder: str, bits: int = 14, epsilon: float = 0.05) -> DataFrame:
    """The error measured where the digest does compress: the sum of a read's usable qualities, held at 2^bits - 1, per
    contig, put together from slices per file. contains: the true percentile lies within the bounds; within: the ranks of
    both bounds are off by at most epsilon of n."""
    reads = included_reads(spark, folder, "qual", "source_file_id").withColumn("v", _quality_sum(bits))
    slices = qdigest.digest(reads, ["chrom_id", "source_file_id"], F.col("v"), bits, epsilon)
    bounds = materialize(qdigest.percentiles(qdigest.merge(slices, ["chrom_id"], bits, epsilon), ["chrom_id"], bits, PERCENTS), "bounds")
    counts = reads.where("v is not null").groupBy("chrom_id", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    ranks = counts.join(bounds, "chrom_id").groupBy("chrom_id", "pct", "n", "low", "high").agg(
        upto(F.col("v") < F.col("low")).alias("a"), upto(F.col("v") <= F.col("low")).alias("b"), upto(F.col("v") < F.col("high")).alias("c"), upto(F.col("v") <= F.col("high")).alias("d")
    )
    slack = epsilon * 100 * F.col("n")
    share = F.col("pct") * F.col("n")
    contains = (F.col("a") * 100 < share) & (F.col("d") * 100 >= share)
    within = (F.col("b") * 100 >= share - slack) & (F.col("c") * 100 <= share + slack)
    return ranks.select("chrom_id", "pct", "n", contains.alias("contains"), within.alias("within"))


def p2_compression(spark: SparkSession, folder: str, bits: int = 14, epsilon: float = 0.05) -> DataFrame:
    """One row over all contigs, as for p2_rank_error: compressed, whether the digest holds fewer nodes than there are
    different values; open, whether a bound is wide; bounded, whether it keeps to 3 * bits / epsilon nodes."""
    reads = included_reads(spark, folder, "qual").select(F.lit(0).alias("g"), _quality_sum(bits).alias("v")).where("v is not null")
    nodes = materialize(qdigest.digest(reads, ["g"], F.col("v"), bits, epsilon), "nodes")
    wide = qdigest.percentiles(nodes, ["g"], bits, PERCENTS).agg(F.max(F.col("high") > F.col("low")).alias("open"))
    held, values = nodes.count(), reads.agg(F.count_distinct("v")).first()[0]
    return wide.select(F.lit(held < values).alias("compressed"), "open", F.lit(held <= 3 * bits / epsilon).alias("bounded"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "reads_raw").select(dna.bases(F.col("seq")).alias("seq"))
    return lossy.frequent_values(reads, "seq", 0.005).select(F.col("value").alias("seq"))


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates with their guaranteed count intervals."""
    reads = table(spark, folder, "reads_raw").select(dna.bases(F.col("seq")).alias("seq"))
    counts = lossy.lossy_counts(reads, "seq", 0.001)
    return counts.select(F.col("value").alias("seq"), F.col("n").alias("at_least"), (F.col("n") + F.col("undercount")).alias("at_most"), "total")


def p4_check(spark: SparkSession, folder: str) -> DataFrame:
    """One row on the count intervals: sequences counted, those above the share epsilon, how many of these are missing,
    intervals that don't hold the true count, and whether all are as narrow as epsilon of the total."""
    epsilon = 0.001
    reads = table(spark, folder, "reads_raw").select(dna.bases(F.col("seq")).alias("seq")).where("seq is not null")
    held = materialize(lossy.lossy_counts(reads, "seq", epsilon).withColumnRenamed("value", "seq"), "intervals")
    true = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("true"))
    total = reads.count()
    rows = true.join(held, "seq", "left").select("true", "n", "undercount")
    often = F.col("true") > epsilon * total
    add = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    return rows.agg(
        F.lit(total).cast("bigint").alias("total"),
        add(often).alias("frequent"),
        add(often & F.col("n").isNull()).alias("missing"),
        add((F.col("true") < F.col("n")) | (F.col("true") > F.col("n") + F.col("undercount"))).alias("outside"),
        F.coalesce(F.max("undercount") <= epsilon * total, F.lit(True)).alias("tight"),
    )


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.LongType())]))
def usable_quality(qual: pa.Array) -> pa.Array:
    """Number and sum of the elements 0 .. 93 of each array."""
    values = pc.fill_null(qual.flatten(), -1).to_numpy(zero_copy_only=False)
    good = (values >= 0) & (values <= 93)
    sizes = pc.fill_null(pc.list_value_length(qual), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    n, total = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (good, np.where(good, values, 0)))
    return pa.StructArray.from_arrays([pa.array(np.diff(x, prepend=0), pa.int64()) for x in (n, total)], names=["n", "total"])


def _deliveries(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    reads = included_reads(spark, folder, "record_id", "qname", "mapq", *more)
    return reads.withColumn("name", dna.read_name(F.col("qname"))).withColumn("mate", F.col("flag").bitwiseAND(F.lit(dna.MATE_BITS)))


def _clear(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) == 0


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    reads = _deliveries(spark, folder, "qual", "ingested_at").withColumn("q", usable_quality("qual"))
    mapq, record, late = dna.usable_mapq(F.col("mapq")), F.col("record_id"), [F.col("ingested_at"), -F.col("record_id")]
    best = survivor.survivors(
        reads,
        ["name", "mate"],
        {
            "keep_id": (None, [_clear(dna.DUPLICATE), _clear(dna.QC_FAIL), F.coalesce(mapq, F.lit(-1)), F.col("q.total"), *late], record),
            "mapq_id": (mapq.isNotNull(), late, record),
            "qual_id": (F.col("q.n") > 0, [F.col("q.n"), F.col("q.total"), *late], record),
        },
    )
    return best.select("keep_id", F.coalesce("mapq_id", "keep_id").alias("mapq_id"), F.coalesce("qual_id", "keep_id").alias("qual_id"))


def p5_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """For every read delivered twice or more, the values of mapq, qual, flag, pos and cigar that truth discovery supports
    most; sources are the source files. An array of qualities is claimed by its hash and joined back; one without a usable
    value claims nothing."""
    reads = _deliveries(spark, folder, "source_file_id", "cigar", "qual").where("name is not null")
    again = reads.groupBy("name", "mate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "mate")
    reads = reads.withColumn("mapq", dna.usable_mapq(F.col("mapq"))).withColumn("cigar", F.when(F.col("cigar") != "*", F.col("cigar")))
    reads = reads.withColumn("qual", F.when(F.exists("qual", lambda q: q.between(0, 93)), F.col("qual"))).withColumn("qual_hash", F.when(F.col("qual").isNotNull(), F.xxhash64("qual")).cast("string"))
    reads = reads.join(again, ["name", "mate"], "left_semi").select("name", "mate", "source_file_id", "mapq", "pos", "cigar", "flag", "qual", "qual_hash")
    reads = materialize(reads, "deliveries")
    best = survivor.truth_discovery(reads, ["name", "mate"], "source_file_id", ["mapq", "pos", "cigar", "flag", "qual_hash"])
    arrays = reads.where("qual is not null").groupBy("name", "mate", "qual_hash").agg(F.min("qual").alias("qual"))
    return best.join(arrays, ["name", "mate", "qual_hash"], "left").drop("qual_hash").withColumnRenamed("qual_hash_support", "qual_support")


def p5_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per field the groups in which truth discovery and the stated preferences both give a value, and in how many it is the
    same; rounds and settled as for p5_consensus."""
    best = materialize(p5_consensus(spark, folder), "consensus")
    reads = _deliveries(spark, folder, "qual", "ingested_at").withColumn("q", usable_quality("qual"))
    mapq, late = dna.usable_mapq(F.col("mapq")), [F.col("ingested_at"), -F.col("record_id")]
    keep = [_clear(dna.DUPLICATE), _clear(dna.QC_FAIL), F.coalesce(mapq, F.lit(-1)), F.col("q.total"), *late]
    ruled = survivor.survivors(
        reads,
        ["name", "mate"],
        {
            "r_mapq": (mapq.isNotNull(), late, mapq),
            "r_qual": (F.col("q.n") > 0, [F.col("q.n"), F.col("q.total"), *late], F.xxhash64("qual")),
            "r_flag": (None, keep, F.col("flag")),
            "r_pos": (None, keep, F.col("pos")),
        },
    )
    rows = ruled.join(best.withColumn("qual", F.when(F.col("qual").isNotNull(), F.xxhash64("qual"))), ["name", "mate"])
    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).isNotNull() & F.col(f"r_{f}").isNotNull()).alias("both"), (F.col(f) == F.col(f"r_{f}")).alias("same")) for f in ("mapq", "qual", "flag", "pos")])
    rows = rows.select(F.inline(each), "rounds", "settled").where("both")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("same").cast("bigint")).alias("agree"), F.max("rounds").alias("rounds"), F.min("settled").alias("settled"))


def p5_planted(spark: SparkSession, folder: str) -> DataFrame:
    """One row on truth discovery where the truth is known: for every ordered read five sources claim its position, of which
    two err in 4 and 8 of 100 reads and three in 45, these often with the same wrong value. accurate: at least 95 % of the
    chosen values are true; beats_votes: more than a majority vote gets right; settled: the reliabilities came to rest."""
    err = F.array(*[F.lit(e) for e in (4, 8, 45, 45, 45)])
    reads = table(spark, folder, "ordered_reads").select("read_id", "pos")
    claims = reads.select("read_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("source"))
    draw = F.pmod(F.xxhash64("read_id", "source"), F.lit(100))
    wrong = F.col("pos") + 1 + F.when(F.pmod(F.xxhash64("source", "read_id"), F.lit(3)) > 0, 0).otherwise(F.col("source") + 1)
    claims = materialize(claims.withColumn("claim", F.when(draw < F.get(err, F.col("source")), wrong).otherwise(F.col("pos"))), "planted")
    best = survivor.truth_discovery(claims, ["read_id"], "source", ["claim"])
    votes = claims.groupBy("read_id", "pos", "claim").agg(F.count(F.lit(1)).alias("k")).groupBy("read_id", "pos").agg(F.max_by("claim", F.struct("k", -F.col("claim"))).alias("voted"))
    rows = votes.join(best, "read_id")
    right, voted = (F.sum((F.col(c) == F.col("pos")).cast("bigint")) for c in ("claim", "voted"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (right >= 0.95 * F.count(F.lit(1))).alias("accurate"), (right > voted).alias("beats_votes"), F.min("settled").alias("settled"))
