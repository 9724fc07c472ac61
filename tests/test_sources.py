import glob
import io
import json
import re

import pytest

from strandlake import cli
from strandlake.functions.patterns import Region
from strandlake.plans.index import ReadIndex
from strandlake.sources import sinks
from strandlake.sources.alignment_files import register
from tests.fixtures import READ_SCHEMA, TEN_READS

ODD = [
    ("u1", 4, None, 0, 255, "*", "ACGTRYN=", [255] * 8, b"NMC\x01", 0, 10),
    ("sec", 256, "chr1", 5, 0, "4M", "ACGT", [1, 2, 3, 4], b"", 0, 11),
    ("none", 0, "chr1", 6, 3, "*", "*", [], b"", 0, 12),
]
#: The keys that the info document must have. Fixed values.
INFO_KEYS = """magic format_version engine_version is_lossless S_length N_reads N_windows sample_step_s window_size_T entropy_order_k qual_codec_id meta_codec_id
map_codec_id strand_mode sentinel_row chrom_count source_manifest_hash ordering_hash seq_block_size qual_block_size mode strand_mode_name""".split()
CONTIGS = json.dumps([["chr1", 10000]])


def rows(df):
    return sorted((r["qname"], r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"], r["seq"], tuple(r["qual"] or ())) for r in df.collect())


@pytest.mark.parametrize("kind", ["bam", "sam"])
def test_round_trip(spark, tmp_path, kind):
    register(spark)
    df = spark.createDataFrame([*TEN_READS, *ODD], READ_SCHEMA)
    out = f"{tmp_path}/files"
    df.coalesce(1).write.format(kind).mode("append").option("contigs", CONTIGS).save(out)
    back = spark.read.format(kind).load(f"{out}/*.{kind}")
    assert rows(back) == rows(df)
    assert sorted(r["bam_offset"] for r in back.collect()) == list(range(13))
    assert {bytes(r["aux"]) for r in back.where("qname = 'u1'").collect()} == {b"NMC\x01" if kind == "bam" else b"NMi\x01\0\0\0"}
    df.repartition(3).write.format(kind).mode("overwrite").option("contigs", CONTIGS).save(out)
    assert rows(spark.read.format(kind).load(out)) == rows(df)
    assert {r["source_file_id"] for r in spark.read.format(kind).load(out).collect()} <= {0, 1, 2}


def test_empty_file_and_folder(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([], READ_SCHEMA)
    df.coalesce(1).write.format("bam").mode("append").option("contigs", CONTIGS).save(f"{tmp_path}/e")
    assert spark.read.format("bam").load(f"{tmp_path}/e").count() == 0
    assert spark.read.format("sam").load(f"{tmp_path}/nothing*.sam").count() == 0


def test_large_file(spark, tmp_path):
    register(spark)
    many = spark.range(20_000).selectExpr("concat('r', id) qname", "0L flag", "'chr1' chrom", "id + 1 pos", "60L mapq", "'50M' cigar", "repeat('ACGTN', 10) seq", "array_repeat(30, 50) qual", "cast(null as binary) aux", "0L source_file_id", "id bam_offset")
    many.coalesce(2).write.format("bam").mode("append").option("contigs", CONTIGS).save(f"{tmp_path}/m")
    back = spark.read.format("bam").load(f"{tmp_path}/m")
    assert back.count() == 20_000 and back.where("seq = repeat('ACGTN', 10) and size(qual) = 50").count() == 20_000


def run(*args):
    out = io.StringIO()
    try:
        cli.run(cli._parser().parse_args(list(args)), out)
    finally:
        pass
    return out.getvalue()


def test_cli(spark, tmp_path, capsys):
    register(spark)
    df = spark.createDataFrame(TEN_READS, READ_SCHEMA)
    df.coalesce(1).write.format("bam").mode("append").option("contigs", CONTIGS).save(f"{tmp_path}/in")
    bam, index = glob.glob(f"{tmp_path}/in/*.bam")[0], f"{tmp_path}/index"
    built = json.loads(run("build", bam, "-o", index))
    assert built["n_reads"] == 10 and len(built["manifest"]) == 64
    assert json.loads(run("count", index, "acgt")) == {"count": 13}
    assert set(json.loads(run("count", index, "ACGT", "--benchmark"))) == {"count", "load_seconds", "search_seconds", "total_seconds"}
    assert json.loads(run("exists", index, "GATTACA")) == {"exists": False}
    lines = run("locate", index, "GGGG").splitlines()
    assert lines[0] == "strand\tchrom\tp_min\tp_max\tread_id" and len(lines) == 8
    assert run("locate", index, "AACCGGTT", "--format", "bed").splitlines()[0] == "chr1\t206\t214\tread_1\t0\t+"
    document = json.loads(run("locate", index, "AACCGGTT", "--format", "json"))
    assert document["mode"] == "sorted" and document["count"] == len(document["matches"]) > 1 and document["matches"][0]["p_min"] == 207
    assert json.loads(run("locate", index, "AACCGGTT", "--format", "json", "--streaming"))["mode"] == "streaming"
    assert json.loads(run("locate", index, "AACCGGTT", "--format", "jsonl").splitlines()[0])["p_min"] == 207
    assert json.loads(run("region-count", index, "ACGT", "--region", "chr1:100-500")) == {"region_count": 7, "mode": "BASE", "strand_mode": "complete"}
    assert json.loads(run("region-exists", index, "ACGT", "--chrom", "chr9"))["region_exists"] is False
    assert json.loads(run("verify", index, "--strict")) == {"valid": True, "strict": True}
    facts = json.loads(run("info", index, "--bwt"))
    assert (facts["S_length"], facts["N_reads"], facts["chrom_count"], facts["N_windows"], facts["sa_samples_count"]) == (149, 10, 1, 1, 3)
    assert set(INFO_KEYS) <= set(facts) and facts["mode"] == "BASE" and facts["strand_mode_name"] == "strand_complete"
    text = "#".join(x[6] for x in TEN_READS) + "$"
    order = sorted(range(len(text)), key=lambda i: text[i:].translate(str.maketrans("$ACGTN#", "0123456")))
    bwt = [text[i - 1] for i in order]
    assert facts["sentinel_row"] == order.index(0) and facts["bwt_runs"] == 1 + sum(a != b for a, b in zip(bwt, bwt[1:]))
    assert "N_reads:" in run("info", index, "--text")
    run("reconstruct", index, "-o", f"{tmp_path}/back", "--read-ids", "3,1")
    assert {r["qname"] for r in spark.read.format("bam").load(f"{tmp_path}/back").collect()} == {"read04", "read02"}
    run("locate", index, "GGGG", "-o", f"{tmp_path}/tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").count() == 7
    assert cli.main(["version"]) == 0 and cli.main([]) == 0 and cli.main(["help"]) == 0
    assert cli.main(["count", index, "ACGT", "--approx", "1"]) == 1 and cli.main(["nonsense"]) == 1
    assert cli.main(["region-count", index, "ACGT", "--region", "chr1:x-y"]) == 1 and cli.main(["count", f"{tmp_path}/no", "A"]) == 1
    capsys.readouterr()


def test_sinks(spark):
    m = spark.createDataFrame([("+", "chr1", 5, 9, 2)], "strand string, chrom string, p_min bigint, p_max bigint, read_id bigint")
    assert tuple(sinks.bed(m).first()) == ("chr1", 4, 9, "read_2", 0, "+")
    assert json.loads(sinks.json_summary(m).first()[0]) == {"mode": "sorted", "count": 1}
    assert tuple(sinks.tsv(m).first()) == ("+", "chr1", 5, 9, 2)


def test_index_over_dirty_reads(spark, data, tmp_path):
    """An index built of the raw table answers as the scan does, whatever the partitioning."""
    raw = spark.read.parquet(f"{data}/reads_raw.parquet").drop("record_id", "ingested_at")
    one = ReadIndex.build(spark, raw.repartition(5), f"file://{tmp_path}/a")
    assert one.verify(True)
    assert one.region_count("ACG", Region("chrM", 0)) == one.locate("ACG", ordered=False).where("chrom = 'chrM'").count()
    assert one.count("ACG") == one.locate("ACG").count()


def test_tags_between_formats():
    from strandlake.sources.alignment_files import aux_bytes, aux_text, sam_line

    fields = ["NM:i:5", "XA:A:q", "XF:f:0.5", "XZ:Z:some text:x", "XH:H:1AE3", "XB:B:s,-3,4", "XC:B:f,1.5", "XL:i:4000000000", "XE:Z:"]
    assert aux_text(aux_bytes(fields)) == fields
    assert aux_text(b"ABc\xffCDS\x01\x02") == ["AB:i:-1", "CD:i:513"] and aux_text(None) == []
    row = dict(qname="r", flag=0, chrom="c", pos=1, mapq=3, cigar="1M", seq="A", qual=[30], aux=aux_bytes(fields))
    assert sam_line(row).rstrip("\n").split("\t")[11:] == fields
    with pytest.raises(ValueError):
        aux_text(b"NM?")


def test_contig_names_are_compared_exactly(spark, tmp_path):
    """Names that differ in case only are two contigs, and no read is doubled; contigs without reads keep their place."""
    rows = [("a", 0, "chr1", 5, 9, "8M", "ACGTACGT", [9] * 8, None, 0, 0), ("b", 0, "CHR1", 6, 9, "8M", "ACGTACGT", [9] * 8, None, 0, 1), ("c", 0, " chr1", 7, 9, "8M", "ACGTACGT", [9] * 8, None, 0, 2)]
    df = spark.createDataFrame(rows, READ_SCHEMA)
    index = ReadIndex.build(spark, df, f"file://{tmp_path}/i", header_contigs=["chr9", "chr1", "AAA"])
    assert index.n_reads == 3 and index.count("ACGT") == 6 and index.region_count("ACGT", Region("chr1")) == 2
    assert [r["chrom"] for r in index.contigs.orderBy("chrom_id").collect()] == [" chr1", "AAA", "CHR1", "chr1", "chr9"]
    assert index.region_count("ACGT", Region("chr9")) == 0 and index.verify(True)
    known = spark.createDataFrame([(0, "chr1")], "chrom_id bigint, chrom string")
    alias = spark.createDataFrame([("CHR1", "chr1")], "alt_name string, chrom string")
    index = ReadIndex.build(spark, df, f"file://{tmp_path}/j", contigs=known, aliases=alias)
    assert index.n_reads == 2 and index.count("ACGT") == 4
    with pytest.raises(Exception):
        ReadIndex.build(spark, df, f"file://{tmp_path}/k", contigs=known.union(known))


def test_header_contigs_of_files(spark, tmp_path):
    from strandlake.sources.alignment_files import header_contigs

    register(spark)
    df = spark.createDataFrame(TEN_READS, READ_SCHEMA)
    for kind in ("bam", "sam"):
        df.coalesce(1).write.format(kind).mode("append").option("contigs", json.dumps([["chr1", 10000], ["chr2", 7]])).save(f"{tmp_path}/{kind}")
        path = glob.glob(f"{tmp_path}/{kind}/*.{kind}")[0]
        assert header_contigs(path) == [("chr1", 10000), ("chr2", 7)]
        built = json.loads(run("build", path, "-o", f"{tmp_path}/{kind}-index"))
        assert built["n_contigs"] == 2


def test_pruned_regions(spark, data, tmp_path):
    """An enhanced index asks the windows first; counts are those of the plain one, also at the ends of long stretches."""
    from strandlake.schema import BuildConfig

    raw = spark.read.parquet(f"{data}/reads_raw.parquet").drop("record_id", "ingested_at")
    names = raw.where("chrom is not null and chrom <> '*'").select("chrom").distinct()
    plain = ReadIndex.build(spark, raw, f"file://{tmp_path}/p")
    fast = ReadIndex.build(spark, raw, f"file://{tmp_path}/e", BuildConfig(enhanced=True, window_size=3000))
    assert fast.info["mode"] == "ENHANCED" and names.count() == fast.chrom_count
    for region in (Region("chrM", 1000, 9000), Region("chrM"), Region("chr1", 1, 40_000_000), Region("chr7", 10**9), Region("no")):
        want = plain.locate("ACG", ordered=False).where((f"chrom = '{region.chrom}' and p_min <= {region.end} and p_max >= {region.start}")).count()
        assert plain.region_count("ACG", region) == fast.region_count("ACG", region) == want
        assert fast.region_exists("ACG", region) == (want > 0)
    shown = fast.near_region(Region("chrM", 1000, 9000))._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(x, shown) for x in (r"pos#\w+ >= ", r"pos#\w+ <= ", r"read_id#\w+ >= ", r"read_id#\w+ <= ")) and "PushedFilters" in shown


def test_damage_is_found(spark, data, tmp_path):
    """Every stream and table has a checksum of its own."""
    from pyspark.sql import functions as F

    raw = spark.read.parquet(f"{data}/reads_raw.parquet").drop("record_id", "ingested_at")
    index = ReadIndex.build(spark, raw, f"file://{tmp_path}/i")
    assert index.verify(True)
    bad = lambda: {r["check"] for r in index.checks(True).where("bad > 0").collect()}
    whole, changed = index.reads, F.when(F.col("read_id") == 5, F.lit(1)).otherwise(0)
    whole.withColumn("qual", F.transform("qual", lambda q: q + changed)).write.parquet(f"{tmp_path}/other")
    import shutil

    shutil.rmtree(f"{tmp_path}/i/reads"), shutil.move(f"{tmp_path}/other", f"{tmp_path}/i/reads")
    index = ReadIndex(spark, f"file://{tmp_path}/i")
    assert bad() == {"checksum_qual"}
    index.windows.withColumn("l", F.col("l") + (F.col("first_read_id") == 0).cast("bigint")).write.parquet(f"{tmp_path}/w")
    shutil.rmtree(f"{tmp_path}/i/windows"), shutil.move(f"{tmp_path}/w", f"{tmp_path}/i/windows")
    index = ReadIndex(spark, f"file://{tmp_path}/i")
    assert bad() == {"checksum_qual", "checksum_windows", "windows_begin"}
