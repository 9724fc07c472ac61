import hashlib

import pytest

from strandlake.functions import digests
from strandlake.functions.patterns import Region
from strandlake.operators import fm, windows
from strandlake.plans.index import ReadIndex
from strandlake.schema import BuildConfig, EngineError, ErrorCode, Overlap, Strand
from tests.fixtures import READ_SCHEMA, TEN_READS


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    raw = spark.createDataFrame(TEN_READS, READ_SCHEMA).repartition(3)
    return ReadIndex.build(spark, raw, "file://" + str(tmp_path_factory.mktemp("ten") / "index"))


COUNTS = {
    "A": (70, 37, 70, 30), "ACG": (26, 13, 13, 14), "CGT": (26, 13, 13, 14), "ACGT": (13, 13, 13, 7), "AAAA": (7, 4, 7, 2), "TTTT": (7, 3, 7, 2),
    "CCGGTTAA": (5, 3, 3, 3), "AAAACCCC": (2, 1, 2, 2), "GGGGCCCC": (1, 1, 1, 0), "AACCGGTT": (3, 3, 3, 1), "ACGTACGT": (9, 9, 6, 5),
    "GGTTAACC": (2, 2, 2, 1), "CCGG": (5, 5, 5, 3), "TTAA": (3, 3, 3, 2), "GATTACA": (0, 0, 0, 0),
}


def test_counts(index):
    complete = {r["pattern"]: r["n"] for r in index.counts(list(COUNTS)).collect()}
    single = {r["pattern"]: r["n"] for r in index.counts(list(COUNTS), Strand.SINGLE).collect()}
    assert complete == {p: c[0] for p, c in COUNTS.items()}
    assert single == {p: c[1] for p, c in COUNTS.items()}


def test_counts_without_overlap(index):
    from strandlake.operators.matching import count_matches

    got = {r["pattern"]: r["n"] for r in count_matches(index.reads, list(COUNTS), overlap=Overlap.NONE).collect()}
    assert got == {p: c[2] for p, c in COUNTS.items()}


@pytest.mark.parametrize("pattern", ["ACG", "ACGT", "CCGGTTAA", "GGGGCCCC"])
def test_region_counts(index, pattern):
    assert index.region_count(pattern, Region("chr1", 100, 500)) == COUNTS[pattern][3]


def test_region_edges(index):
    assert index.region_count("ACGT", Region("chrX", 0)) == 0
    assert index.region_exists("ACGT", Region("chr1"), 7) and not index.region_exists("GATTACA", Region("chr1"), 0)
    assert not index.exists("A" * 25) and not index.exists("N" * 16) and index.exists("ACGT", 13) and not index.exists("ACGT", 14)


LOCATED = {
    "ACGT": "+ 0 101 104,+ 0 105 108,+ 0 109 112,+ 0 113 116,+ 3 401 404,+ 3 404 406,+ 3 407 410,+ 6 701 704,+ 6 705 708,+ 6 709 712,+ 6 713 716,+ 9 1001 1004,+ 9 1005 1008",
    "CCCCAAAA": "+ 4 505 514,+ 5 603 608,+ 8 901 905,- 8 906 910",
    "GGGG": "+ 2 309 312,+ 5 601 602,+ 8 910 910,- 2 305 308,- 4 505 510,- 5 603 606,- 8 901 901",
    "AACCGGTT": "+ 1 207 214,+ 7 801 808,+ 7 808 815",
}


@pytest.mark.parametrize("pattern", LOCATED)
def test_locate(index, pattern):
    got = [f"{r['strand']} {r['read_id']} {r['p_min']} {r['p_max']}" for r in index.locate(pattern).collect()]
    assert got == LOCATED[pattern].split(",")
    few = [f"{r['strand']} {r['read_id']} {r['p_min']} {r['p_max']}" for r in index.locate(pattern, limit=3).collect()]
    assert few == LOCATED[pattern].split(",")[:3]


def test_iterate_gives_every_row(index):
    assert len(list(index.iterate("ACGT"))) == 13


def test_shape(index):
    assert (index.n_reads, index.s_length, index.chrom_count, index.n_windows, index.is_lossless) == (10, 149, 1, 1, True)
    assert [r["s_start"] for r in index.reads.orderBy("read_id").collect()] == [0, 17, 34, 51, 64, 77, 90, 107, 124, 141]
    assert index.chrom_name(0) == "chr1"


def test_ordering_digest(index):
    golden = "98114e743f7e6872a9836313c1d494128f4dd778409a07fe69a8a0c8893259b0"
    assert digests.ordering_digest(index.reads) == golden
    assert index.info["ordering_digest"] == hashlib.sha256(b"".join(bytes(r["b"]) for r in index.reads.select("read_id", digests.order_record(*[index.reads[c] for c in ("chrom_id", "pos", "source_file_id", "bam_offset")]).alias("b")).orderBy("read_id").collect())).hexdigest()


def test_windows(index):
    rows = windows.window_table(index.reads, 50).orderBy("l").collect()
    assert [tuple(r[c] for c in ("l", "r", "first_read_id", "last_read_id", "genomic_start", "genomic_end")) for r in rows] == [(0, 50, 0, 2, 101, 316), (51, 106, 3, 6, 401, 716), (107, 148, 7, 9, 801, 1008)]


def test_suffix_array(spark, index):
    text = "#".join(r[3 + 3] for r in TEN_READS)
    texts = spark.createDataFrame([(1, text)], "text_id bigint, s string")
    sa = fm.suffix_array(texts)
    rows = sa.orderBy("row").collect()
    order = str.maketrans("ACGTN#", "BCDEFG")
    assert [r["s_pos"] for r in rows] == sorted(range(len(text) + 1), key=lambda i: text[i:].translate(order))
    assert fm.bwt_runs(sa).first()["runs"] == 58
    assert {r["code"]: r["c"] for r in fm.c_array(texts).collect()} == {"$": 0, "A": 1, "C": 38, "G": 75, "T": 108, "N": 141, "#": 141}
    assert fm.sa_samples(sa, 64).count() == 3
    blocks = fm.bwt_blocks(sa, 8)
    known = fm.sa_samples(sa, 64).selectExpr("text_id", "k * 64 as row", "s_pos")
    back = fm.text_from_bwt(blocks, known, 8).orderBy("read_idx").collect()
    assert "#".join(r["seq"] for r in back) == text
    found = fm.backward_search(blocks, "ACGT", 8).first()
    assert found["hi"] - found["lo"] == 13
    lf = {r["row"]: r["lf"] for r in fm.lf_mapping(blocks, 8).collect()}
    pos = {r["row"]: r["s_pos"] for r in rows}
    assert all(pos[lf[r]] == (pos[r] - 1) % (len(text) + 1) for r in pos)
    walked = {r["row"]: r["s_pos"] for r in fm.walked_positions(blocks, known.where("row < 0"), 8).collect()}
    assert walked == pos  # also without a sample
    assert fm.backward_search(blocks, "GGGGGGGGG", 8).first()["hi"] == 0


def test_suffix_array_edges(spark):
    texts = spark.createDataFrame([(1, ""), (2, None), (3, "A" * 400), (4, "ACGT#ACGT#ACGT")], "text_id bigint, s string")
    rows = fm.suffix_array(texts).collect()
    by = {t: [r["s_pos"] for r in sorted(rows, key=lambda r: r["row"]) if r["text_id"] == t] for t in (1, 2, 3, 4)}
    assert by[1] == [0] and by[2] == [] and by[3] == list(range(400, -1, -1))
    order = str.maketrans("ACGTN#", "BCDEFG")
    assert by[4] == sorted(range(15), key=lambda i: "ACGT#ACGT#ACGT"[i:].translate(order))
    assert fm.suffix_array(texts.where("text_id = 9")).count() == 0


def test_verify_finds_damage(spark, index, tmp_path):
    assert index.verify(strict=True)
    index.reads.where("read_id <> 3").write.parquet(f"file://{tmp_path}/reads")
    index.reads = spark.read.parquet(f"file://{tmp_path}/reads")
    bad = {r["check"] for r in index.checks(True).where("bad > 0").collect()}
    index.reads = spark.read.parquet(f"{index.path}/reads")
    assert {"checksum_seq", "checksum_map", "n_reads", "dense_ids", "ordering_digest"} <= bad


def test_reconstruct(index):
    row = index.reconstruct(["qual"], [3, 1, 3]).orderBy("request").collect()
    assert [r["read_id"] for r in row] == [3, 1, 3]
    assert row[0]["seq"] == "N" * 12 and row[0]["cigar"] == "12M" and row[0]["flag"] == 0 and row[0]["chrom"] is None and row[0]["qual"] == [73] * 12
    assert index.reconstruct(["seq"], [3]).first()["qual"] == [255] * 12
    with pytest.raises(EngineError) as e:
        index.reconstruct(read_ids=[99])
    assert e.value.code is ErrorCode.INVALID_READ_ID
    with pytest.raises(EngineError):
        index.reconstruct(["colour"])


def test_lossy_guard(spark, tmp_path):
    raw = spark.createDataFrame(TEN_READS, READ_SCHEMA)
    lossy = ReadIndex.build(spark, raw, f"file://{tmp_path}/lossy", BuildConfig(quality_bins=4))
    assert not lossy.is_lossless
    with pytest.raises(EngineError) as e:
        lossy.reconstruct()
    assert e.value.code is ErrorCode.LOSSY_RECONSTRUCTION
    assert {q for r in lossy.reconstruct(allow_lossy=True).collect() for q in r["qual"]} <= {11, 34, 57, 80, 93}


def test_refusals(spark, index, tmp_path):
    with pytest.raises(EngineError) as e:
        index.locate_approximate("ACGT", 1)
    assert e.value.code is ErrorCode.NOT_IMPLEMENTED
    with pytest.raises(EngineError) as e:
        index.count("")
    assert e.value.code is ErrorCode.EMPTY_PATTERN
    with pytest.raises(EngineError):
        BuildConfig(bidirectional=True)
    with pytest.raises(EngineError):
        BuildConfig(quality_codec="ODD")
    raw = spark.createDataFrame([(*TEN_READS[0][:1], 4, *TEN_READS[0][2:])], READ_SCHEMA)
    with pytest.raises(EngineError) as e:
        ReadIndex.build(spark, raw, f"file://{tmp_path}/none")
    assert e.value.code is ErrorCode.INVALID_BAM_INPUT
    with pytest.raises(EngineError):
        ReadIndex(spark, f"file://{tmp_path}/missing")


def test_sort_order_set(spark, tmp_path):
    rows = [("chr1", 100, "ACGACG"), ("chr1", 200, "TACGTT"), ("chr1", 150, "GACGNN"), ("chr2", 50, "AACGTA"), ("chr2", 75, "ACGACG"), ("chr2", 300, "CGTACG")]
    raw = [(f"q{i}", 0, c, p, 60, "6M", s, [30] * 6, None, 0, i) for i, (c, p, s) in enumerate(rows)]
    index = ReadIndex.build(spark, spark.createDataFrame(raw, READ_SCHEMA), f"file://{tmp_path}/sort")
    got = [(r["strand"], r["chrom"], r["p_min"], r["p_max"]) for r in index.locate("ACG").collect()]
    want = [("+", "chr1", a, a + 2) for a in (100, 103, 151, 201)] + [("+", "chr2", a, a + 2) for a in (51, 75, 78, 303)] + [("-", "chr1", 202, 204), ("-", "chr2", 52, 54), ("-", "chr2", 300, 302)]
    assert got == want
