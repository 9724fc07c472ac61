import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import codecs, digests, quality


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300))
def test_mtf_and_runs(xs):
    assert codecs.unmtf(codecs.mtf(xs)) == xs
    assert codecs.unrle(codecs.rle(xs)) == xs


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600))
def test_arithmetic(data):
    assert codecs.arithmetic_decode(codecs.arithmetic_encode(data)) == data


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300))
def test_text_blocks(xs):
    assert codecs.unpack_text(codecs.pack_text(xs)) == xs


def test_arithmetic_is_smaller():
    data = bytes(random.Random(1).choices([0, 1, 5], [90, 8, 2], k=5000))
    packed = codecs.arithmetic_encode(codecs.rle(list(data)))
    assert len(packed) < len(data) / 4 and bytes(codecs.unrle(codecs.arithmetic_decode(packed))) == data


@given(st.integers(0, 2**63))
def test_varint(n):
    out = bytearray(b"x")
    codecs.put_varint(n, out)
    assert codecs.get_varint(bytes(out), 1) == (n, len(out))


def test_meta():
    for flag, cig, aux in ((0, "", b""), (99, "5S10M3000000N2=1X", b"NMC\0"), (65535, "1M", b"")):
        assert codecs.unpack_meta(codecs.pack_meta(flag, cig, aux)) == (flag, cig, aux)
        assert codecs.unpack_meta_fixed(codecs.pack_meta_fixed(flag, cig, aux)) == (flag, cig, aux)


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(0, 93) for _ in range(r.randint(0, 40))]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, q array<int>")
    q = F.col("q")
    out = df.select("i", "q", quality.undelta(quality.delta(q)).alias("d"), quality.uncycle(quality.cycle_order(q, 7), 7).alias("c"), quality.binned(q, 8).alias("b8"), quality.binned(q, 4).alias("b4"), quality.binned(q, 50).alias("b50"), quality.binned(q, 0).alias("b0")).collect()
    for x in out:
        assert x["d"] == x["q"] and x["c"] == x["q"] and x["b0"] == x["q"] and x["b50"] == x["q"]
        assert set(x["b4"] or []) <= {11, 34, 57, 80, 93} and set(x["b8"] or []) <= {5, 16, 27, 38, 49, 60, 71, 82, 93}
    one = spark.createDataFrame([([0, 2, 10, 20, 30, 35, 40, 73, 93],)], "q array<int>").select(quality.binned(q, 8)).first()[0]
    assert one == [5, 5, 5, 16, 27, 38, 38, 71, 93]
    assert spark.createDataFrame([([255, 3],)], "q array<int>").select(quality.filled(q)).first()[0] == [0, 3]


def test_blocks(spark):
    text = "".join(random.Random(3).choices("ACGTN#", k=500))
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(text)] + [(1, 500, "$")], "t bigint, row bigint, bwt string").repartition(3)
    got = codecs.mtf_blocks(df, ["t"], "row", "bwt").first()
    assert "".join("ACGTN#"[x] for x in codecs.unmtf(got["places"])) == text
    runs = codecs.run_lengths(df, ["t"], "row", "bwt").orderBy("run").collect()
    assert "".join(r["symbol"] * r["n"] for r in runs) == text + "$"
    small = codecs.run_lengths(df, ["t"], "row", "bwt", 7).orderBy("run").collect()
    assert [tuple(r) for r in small] == [tuple(r) for r in runs] and [r["run"] for r in runs] == list(range(len(runs)))
    cut = codecs.mtf_blocks(df, ["t"], "row", "bwt", size=7).orderBy("block").collect()
    assert [x for r in cut for x in r["places"]] == got["places"]
    packed = codecs.packed_blocks(df, ["t"], "row", "bwt", size=64)
    assert "".join(r["symbols"] for r in codecs.unpacked_blocks(packed, ["t"]).orderBy("block").collect()) == text + "$"


def test_runs_and_places_beyond_a_block(spark):
    """Results of whole columns: a run of 140,000 equal symbols is one row, and the list of recent symbols goes on."""
    df = spark.range(140_000).selectExpr("1L t", "id row", "'A' bwt")
    assert [tuple(r) for r in codecs.run_lengths(df, ["t"], "row", "bwt").collect()] == [(1, 0, "A", 140_000)]
    df = spark.range(140_000).selectExpr("1L t", "id row", "case when id in (10, 65536, 139999) then 'C' when id < 70000 then 'A' else 'G' end bwt")
    assert [tuple(r)[1:] for r in codecs.run_lengths(df, ["t"], "row", "bwt").orderBy("run").collect()] == [
        (0, "A", 10), (1, "C", 1), (2, "A", 65525), (3, "C", 1), (4, "A", 4463), (5, "G", 69999), (6, "C", 1)
    ]
    blocks = codecs.mtf_blocks(df, ["t"], "row", "bwt").orderBy("block").collect()
    assert len(blocks) == 3 and [x for r in blocks for x in r["places"]] == codecs.mtf([0 if c == "A" else 1 if c == "C" else 2 for c in (r["bwt"] for r in df.orderBy("row").collect())])


def test_digests(spark):
    df = spark.createDataFrame([(i, i * 3, f"r{i}") for i in range(300)], "a bigint, b bigint, c string")
    assert digests.table_checksum(df) == digests.table_checksum(df.repartition(7)) != digests.table_checksum(df.where("a > 0"))
    assert digests.table_checksum(df.where("a < 0")) == 0
    assert digests.manifest([("a", b"x"), ("b", b"y")]) != digests.manifest([("b", b"y"), ("a", b"x")])
    reads = df.select(F.col("a").alias("read_id"), F.lit(1).cast("bigint").alias("chrom_id"), F.col("b").alias("pos"), F.lit(0).cast("bigint").alias("source_file_id"), F.col("a").alias("bam_offset"))
    assert digests.ordering_tree(reads, 16) == digests.ordering_tree(reads.repartition(5), 16) != digests.ordering_tree(reads.withColumn("pos", F.col("pos") + 1), 16)


def test_undelta_of_a_long_read(spark):
    """A million values, and values that leave the range: the running value is held within it."""
    r = random.Random(5)
    long = [r.randint(0, 93) for _ in range(1_000_000)]
    rows = [(1, [10, 128 - 20, 128 + 5]), (2, [90, 128 + 50, 128 - 3]), (3, []), (4, None), (5, [200, 128 - 1])]
    df = spark.createDataFrame(rows, "i int, q array<int>")
    assert {x[0]: x[1] for x in df.select("i", quality.undelta("q")).collect()} == {1: [10, 0, 5], 2: [90, 93, 90], 3: [], 4: None, 5: [200, 93]}
    df = spark.createDataFrame([(long,), (long[::-1],)], "q array<int>")
    assert [x[0] for x in df.select(quality.undelta(quality.delta(F.col("q")))).collect()] == [long, long[::-1]]
