import random

from pyspark.sql import functions as F

from strandlake.operators import ordering, records, windows


def reads(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.randint(0, 1), r.randint(0, 3), r.randint(1, 60), r.randint(0, 2), r.randint(0, 50), i, r.choice([1, 5, 30, 151])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "build_id bigint, chrom_id bigint, pos bigint, source_file_id bigint, bam_offset bigint, record_id bigint, l_seq bigint")


def ordered(rows):
    out, at, build = [], 0, None
    for i, x in enumerate(sorted(rows)):
        if x[0] != build:
            build, at = x[0], 0
        out.append((*x, i, at))
        at += x[6] + 1
    return out


def test_order_is_the_same_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 37)
    rows, df = reads(spark)
    want = sorted((x[5], x[7], x[8]) for x in ordered(rows))
    for n in (1, 3, 7):
        got = ordering.order_reads(df.repartition(n)).select("record_id", "read_id", "s_start").collect()
        assert sorted(map(tuple, got)) == want
    assert ordering.order_reads(df.where("pos < 0")).count() == 0
    lengths = {r["build_id"]: r["s_length"] for r in ordering.text_lengths(df).collect()}
    assert lengths == {b: sum(x[6] + 1 for x in rows if x[0] == b) - 1 for b in (0, 1)}


def greedy(starts, size):
    out = []
    for s in sorted(starts):
        if not out or s >= out[-1] + size:
            out.append(s)
    return out


def test_windows_random(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 3)
    rows, df = reads(spark, 500, 2)
    full = ordered(rows)
    table = spark.createDataFrame([(x[0], x[1], x[2], x[5], x[6], x[7], x[8], x[6]) for x in full], "build_id bigint, chrom_id bigint, pos bigint, record_id bigint, l_seq bigint, read_id bigint, s_start bigint, span bigint")
    for size in (1, 20, 50, 400, 100_000):
        want = {}
        for b in (0, 1):
            for c in range(4):
                own = [x for x in full if x[0] == b and x[1] == c]
                for lo in greedy([x[8] for x in own], size):
                    later = [s for s in greedy([x[8] for x in own], size) if s > lo]
                    inside = [x for x in own if lo <= x[8] and (not later or x[8] < later[0])]
                    end = max(x[8] + x[6] for x in inside)
                    last = max(x[7] for x in full if x[0] == b)
                    want[b, c, lo] = (end - (inside[-1][7] == last), inside[0][7], inside[-1][7], inside[0][2], max(x[2] + x[6] - 1 for x in inside))
        got = {(r["build_id"], r["chrom_id"], r["l"]): (r["r"], r["first_read_id"], r["last_read_id"], r["genomic_start"], r["genomic_end"]) for r in windows.window_table(table, size).collect()}
        assert got == want, size


def test_read_at(spark):
    rows, _ = reads(spark, 60, 3)
    full = ordered(rows)
    table = spark.createDataFrame([(x[0], x[7], x[8], x[6]) for x in full], "build_id bigint, read_id bigint, s_start bigint, l_seq bigint")
    spots = spark.range(0, 9000).select(F.lit(1).cast("bigint").alias("build_id"), F.col("id").alias("s_pos"))
    got = {r["s_pos"]: (r["read_id"], r["offset"], r["is_separator"]) for r in windows.read_at(spots, table, 16).collect()}
    last = max(x[7] for x in full if x[0] == 1)  # no separator follows the build's last read
    want = {x[8] + o: (x[7], o, o == x[6]) for x in full if x[0] == 1 for o in range(x[6] + (x[7] != last))}
    assert got == {k: v for k, v in want.items() if k < 9000}


def test_invariants_and_deltas(spark):
    rows, _ = reads(spark, 80, 4)
    full = ordered(rows)
    table = spark.createDataFrame(full, "build_id bigint, chrom_id bigint, pos bigint, source_file_id bigint, bam_offset bigint, record_id bigint, l_seq bigint, read_id bigint, s_start bigint")
    contigs = spark.range(4).withColumnRenamed("id", "chrom_id")
    assert records.invariants(table, contigs).where("bad > 0").count() == 0
    broken = table.withColumn("pos", F.when(F.col("read_id") == 7, 0).otherwise(F.col("pos"))).withColumn("s_start", F.col("s_start") + (F.col("read_id") == 9).cast("int"))
    bad = {r["check"] for r in records.invariants(broken, contigs.where("chrom_id < 3")).where("bad > 0").collect()}
    assert {"positions", "text_places", "contigs"} <= bad
    deltas = {r["read_id"]: r["delta"] for r in records.delta_positions(table).collect()}
    want = {}
    for prev, x in zip([None, *full], full):
        want[x[7]] = x[2] - prev[2] if prev and prev[:2] == x[:2] else x[2]
    assert deltas == want
    blocks = records.block_directory(table, F.col("l_seq"), 16).orderBy("block_id").collect()
    assert [b["block_offset"] for b in blocks] == [sum(x[6] for x in full[: 16 * i]) for i in range(5)]
