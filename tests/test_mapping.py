"""Coordinate mapping and matching against a procedural restatement of the rules, on random reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.patterns import LAST, Region, orientations, parse, parse_region
from strandlake.operators import matching
from strandlake.schema import EngineError, Overlap, Strand
from tests.fixtures import offsets, revcomp


def place(ops, anchor, offset, right):
    """Walks the operations base by base."""
    read, ref, aligned = 0, anchor, []
    spots = []
    for n, op in ops:
        for _ in range(n):
            if op in "M=X":
                spots.append((op, ref))
                aligned.append((read, ref))
            elif op in "IS":
                spots.append((op, None))
            read += op in "MIS=X"
            ref += op in "MDN=X"
    if not aligned or offset >= len(spots):
        return anchor
    op, at = spots[offset]
    if at is not None:
        return at
    before = [r for i, r in aligned if i < offset]
    after = [(i, r) for i, r in aligned if i > offset]
    if op == "I":
        return (after[0][1] if after else before[-1] if before else anchor) if right else (before[-1] if before else anchor)
    if not before or not after:
        return before[-1] if before else after[0][1]
    start = offset
    while start and spots[start - 1][0] == "S":
        start -= 1
    a, b = offset - start, after[0][0] - offset
    return min(before[-1], after[0][1]) if a == b else before[-1] if a < b else after[0][1]


def random_reads(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ops = [(r.randint(1, 6), r.choice("MMMIDN=X")) for _ in range(r.randint(1, 6))]
        if r.random() < 0.4:
            ops = [(r.randint(1, 5), "S"), *ops]
        if r.random() < 0.4:
            ops = [*ops, (r.randint(1, 5), "S")]
        if r.random() < 0.2:
            ops = [(3, "H"), *ops]
        merged = []
        for k, o in ops:
            if merged and merged[-1][1] == o:
                merged[-1] = (merged[-1][0] + k, o)
            else:
                merged.append((k, o))
        length = sum(k for k, o in merged if o in "MIS=X") + r.choice([0, 0, 0, 2])
        cig = r.choice(["".join(f"{k}{o}" for k, o in merged)] * 8 + [None, "*"])
        rows.append((i, i, i % 3, r.randint(1, 1000), cig, "".join(r.choice("ACGTACGTN") for _ in range(max(length, 1))), merged if cig not in (None, "*") else []))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_locate_random(spark, seed):
    rows = random_reads(seed)
    df = spark.createDataFrame([x[:6] for x in rows], "record_id bigint, read_id bigint, chrom_id bigint, pos bigint, cigar string, seq string").repartition(3)
    patterns = ["AC", "GT", "N", "CGA"]
    got = sorted(tuple(r) for r in matching.locate(df, patterns).select("pattern", "strand", "record_id", "offset", "p_min", "p_max").collect())
    want = []
    for rid, _, _, pos, _, seq, ops in rows:
        for p in patterns:
            for w, s in orientations(p):
                for o in offsets(seq, w):
                    x, y = place(ops, pos, o, False), place(ops, pos, o + len(w) - 1, True)
                    want.append((p, s, rid, o, min(x, y), max(x, y)))
    assert got == sorted(want)


def greedy(places, width):
    end = n = 0
    for p in sorted(places):
        if p >= end:
            end, n = p + width, n + 1
    return n


def test_counts_random(spark):
    rows = random_reads(5)
    df = spark.createDataFrame([(x[0], x[5]) for x in rows] + [(900, None), (901, ""), (902, "A" * 5000)], "record_id bigint, seq string")
    texts = [x[5] for x in rows] + ["A" * 5000]
    patterns = ["A", "AA", "ACG", "TTNA", "ACGT"]
    for strand in Strand:
        words = {p: [w for w, _ in orientations(p, strand)] for p in patterns}
        got = {r["pattern"]: r["n"] for r in matching.count_matches(df, patterns, strand).collect()}
        assert got == {p: sum(len(offsets(t, w)) for t in texts for w in words[p]) for p in patterns}
        got = {r["pattern"]: r["n"] for r in matching.count_matches(df, patterns, strand, Overlap.NONE).collect()}
        assert got == {p: sum(greedy([o for w in words[p] for o in offsets(t, w)], len(p)) for t in texts) for p in patterns}


def test_many_words_equals_few(spark):
    df = spark.createDataFrame([(x[0], x[5]) for x in random_reads(6)], "record_id bigint, seq string")
    words = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"] + ["AN"]
    many = sorted(tuple(r) for r in matching.hits(df, words).select("pattern", "strand", "record_id", "offset").collect())
    want = sorted((w, s, x[0], o) for x in random_reads(6) for w in words for t, s in orientations(w) for o in offsets(x[5], t))
    assert many == want


def test_long_reads(spark):
    r = random.Random(8)
    texts = ["".join(r.choices("ACGT", k=n)) for n in (2047, 2048, 2049, 3072, 5000, 30_000)] + ["A" * 4000, "C" * 2500 + "ACGTACGT"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, seq string")
    words = ["ACG", "A", "CCCCC", "TTTTTTTTT"]
    got = sorted(map(tuple, matching.hits(df, words, Strand.SINGLE).select("pattern", "record_id", "offset").collect()))
    assert got == sorted((w, i, o) for w in words for i, t in enumerate(texts) for o in offsets(t, w))
    counts = {x["pattern"]: x["n"] for x in matching.count_matches(df, words, Strand.SINGLE, Overlap.NONE).collect()}
    assert counts == {w: sum(greedy(offsets(t, w), len(w)) for t in texts) for w in words}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 7, 5, "4M", "ACGT", "x", 3, 9)], "record_id bigint, chrom_id bigint, pos bigint, cigar string, seq string, pattern string, offset bigint, p_min bigint")
    row = matching.locate(df, ["CG"]).first()
    assert (row["pattern"], row["offset"], row["p_min"], row["p_max"]) == ("CG", 1, 6, 7)
    assert matching.locate(df.where("pos > 9"), ["CG"]).count() == 0


def test_region_batch(spark):
    r = random.Random(3)
    m = [(r.choice("AB"), r.randint(0, 2), a, a + r.randint(0, 90)) for a in (r.randint(1, 2000) for _ in range(300))]
    g = [(f"r{i}", r.randint(0, 2), a, a + r.randint(0, 700)) for i, a in enumerate(r.randint(1, 2000) for _ in range(20))]
    got = matching.region_batch(spark.createDataFrame(m, "pattern string, chrom_id bigint, p_min bigint, p_max bigint"), spark.createDataFrame(g, "region string, chrom_id bigint, start bigint, end bigint"), 64)
    want = {}
    for p, c, a, b in m:
        for n, d, s, e in g:
            if c == d and a <= e and b >= s:
                want[n, p] = want.get((n, p), 0) + 1
    assert {(x["region"], x["pattern"]): x["n"] for x in got.collect()} == want


def test_patterns():
    assert parse("acgtX-") == "ACGTNN"
    assert orientations("ACGT") == [("ACGT", "+")] and orientations("AACN") == [("AACN", "+"), (revcomp("AACN"), "-")]
    assert parse_region("chr1:5-9") == Region("chr1", 5, 9) and parse_region("chr1:") == Region("chr1", 0, LAST)
    for bad in ("chr1", "chr1:a-b", ":1-2"):
        with pytest.raises(EngineError):
            parse_region(bad)


def test_reverse_complement(spark):
    from strandlake.functions.dna import bases, reverse_complement

    rows = spark.createDataFrame([("acgtn",), ("ACRT",), ("*",), ("",), (None,)], "s string").select(bases(F.col("s")).alias("b")).withColumn("r", reverse_complement(F.col("b"))).collect()
    assert [tuple(x) for x in rows] == [("ACGTN", "NACGT"), ("ACNT", "ANGT"), (None, None), (None, None), (None, None)]


def test_long_cigar(spark):
    """100,000 operations in one read and matches all over it, in time that grows with their number only."""
    import time

    r = random.Random(9)
    ops = [(r.randint(1, 9), "M" if k % 2 == 0 else r.choice("IDN")) for k in range(100_000)]
    seq = "".join(r.choices("ACGT", k=sum(k for k, o in ops if o in "MI")))
    row = (1, 1, 0, 1000, "".join(f"{k}{o}" for k, o in ops), seq)
    df = spark.createDataFrame([row, (2, 2, 0, 7, None, "ACGTACGT"), (3, 3, 0, 7, "3M", "ACGTACGT")], "record_id bigint, read_id bigint, chrom_id bigint, pos bigint, cigar string, seq string")
    began = time.time()
    got = sorted(tuple(x) for x in matching.locate(df, ["ACGT"]).select("record_id", "offset", "p_min", "p_max").collect())
    assert time.time() - began < 30
    spots, ref = [], 1000
    for k, o in ops:
        for _ in range(k):
            if o == "M":
                spots.append((ref, ref))
            elif o == "I":
                spots.append((ref - 1, ref))  # every insertion here stands between two aligned operations
            ref += o != "I"
    want = [(1, o, min(spots[o][0], spots[o + 3][1]), max(spots[o][0], spots[o + 3][1])) for o in offsets(seq, "ACGT")]
    assert got == want + [(2, 0, 7, 7), (2, 4, 7, 7), (3, 0, 7, 7), (3, 4, 7, 7)]


def test_many_patterns(spark):
    """Counts of more patterns than one expression each: the hash join gives the same, patterns without matches too."""
    r = random.Random(11)
    seqs = ["".join(r.choices("ACGTN", k=r.randint(0, 60))) for _ in range(80)] + [None]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    patterns = ["".join(r.choices("ACGT", k=r.choice([3, 4, 9]))) for _ in range(90)]
    want = {}
    for p in patterns:
        want[p] = sum(len(offsets(s, w)) for s in seqs if s for w, _ in orientations(p))
    assert {x["pattern"]: x["n"] for x in matching.count_matches(df, patterns).collect()} == want
    few, many = (sorted(map(tuple, matching.count_matches(df, ps, overlap=Overlap.NONE).collect())) for ps in (patterns[:20], patterns))
    assert set(few) <= set(many) and len(many) == len(set(patterns))
