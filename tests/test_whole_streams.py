"""Results that hold every read and every stream, against plain Python over the given tables."""

import pytest

from strandlake.plans import alignments
from tests.test_entry import connect


@pytest.fixture(scope="module")
def given(data):
    """read_id -> the read's values as they were delivered, qualities as F4 has them."""
    sql = "SELECT o.read_id, record_id, seq, qual, aux, qname, r.mapq, r.flag, r.pos FROM reads_raw r JOIN ordered_reads o USING (record_id)"
    rows = connect(data).sql(sql)
    out = {x[0]: dict(zip(rows.columns, x)) for x in rows.fetchall()}
    for x in out.values():
        x["raw"], q = x["qual"], (x["qual"] or []) + [0] * len(x["seq"])
        x["qual"] = [0 if v in (None, 255) else v for v in q[: len(x["seq"])]]
    assert any(x["raw"] is None for x in out.values()) and any(len(x["raw"] or x["seq"]) < len(x["seq"]) for x in out.values())
    return out


def test_reconstruct_streams_and_aux(spark, data, given):
    rows = alignments.reconstruct_all(spark, data).collect()
    assert sorted(x["read_id"] for x in rows) == sorted(given)
    assert all(x["qual"] == given[x["read_id"]]["qual"] and x["aux"] == given[x["read_id"]]["aux"] for x in rows)
    assert any(x["aux"] for x in rows)
    blank = alignments.reconstruct_streams(spark, data).collect()
    assert all(x["qual"] == [255] * len(x["seq"]) and x["aux"] is None for x in blank) and len(blank) == len(given)
    asked = sorted(alignments.reconstruct_read_ids(spark, data).collect(), key=lambda x: x["request"])
    assert [x["read_id"] for x in asked] == [5, 3, 3, 40]
    assert all(x["qual"] == given[x["read_id"]]["qual"] and x["aux"] == given[x["read_id"]]["aux"] for x in asked)


def test_qualities_of_every_read(spark, data, given):
    """missing is 0 and the length that of seq; no read is left out."""
    want = {x["record_id"]: x["qual"] for x in given.values()}
    got = lambda q: {x["record_id"]: x["qual"] for x in q(spark, data).collect()}
    assert got(alignments.qual_fill_missing) == want
    assert got(alignments.qual_lossy_bin) == {i: [min(93, v // 11 * 11 + 5) for v in q] for i, q in want.items()}
    assert got(alignments.qual_rans_delta) == {i: [v if not k else (v - q[k - 1] + 128) % 256 for k, v in enumerate(q)] for i, q in want.items()}
    assert got(alignments.qual_rans_undelta) == want
    assert got(alignments.qual_cycle_transpose) == {i: [q[k] for k in sorted(range(len(q)), key=lambda k: (k % 10, k))] for i, q in want.items()}


def test_mean_quality_over_all_bases(spark, data, given):
    """Of the matches on reads of any quality, those on reads whose mean over all bases is 20 or more."""
    good = {i for i, x in given.items() if sum(x["qual"]) >= 20 * len(x["qual"])}
    short = {i for i, x in given.items() if i not in good and x["raw"] and sum(0 if v in (None, 255) else v for v in x["raw"]) >= 20 * len(x["raw"])}
    every = alignments._report(alignments.matching.locate(alignments._aligned(spark, data), ["ACGT", "TTAGGG"]), spark, data).collect()
    got = alignments.quality_postfilter(spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(x) for x in every if x["read_id"] in good)
    assert not short & {x["read_id"] for x in got}


def test_filled(spark):
    from strandlake.functions import quality

    df = spark.createDataFrame([(0, None, 3), (1, [255, None, 7], 3), (2, [9], 3), (3, [], 0)], "i int, q array<int>, n bigint")
    assert {x[0]: x[1] for x in df.select("i", quality.filled(df.q, df.n)).collect()} == {0: [0, 0, 0], 1: [0, 0, 7], 2: [9, 0, 0], 3: []}


def test_absolute_positions(spark, data, given):
    assert {x["read_id"]: x["pos"] for x in alignments.abs_pos_dense(spark, data).collect()} == {i: x["pos"] for i, x in given.items()}
    want, last = [], None
    for i, b, c, p in connect(data).sql("SELECT read_id, build_id, chrom_id, pos FROM ordered_reads ORDER BY read_id").fetchall():
        want += [(i, b, c, p)] if (b, c) != last else []
        last = b, c
    assert sorted(map(tuple, alignments.abs_pos_sparse(spark, data).collect())) == want
