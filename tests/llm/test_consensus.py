from strandlake.llm import reads
from tests.test_entry import connect


def test_consensus_has_qual_and_flag(spark, data):
    """Every group's qual and flag is one that was delivered; where all deliveries agree, it is that one."""
    rows = connect(data).sql("SELECT record_id, qual, flag FROM reads_raw").fetchall()
    raw = {i: (q if any(v is not None and 0 <= v <= 93 for v in q or []) else None, f) for i, q, f in rows}
    groups = {}
    for x in reads._deliveries(spark, data).where("name is not null").select("name", "mate", "record_id").collect():
        groups.setdefault((x["name"], x["mate"]), []).append(raw[x["record_id"]])
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    got = {(x["name"], x["mate"]): x for x in reads.p5_consensus(spark, data).collect()}
    assert sorted(got) == sorted(groups)
    for k, deliveries in groups.items():
        quals, flags = [q for q, _ in deliveries if q is not None], {f for _, f in deliveries}
        assert got[k]["qual"] in quals if quals else got[k]["qual"] is None
        assert (got[k]["qual_support"] is None) == (not quals)
        assert got[k]["flag"] in flags
    assert any(x["qual"] for x in got.values())
