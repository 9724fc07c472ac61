import itertools
import random

import pytest

from strandlake.llm import packing

DOCS = "doc_id bigint, text string, piece string, tokens int"
SPECS = "spec_id bigint, capacity bigint"


def test_fill_one_is_best():
    r = random.Random(1)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(0, 9))]
        room = r.randint(0, 60)
        counts = {l: items.count(l) for l in items}
        got = packing.fill_one(counts, sorted(counts, reverse=True), room)
        best = max((sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room), default=0)
        assert sum(got) == best and all(got.count(l) <= counts[l] for l in got)


def test_whole_and_tight(spark):
    r = random.Random(2)
    rows = [(i, "é" * r.randint(0, 40) + "x" * int(r.expovariate(1 / 120)), "p", 1) for i in range(3000)]
    rows += [(9000, None, "", 1), (9001, "", "", 1), (9002, " \n\t", "", 1), (9003, "y" * 50_000, "", 1), (9004, "z" * 199, "", 1), (9005, "z" * 200, "", 1), (None, "n", "", 1), (1, rows[1][1] or "a", "p", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    specs = spark.createDataFrame([(1, 200), (2, 1000), (3, None), (4, 0), (None, 5)], SPECS)
    out = packing.pack_documents(df, specs).collect()
    sizes = sorted((-1 if d is None else d, len(t.encode()) + 1) for d, t, _, _ in rows if t and t.strip())
    for spec, cap in ((1, 200), (2, 1000)):
        own = [x for x in out if x["spec_id"] == spec]
        held = {}
        for x in own:
            held.setdefault(x["container_id"], []).append(x)
        assert all(sum(y["tokens"] for y in c) == c[0]["container_tokens"] <= cap for c in held.values())
        total = {}
        for x in own:
            total.setdefault((x["doc_id"], ), []).append((x["piece"], x["first_token"], x["tokens"]))
        assert sum(x["tokens"] for x in own) == sum(n for _, n in sizes)
        whole = {d for d, n in sizes if n <= cap}
        assert {x["doc_id"] for x in own if x["piece"] > 0} == {d for d, n in sizes if n > cap}
        assert {x["doc_id"] if x["doc_id"] is not None else -1 for x in own} == {d for d, _ in sizes} and whole
        long = sorted(total[9003,])
        assert [p for p, _, _ in long] == list(range(len(long))) and all(a + n == b for (_, a, n), (_, b, _) in zip(long, long[1:]))
        least = -(-sum(n for _, n in sizes) // cap)
        assert len(held) <= least * 1.04 + 8
    assert {x["spec_id"] for x in out} == {1, 2}


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    specs = spark.createDataFrame([(1, 10)], SPECS)
    assert packing.pack_documents(empty, specs).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, "abc", "", 1)], DOCS), specs.where("spec_id > 9")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty, spark.range(1, 1500).selectExpr("id spec_id", "id capacity"))
