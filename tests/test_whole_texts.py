"""Texts that fit a task are ranked and checked there, longer ones and damaged rows by joins: the same results, few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import fm
from strandlake.plans.registry import QUERIES
from tests.test_text_index import arrays, texts_of

ALL, NONE = fm.WHOLE, -1


def jobs(spark, name, data):
    spark.sparkContext.setJobGroup(f"count-{name}", name)
    try:
        rows = QUERIES[name](spark, data).collect()
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{name}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fresh_texts_take_few_jobs(spark, data):
    rows, n = jobs(spark, "verify_text_index", data)
    assert sorted(map(tuple, rows)) == sorted((c, 0) for c in fm.CHECKS) and n <= 30


def test_damaged_symbols_take_few_jobs(spark, data):
    rows, n = jobs(spark, "verify_text_index_damaged", data)
    assert sorted(map(tuple, rows)) == sorted((c, c != "sa_permutation") for c in fm.CHECKS) and n <= 30


@pytest.mark.parametrize("whole", [NONE, 70, ALL])
def test_arrays(spark, whole):
    r = random.Random(7)
    part = "".join(r.choices("ACGT", k=150))
    texts = {**texts_of(4), 20: part + "#" + part + "#" + part, 21: "A" * 300, 22: "AC" * 90 + "#" + "AC" * 90}
    df = spark.createDataFrame([*((str(t), s) for t, s in texts.items()), ("null", None)], "text_id string, s string").repartition(3)
    got = {}
    for x in fm.suffix_array(df, whole).orderBy("text_id", "row").collect():
        got.setdefault(int(x["text_id"]), []).append((x["row"], x["s_pos"], x["code"], x["bwt"]))
    want = {t: arrays(s) for t, s in texts.items()}
    assert got == {t: [(r, i, (texts[t] + "$")[i], b) for r, (i, b) in enumerate(zip(*w))] for t, w in want.items()}


def test_damage_counts_the_same(spark):
    r = random.Random(5)
    texts = {t: "".join(r.choices("ACGT#", [5, 5, 5, 5, 1], k=90 + t)) for t in range(16)} | {17: "", 18: "ACGT"}
    rows = [(t, row, i, (s + "$")[i], s[i - 1] if i else "$") for t, s in texts.items() for row, i in enumerate(arrays(s)[0])]
    at = {(t, row): k for k, (t, row, *_) in enumerate(rows)}

    def put(t, k, **new):
        old = dict(zip(("text_id", "row", "s_pos", "code", "bwt"), rows[at[t, k]]))
        rows[at[t, k]] = tuple((old | new).values())

    put(1, 3, bwt="N"), put(1, 7, bwt="N")  # other symbols
    a, b = rows[at[2, 5]][2], rows[at[2, 40]][2]
    put(2, 5, s_pos=b), put(2, 40, s_pos=a)  # positions changed places
    put(3, 16, s_pos=11)  # a position twice, at a sample
    put(4, 0, bwt="$"), put(4, 50, bwt="$")  # more ends than one
    put(5, 9, bwt="x"), put(6, 9, s_pos=1000), put(7, 9, s_pos=-1), put(8, 9, bwt=None), put(9, 9, s_pos=None)  # what can't be
    put(10, 9, row=2000)
    end = next(row for row in range(len(texts[11]) + 1) if rows[at[11, row]][4] == "$")
    put(11, end, bwt="A")  # no end mark
    rows = [x for k, x in enumerate(rows) if k not in (at[12, 20], at[13, 0]) and x[0] != 14] + [(15, 4, 4, "A", "C"), (99, 0, 0, "$", "A")]
    texts[98] = None
    df = spark.createDataFrame([*texts.items()], "text_id bigint, s string")
    sa = spark.createDataFrame(r.sample(rows, len(rows)), "text_id bigint, row bigint, s_pos bigint, code string, bwt string").repartition(3).localCheckpoint()
    for ids in ([0, 17, 18], [1, 2, 3, 4, 11], list(range(100))):
        one = [x.where(F.col("text_id").isin(ids)) for x in (df, sa)]
        by_joins, inside = ({x["check"]: x["bad"] for x in fm.invariants(*one, "ACGT", 16, w).collect()} for w in (NONE, ALL))
        assert inside == by_joins and any(inside.values()) == (ids != [0, 17, 18]), (ids, inside, by_joins)
