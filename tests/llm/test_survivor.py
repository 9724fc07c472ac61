import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm.survivor import survivors, truth_discovery

SCHEMA = "k string, good boolean, q int, at int, id bigint, n string, keep string"


def test_survivors(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", "c", None]), r.choice([True, False]), r.choice([None, 1, 2, 3]), r.choice([None, 1, 2]), i, "x", "y") for i in range(200)] + [("single", True, 1, 1, 999, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = survivors(df, ["k"], {"best": (None, [F.col("good"), F.col("q"), -F.col("id")], F.col("id")), "late": (F.col("q").isNotNull(), [F.col("at"), -F.col("id")], F.col("id"))})
    low = lambda v: -1 if v is None else v
    want = {}
    for k in {x[0] for x in rows} - {None, "single"}:
        own = [x for x in rows if x[0] == k]
        pool = [x for x in own if x[2] is not None]
        want[k] = (len(own), max(own, key=lambda x: (x[1], low(x[2]), -x[4]))[4], max(pool, key=lambda x: (low(x[3]), -x[4]))[4] if pool else None)
    assert {x["k"]: (x[1], x["best"], x["late"]) for x in got.collect()} == want
    assert survivors(df.where("id < 0"), ["k"], {"best": (None, [F.col("q")], F.col("id"))}).count() == 0


def test_truth_discovery_beats_counting(spark):
    """Three poor sources that copy each other's errors outvote one good one in a plain count."""
    r = np.random.default_rng(3)
    rows, truth = [], {}
    for g in range(300):
        truth[g] = str(r.integers(0, 50))
        wrong = str(r.integers(50, 60))
        for s in ("good", "fair", "bad1", "bad2", "bad3"):
            right = r.random() < {"good": 0.97, "fair": 0.9}.get(s, 0.35)
            rows.append((g, s, truth[g] if right else wrong, None if r.random() < 0.2 else "z", "extra"))
    df = spark.createDataFrame(rows, "g int, src string, a string, b string, a_support string").repartition(4)
    out = {x["g"]: x for x in truth_discovery(df, ["g"], "src", ["a", "b"]).collect()}
    plain = {}
    for g, _, a, _, _ in rows:
        plain.setdefault(g, []).append(a)
    ours = np.mean([out[g]["a"] == truth[g] for g in truth])
    votes = np.mean([max(sorted(set(v)), key=v.count) == truth[g] for g, v in plain.items()])
    assert ours > votes and ours > 0.85
    assert all(x["b"] in (None, "z") and 0 < x["a_support"] <= 1 for x in out.values())


def test_truth_edges(spark):
    schema = "g int, src string, a string, b string"
    assert truth_discovery(spark.createDataFrame([], schema), ["g"], "src", ["a"]).count() == 0
    rows = [(1, "s", None, "x"), (2, "s", "q", None), (2, "t", "p", None), (None, "s", "q", "q"), (3, None, "q", "q")]
    out = {x["g"]: (x["a"], x["b"]) for x in truth_discovery(spark.createDataFrame(rows, schema), ["g"], "src", ["a", "b"]).collect()}
    assert out == {1: (None, "x"), 2: ("p", None), 3: (None, None)}


def test_truth_keeps_types(spark):
    import datetime

    import pytest

    day = datetime.date(2020, 1, 2)
    df = spark.createDataFrame([(1, "s", 7, 1.5, day, [1]), (1, "t", 7, 1.5, day, [1]), (1, "u", 9, 2.5, None, [2])], "g int, src string, i bigint, d double, t date, a array<int>")
    x = truth_discovery(df, ["g"], "src", ["i", "d", "t"]).first()
    assert (x["i"], x["d"], x["t"], x["settled"]) == (7, 1.5, day, True) and x["rounds"] >= 1
    with pytest.raises(ValueError):
        truth_discovery(df, ["g"], "src", ["a"])
