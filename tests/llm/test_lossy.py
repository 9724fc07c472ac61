import random
from collections import Counter

import pytest

from strandlake.llm import lossy

SCHEMA = "v string, n int, value int"


@pytest.mark.parametrize("parts", [1, 5])
def test_guarantees(spark, parts):
    r = random.Random(parts)
    values = [r.choice(["hot"] * 6 + ["warm"] * 2 + [f"u{r.randint(0, 5000)}" for _ in range(8)] + [None, ""]) for _ in range(30_000)]
    df = spark.createDataFrame([(v, 1, 2) for v in values], SCHEMA).repartition(parts)
    true = Counter(v for v in values if v is not None)
    total = sum(true.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        eps = 0.004
        got = {x["value"]: x for x in lossy.lossy_counts(df, "v", eps).collect()}
        assert {v for v, n in true.items() if n > eps * total} <= set(got)
        for v, x in got.items():
            assert x["n"] <= true[v] <= x["n"] + x["undercount"] and x["undercount"] <= eps * total and x["total"] == total
        assert len(got) < 600
        found = {x["value"]: x["n"] for x in lossy.frequent_values(df, "v", 0.05).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {v: n for v, n in true.items() if n >= 0.05 * total}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lossy.lossy_counts(empty, "v").count() == 0 and lossy.frequent_values(empty, "v", 0.1).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1)], SCHEMA)
    assert lossy.frequent_values(nulls, "v", 0.1).count() == 0
    ties = spark.createDataFrame([(v, 1, 1) for v in "aabb"] + [("x" * 100_000, 1, 1)], SCHEMA)
    assert {(x["value"], x["n"]) for x in lossy.frequent_values(ties, "v", 0.4).collect()} == {("a", 2), ("b", 2)}
    for bad in (0, 1):
        with pytest.raises(ValueError):
            lossy.lossy_counts(empty, "v", bad)
