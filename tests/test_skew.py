import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators.skew import heavy_keys, salted_aggregate

SCHEMA = "k string, v bigint, name string, __salt int"


def test_same_as_plain(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 30 + ["a", "b", "c", None]), r.choice([None, *range(50)]), r.choice([None, *"abcdefgh"]), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    measures = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "names": ("count_distinct", F.col("name"))}
    got = sorted(map(repr, salted_aggregate(df, "k", measures, ["name"], salts=4, heavy_share=0.2).collect()))
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_distinct("name").alias("names"))
    assert got == sorted(map(repr, plain.collect()))
    assert heavy_keys(df, "k", 0.2) == ["hot"]


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert salted_aggregate(df, "k", {"n": ("count", F.lit(1))}, ["v"]).count() == 0
    with pytest.raises(ValueError):
        salted_aggregate(df, "k", {"n": ("count_distinct", F.col("v"))}, ["v", "name"])
    with pytest.raises(ValueError):
        heavy_keys(df, "k", 0)
