"""Bit vectors over texts: the marks of read or window starts, with rank, select and access.

A vector is a table with a row for each WIDTH places of its line (a build's text, say): the places of its ones within the
block, and how many ones stand before it. Nothing of a line is gathered in one task but one row per block's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordering import with_running_sum

WIDTH = 4096


def bit_vector(ones: DataFrame, lengths: DataFrame, line: str, place: str, width: int = WIDTH) -> DataFrame:
    """line, block, ones (places within the block, ascending), before: the vector with a one at every `place` of `ones`,
    0-based, as long as `lengths` (line, length) has it. Repeated places count once; those that are null or outside the
    line are left out; a line without ones has blocks of zeros; a line of length 0 or null has none."""
    blocks = lengths.where("length > 0").select(line, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / width).cast("bigint"))).alias("block"))
    marks = ones.where(F.col(place) >= 0).select(F.col(line).alias("__line"), F.floor(F.col(place) / width).cast("bigint").alias("__block"), F.pmod(place, F.lit(width)).cast("int").alias("__at"))
    held = marks.groupBy("__line", "__block").agg(F.array_sort(F.collect_set("__at")).alias("ones"))  # at most width ones
    rows = blocks.join(held, (F.col(line) == F.col("__line")) & (F.col("block") == F.col("__block")), "left").drop("__line", "__block")
    inside = F.filter(F.coalesce("ones", F.array().cast("array<int>")), lambda x: F.col("block") * width + x < F.col("length"))
    rows = rows.withColumn("ones", inside).withColumn("__n", F.size("ones").cast("bigint"))
    return with_running_sum(rows, line, "block", "__n", "before").select(line, "block", "ones", "before", "length")


def _met(vector: DataFrame, asked: DataFrame, line: str, place: str, width: int) -> DataFrame:
    right = vector.select(F.col(line).alias("__line"), F.col("block").alias("__block"), "ones", "before", "length")
    left = asked.withColumn("__of", F.floor(F.col(place) / width).cast("bigint"))
    return left.join(right, (F.col(line) == F.col("__line")) & (F.col("__of") == F.col("__block"))).where((F.col(place) >= 0) & (F.col(place) < F.col("length")))


def access(vector: DataFrame, asked: DataFrame, line: str, place: str, width: int = WIDTH) -> DataFrame:
    """asked with bit: whether there is a one at place. Places outside the line are dropped."""
    rows = _met(vector, asked, line, place, width)
    return rows.select(*asked.columns, F.array_contains("ones", F.pmod(place, F.lit(width)).cast("int")).alias("bit"))


def rank(vector: DataFrame, asked: DataFrame, line: str, place: str, width: int = WIDTH) -> DataFrame:
    """asked with rank: the ones at places 0 .. place, both included. Places outside the line are dropped."""
    rows = _met(vector, asked, line, place, width)
    upto: Column = F.size(F.filter("ones", lambda x: x <= F.pmod(place, F.lit(width)).cast("int"))).cast("bigint")
    return rows.select(*asked.columns, (F.col("before") + upto).alias("rank"))


def select(vector: DataFrame, asked: DataFrame, line: str, k: str, width: int = WIDTH) -> DataFrame:
    """asked with place: that of the k-th one, k from 1. A k that no one has is dropped."""
    each = vector.select(F.col(line).alias("__line"), F.posexplode("ones").alias("__i", "__x"), "block", "before")
    each = each.select("__line", (F.col("before") + F.col("__i") + 1).alias("__k"), (F.col("block") * width + F.col("__x")).alias("place"))
    return asked.join(each, (F.col(line) == F.col("__line")) & (F.col(k) == F.col("__k"))).select(*asked.columns, "place")
