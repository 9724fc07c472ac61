"""Total order of reads, dense ranks and running sums without a single-task window.

Rows are range-partitioned and sorted by the full key, numbered inside their partition and written once; the number of
rows in earlier partitions, one figure per partition, makes the ranks global. Running sums are taken inside blocks of
BLOCK ranks, plus the sums of earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandlake.session import broadcast_if_small, materialize

BLOCK = 1 << 16
ORDER = ["build_id", "chrom_id", "pos", "source_file_id", "bam_offset", "record_id"]


def with_rank(df: DataFrame, keys: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with `name`, the 0-based place of each row under keys (columns or expressions). Keys must identify a row for
    the ranks to be the same in every run; nulls come first; an empty table gives none."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    placed = df.repartitionByRange(n, *named).sortWithinPartitions(*named).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # at most n rows
    return joined.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__before")


def with_running_sums(df: DataFrame, group: str, rank: str, values: dict[str, str]) -> DataFrame:
    """df with a column for each of values (name -> column): the sum of the column over the rows of the same group with a
    smaller rank (0 for the first). Nulls count as 0."""
    blocks = df.withColumn("__block", F.floor(F.col(rank) / BLOCK).cast("bigint"))
    sums = blocks.groupBy(group, "__block").agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = [F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in values]
    sums = sums.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), *before)
    inside = Window.partitionBy(group, "__block").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__in_{n}") for n, v in values.items()])
    joined = rows.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(n) for n in values])


def with_running_sum(df: DataFrame, group: str, rank: str, value: str, name: str) -> DataFrame:
    """The same for one column."""
    return with_running_sums(df, group, rank, {name: value})


def _places(group: int, width: int):
    """Adds to sorted rows their place in the partition and, per group, the sum of the widths before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, before = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            widths = batch.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.empty(len(groups), np.int64)
            cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            for a, z in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(groups)]))):
                if z > a:
                    run = np.cumsum(widths[a:z])
                    sums[a:z] = before.get(groups[a], 0) + run - widths[a:z]
                    before[groups[a]] = before.get(groups[a], 0) + int(run[-1])
            own = [pa.repeat(pa.scalar(part, pa.int64()), len(groups)), pa.array(np.arange(n, n + len(groups))), pa.array(sums)]
            n += len(groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "__part", "__place", "__sum"])

    return run


def with_rank_and_sum(df: DataFrame, keys: list[str], rank: str, group: str, width: str, name: str) -> DataFrame:
    """df with `rank`, the place of each row under keys, and `name`, the sum of `width` over the earlier rows of the same
    group. keys begin with group; group and width hold whole numbers without nulls.

    One shuffle: rows are numbered and summed where the range sort leaves them and written once; what came in earlier
    partitions, one row per partition and group, is added afterwards without moving rows, so that the result is still
    sorted.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in ("__part", "__place", "__sum")]])
    placed = materialize(placed.mapInArrow(_places(df.columns.index(group), df.columns.index(width)), schema), "placed")
    per = placed.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n"), F.sum(width).alias("__w"))
    same = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("__part").agg(F.sum("__n").alias("__n"))
    ranks = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__rank"))
    sums = per.select("__part", F.col(group).alias("__group"), F.coalesce(F.sum("__w").over(same), F.lit(0)).alias("__before"))
    offsets = broadcast_if_small(sums.join(ranks, "__part").withColumnRenamed("__part", "__p"))
    joined = placed.join(offsets, (F.col("__part") == F.col("__p")) & (F.col(group) == F.col("__group")))
    return joined.select(*df.columns, (F.col("__rank") + F.col("__place")).alias(rank), (F.col("__before") + F.col("__sum")).alias(name))


def order_reads(reads: DataFrame) -> DataFrame:
    """read_id (dense rank over all builds in order), and s_start, the start of the read in its build's text, where reads
    are joined by one separator. reads: the ORDER columns and l_seq; rows delivered twice are ordered by record_id."""
    rows = reads.select(*ORDER, "l_seq").withColumn("__width", F.col("l_seq") + 1)
    return with_rank_and_sum(rows, ORDER, "read_id", "build_id", "__width", "s_start").drop("__width")


def text_lengths(reads: DataFrame) -> DataFrame:
    """build_id, s_length: bases plus the separators between a build's reads."""
    return reads.groupBy("build_id").agg((F.sum("l_seq") + F.count(F.lit(1)) - 1).alias("s_length"))
