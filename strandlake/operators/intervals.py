"""Overlapping and gapped intervals per entity: merged periods and the gaps between them.

Method: sort by start, compare each start with the running maximum of the previous ends, label islands, aggregate.
A plain window per entity would put a hot entity into one task, so the line is cut into bins of bin_width:

1. rows with the same entity and start become one (map-side combined), so a bin never holds more than bin_width rows,
   however many rows its entity has;
2. the running maximum is taken inside each (entity, bin); the maximum carried in from earlier bins comes from a table
   with one row per (entity, bin);
3. what crosses bins afterwards is again one row per (entity, bin).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


class _Islands:
    """Island starts of every entity: __start, and __prev, the largest end before it (null for the first)."""

    def __init__(self, df: DataFrame, entity: list[str], start: str, end: str, touch: int, bin_width: int | None):
        kind = df.schema[start].dataType
        timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        number = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))) if timed else (lambda c: F.col(c).cast("bigint"))
        self.back = (lambda c: F.timestamp_micros(c).cast(kind)) if timed else (lambda c: c)
        width = bin_width or (DAY if timed else 1 << 16)
        self.names = entity
        self.keys = [f"__e{i}" for i in range(len(entity))]
        rows = df.select(*[F.col(e).alias(k) for e, k in zip(entity, self.keys)], number(start).alias("__start"), number(end).alias("__end"))
        rows = rows.where("__end >= __start").groupBy(*self.keys, "__start").agg(F.max("__end").alias("__end"))
        rows = rows.withColumn("__bin", F.floor(F.col("__start") / width).cast("bigint"))
        per_bin = rows.groupBy(*self.keys, "__bin").agg(F.max("__end").alias("__max"))
        line = Window.partitionBy(*self.keys).orderBy("__bin")
        self.bins = per_bin.withColumn("__carry", F.max("__max").over(line.rowsBetween(Window.unboundedPreceding, -1)))
        inside = Window.partitionBy(*self.keys, "__bin").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__in", F.max("__end").over(inside))
        joined = rows.alias("r").join(self.bins.alias("b"), _same("r", "b", [*self.keys, "__bin"]))
        prev = F.greatest("r.__in", "b.__carry")
        self.starts = joined.select(*[F.col(f"r.{k}") for k in [*self.keys, "__bin", "__start"]], prev.alias("__prev")).where(
            F.col("__prev").isNull() | (F.col("__start") > F.col("__prev") + touch)
        )

    def named(self) -> list[Column]:
        return [F.col(k).alias(n) for k, n in zip(self.keys, self.names)]


def interval_gaps(
    df: DataFrame, entity: list[str], start: str, end: str, touch: int = 1, bin_width: int | None = None
) -> DataFrame:
    """Entity columns, gap_start, gap_end (both inclusive when touch is 1; with touch 0, the end of the one and the
    start of the next period): the uncovered stretches between two consecutive periods of an entity.

    Intervals are closed; a start at most `touch` beyond the largest earlier end continues the period. Integer, date and
    timestamp columns are allowed (timestamps in microseconds: use touch=0). Rows with a null start or end or with
    end < start count as no interval; null entities form their own group; repeated rows change nothing; an empty table
    gives no gaps; other columns of df are dropped, whatever their names.
    """
    islands = _Islands(df, entity, start, end, touch, bin_width)
    step = 1 if touch else 0
    return islands.starts.where("__prev is not null").select(
        *islands.named(), islands.back(F.col("__prev") + step).alias("gap_start"), islands.back(F.col("__start") - step).alias("gap_end")
    )


def merge_intervals(
    df: DataFrame, entity: list[str], start: str, end: str, touch: int = 1, bin_width: int | None = None
) -> DataFrame:
    """Entity columns, period_start, period_end: the continuous periods of each entity. Cases as for interval_gaps.

    A period ends at the largest end before the next island's start: inside a bin by lead(), across bins by the first
    island of the next bin that has one.
    """
    islands = _Islands(df, entity, start, end, touch, bin_width)
    inside = Window.partitionBy(*islands.keys, "__bin").orderBy("__start")
    starts = islands.starts.withColumn("__end", F.lead("__prev").over(inside)).withColumn("__last", F.lead("__start").over(inside).isNull())
    firsts = islands.starts.groupBy(*islands.keys, "__bin").agg(F.min_by("__prev", "__start").alias("__first"))
    line = Window.partitionBy(*islands.keys).orderBy("__bin")
    after = firsts.select(*islands.keys, "__bin", F.lead("__first").over(line).alias("__next"))
    whole = islands.bins.groupBy(*islands.keys).agg(F.max("__max").alias("__all"))
    joined = starts.alias("s").join(after.alias("a"), _same("s", "a", [*islands.keys, "__bin"])).join(whole.alias("w"), _same("s", "w", islands.keys))
    period_end = F.when(~F.col("s.__last"), F.col("s.__end")).otherwise(F.coalesce("a.__next", "w.__all"))
    return joined.select(
        *[F.col(f"s.{k}").alias(n) for k, n in zip(islands.keys, islands.names)],
        islands.back(F.col("s.__start")).alias("period_start"),
        islands.back(period_end).alias("period_end"),
    )
