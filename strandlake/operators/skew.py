"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

Keys holding at least heavy_share of all rows are found by a sketch (a pass over the keys without a count per key; at most
2 / heavy_share are listed, so the list on the driver is bounded). Their rows are spread over `salts` partial groups;
the partials of a key, at most `salts` rows, are merged by the original key.

The salt is a hash of the row's salt columns rather than a random draw: a task that is run again after a lost executor
then sends every row to the same partial group, and rows with equal values of a counted-distinct column meet in one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a sketch tracks, and the share of the rows by which its counts may be wrong (3.5 / items).
SKETCH_ITEMS, SKETCH_ERROR = 10_000, 0.0005

#: How partial results of each kind are made and put together.
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "count_distinct": F.sum}


def heavy_keys(df: DataFrame, key: str, heavy_share: float = 0.01) -> list:
    """The keys, null left out, that may have at least heavy_share of the rows: all that do, and perhaps some just below.

    They come from a frequent-items sketch of bounded size, of which each task makes one: its counts are wrong by at most
    SKETCH_ERROR of the rows, so heavy_share must be above that. Taking a lighter key for heavy changes no result.
    """
    if not SKETCH_ERROR < heavy_share <= 1:
        raise ValueError(f"heavy_share must be in ({SKETCH_ERROR}, 1]")
    most = math.ceil(2 / heavy_share)
    rows = df.select(F.col(key).alias("__key"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(__key, {most}, {max(SKETCH_ITEMS, most)})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= (heavy_share - SKETCH_ERROR) * row["n"]]


def salted_aggregate(
    df: DataFrame,
    key: str,
    measures: dict[str, tuple[str, Column]],
    salt_by: list[str],
    salts: int = 32,
    heavy_share: float = 0.01,
) -> DataFrame:
    """key and one column per measure (name -> (kind, column), kind of count, sum, min, max, count_distinct).

    Only one distinct-counted column is possible and it must be the sole salt_by column, so that equal values share a
    partial group. Rows with a null key form one group, which is salted as well; null measure values are skipped as in
    SQL; an empty table gives no rows; other columns of df are dropped, whatever their names.
    """
    if any(kind == "count_distinct" for kind, _ in measures.values()) and len(salt_by) != 1:
        raise ValueError("a distinct count needs its own column as the only salt_by column")
    heavy = heavy_keys(df, key, heavy_share)
    hot = F.col(key).isNull() | (F.col(key).isin(heavy) if heavy else F.lit(False))
    salt = F.when(hot, F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0))
    names = {f"__m{i}": name for i, name in enumerate(measures)}
    rows = df.select(F.col(key).alias("__key"), salt.cast("int").alias("__salt"), *[c.alias(m) for m, (_, c) in zip(names, measures.values())])
    partial = rows.groupBy("__key", "__salt").agg(*[_PARTIAL[kind](m).alias(m) for m, (kind, _) in zip(names, measures.values())])
    merged = partial.groupBy("__key").agg(*[_MERGE[kind](m).alias(m) for m, (kind, _) in zip(names, measures.values())])
    return merged.select(F.col("__key").alias(key), *[F.col(m).alias(n) for m, n in names.items()])
