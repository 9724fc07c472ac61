"""Most frequent values of a huge column in bounded memory, by lossy counting.

Each task reads its rows as a stream of Arrow batches and keeps entries (value, count, undercount). A bucket ends with a
batch of at least 1 / epsilon rows; entries whose count + undercount is not above epsilon times the rows seen so far are
then pruned, so a task holds O(log(epsilon * n) / epsilon) entries plus one batch. Summaries of tasks are merged by
adding counts; the undercount of a merged entry is its own undercount where a summary holds it and the summary's whole
pruning bound where it doesn't. Reported for every value: count <= true count <= count + undercount, with
undercount <= epsilon * n over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import materialize

_SUMMARY = "value string, n bigint, delta bigint, bound bigint, seen bigint"


def _summarise(epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        seen = bound = in_bucket = 0
        for batch in batches:
            column = batch.column(0)
            seen += len(column) - column.null_count
            in_bucket += len(column)
            counted = pc.value_counts(column)
            for value, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                if value is None:
                    continue
                entry = held.get(value)
                if entry is None:
                    held[value] = [n, bound]
                else:
                    entry[0] += n
            if in_bucket * epsilon >= 1:
                bound, in_bucket = int(seen * epsilon), 0
                held = {v: e for v, e in held.items() if e[0] + e[1] > bound}
        values = list(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*values, None], pa.string()),
                pa.array([*[held[v][0] for v in values], 0], pa.int64()),
                pa.array([*[held[v][1] for v in values], 0], pa.int64()),
                pa.array([bound] * (len(values) + 1), pa.int64()),
                pa.array([0] * len(values) + [seen], pa.int64()),
            ],
            names=["value", "n", "delta", "bound", "seen"],
        )

    return run


def lossy_counts(df: DataFrame, column: str, epsilon: float = 0.0005) -> DataFrame:
    """value, n, undercount, total: guaranteed intervals n <= true count <= n + undercount of every value that may make
    up more than epsilon of the non-null rows (total of them); every value with a true share above epsilon is present.

    Nulls are not counted; an empty table gives no rows; '' is a value like any other; ties need no rule since all
    entries above the bound are kept; other columns are dropped. Memory of a task does not depend on the rows, but on
    1 / epsilon and the values' length.
    """
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must be in (0, 1)")
    parts = df.select(F.col(column).cast("string").alias("value")).mapInArrow(_summarise(epsilon), _SUMMARY)
    parts = materialize(parts, "summaries")
    tasks = parts.where("value is null").agg(F.sum("bound").alias("bound"), F.sum("seen").alias("seen")).first()
    bounds, total = tasks["bound"] or 0, tasks["seen"] or 0
    # An entry brings (delta - bound) of its own task; the tasks' bounds are added for all tasks once.
    merged = parts.where("value is not null").groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("delta") - F.col("bound")).alias("less"))
    undercount = F.col("less") + bounds
    kept = merged.where(F.col("n") + undercount > total * epsilon)
    return kept.select("value", "n", undercount.alias("undercount"), F.lit(total).cast("bigint").alias("total"))


def frequent_values(df: DataFrame, column: str, share: float, epsilon: float | None = None) -> DataFrame:
    """value, n: the values that make up at least `share` of the non-null rows, with exact counts.

    The intervals of lossy_counts() decide which values are candidates: at most 1 / (share - epsilon) of them, so their
    list is bounded whatever the data; they alone are recounted exactly. Cases as for lossy_counts.
    """
    epsilon = share / 5 if epsilon is None else epsilon
    if not 0 < epsilon < share:
        raise ValueError("epsilon must be below share")
    counts = lossy_counts(df, column, epsilon).where(F.col("n") + F.col("undercount") >= F.col("total") * share).collect()
    wanted, total = [r["value"] for r in counts], counts[0]["total"] if counts else 0
    value = F.col(column).cast("string")
    rows = df.where(value.isin(wanted) if wanted else F.lit(False))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(total) * share)
