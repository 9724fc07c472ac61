"""Windows over a build's text: greedy segmentation, and the joins that go through it.

Per contig a window opens at a read that starts at l and admits the following reads while they start at or before
l + size - 1. That is a chain, one window after another, but not one that must be walked over all reads: the text is cut
into blocks of BLOCK window sizes, each block lists for every read at which a chain may enter it (a read that starts
within the first window size, and the next one) where that chain leaves. Chains that enter a block at different reads soon
run together, so few leaving points are left; only the entries that follow from those of the block before are kept, and
only these, a few per block, are followed per contig: a loop over the blocks, of which ten trillion text places in one
contig make 1.6 million. Then each block is segmented on its own from its true entry.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize

BLOCK = 64
#: Bins of the window size that one task looks through.
LANE = 1 << 16


def _chain(starts: np.ndarray, entry: int, size: int) -> list[int]:
    """Starts of the windows of the chain that enters at `entry` (a member of starts)."""
    out, i = [], int(np.searchsorted(starts, entry))
    while i < len(starts):
        out.append(int(starts[i]))
        i = int(np.searchsorted(starts, starts[i] + size))
    return out


def _exits(size: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each possible entry of a block: the start of the chain's last window in it."""
        starts = np.sort(pdf["s_start"].to_numpy())
        following = np.searchsorted(starts, starts + size)
        # every read's way to its chain's last window in the block, its steps doubled until none moves on
        way = np.where(following < len(starts), following, np.arange(len(starts)))
        while not np.array_equal(further := way[way], way):
            way = further
        last = starts[way]
        base = int(pdf["block"].iloc[0]) * width
        keep = np.arange(len(starts)) <= np.searchsorted(starts, base + size)
        names = {k: pdf[k].iloc[0] for k in ("build_id", "chrom_id", "block")}
        # a block whose reads all start in its first window size may be passed over by a window of an earlier block
        return pd.DataFrame({**names, "entry": starts[keep], "last": last[keep], "sparse": bool(starts[-1] < base + size)})

    return run


def _follow(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The entry that the contig's chain takes into each block."""
        order = np.lexsort((pdf["entry"].to_numpy(), pdf["block"].to_numpy()))
        block, entry, last = (pdf[c].to_numpy()[order] for c in ("block", "entry", "last"))
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))).tolist()
        entries, lasts = entry.tolist(), last.tolist()
        out, end = [], None
        for a, z in zip(cuts, cuts[1:]):
            i = a if end is None else bisect.bisect_left(entries, end + size, a, z)
            if i == z:
                continue  # the running window covers this whole block
            out.append((int(block[a]), entries[i]))
            end = lasts[i]
        return pd.DataFrame({"build_id": pdf["build_id"].iloc[0], "chrom_id": pdf["chrom_id"].iloc[0], "block": [b for b, _ in out], "entry": [e for _, e in out]})

    return run


def _segment(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(pdf["s_start"].to_numpy())
        made = _chain(starts, int(pdf["entry"].iloc[0]), size)
        return pd.DataFrame({"build_id": pdf["build_id"].iloc[0], "chrom_id": pdf["chrom_id"].iloc[0], "l": made})

    return run


def window_starts(reads: DataFrame, size: int) -> DataFrame:
    """build_id, chrom_id, l: the text positions at which windows open. reads: build_id, chrom_id, s_start.

    A block holds at most BLOCK * size / 2 reads, whatever the contig holds. An empty table gives none.
    """
    width = BLOCK * size
    rows = reads.select("build_id", "chrom_id", "s_start").withColumn("block", F.floor(F.col("s_start") / width).cast("bigint"))
    keys = ["build_id", "chrom_id", "block"]
    exits = rows.groupBy(*keys).applyInPandas(_exits(size, width), "build_id bigint, chrom_id bigint, block bigint, entry bigint, last bigint, sparse boolean")
    exits = materialize(exits, "exits")
    left = exits.select("build_id", "chrom_id", (F.col("block") + 1).alias("block"), F.col("last").alias("__last"), F.col("sparse").alias("__sparse")).distinct()
    follows = left.join(exits, keys).where(F.col("entry") >= F.col("__last") + size).groupBy(*keys, "__last").agg(F.min("entry").alias("entry"))
    certain = left.where("not __sparse").select(*keys).distinct()
    kept = exits.join(follows.select(*keys, "entry").distinct(), [*keys, "entry"], "left_semi").unionByName(exits.join(certain, keys, "left_anti")).distinct()
    entries = kept.groupBy("build_id", "chrom_id").applyInPandas(_follow(size), "build_id bigint, chrom_id bigint, block bigint, entry bigint")
    return rows.join(entries, keys).groupBy(*keys).applyInPandas(_segment(size), "build_id bigint, chrom_id bigint, l bigint")


def window_table(reads: DataFrame, size: int = 100_000) -> DataFrame:
    """build_id, chrom_id, l, r, first_read_id, last_read_id, genomic_start, genomic_end per window.

    reads: build_id, chrom_id, read_id, s_start, l_seq, pos, span (contig bases covered). r is the last base's text place,
    plus its separator unless it is the build's last read; genomic_start is the first read's pos, genomic_end the largest
    pos + span - 1 (pos, where span is 0).
    """
    ends = reads.groupBy("build_id").agg(F.max("read_id").alias("__last"))
    inside = with_window(reads, size)
    rows = inside.groupBy("build_id", "chrom_id", "l").agg(
        F.max(F.col("s_start") + F.col("l_seq")).alias("r"),
        F.min("read_id").alias("first_read_id"),
        F.max("read_id").alias("last_read_id"),
        F.min_by("pos", "read_id").alias("genomic_start"),
        F.max(F.col("pos") + F.greatest(F.col("span") - 1, F.lit(0))).alias("genomic_end"),
    )
    rows = rows.join(ends, "build_id").withColumn("r", F.when(F.col("last_read_id") == F.col("__last"), F.col("r") - 1).otherwise(F.col("r")))
    return rows.drop("__last")


def with_window(reads: DataFrame, size: int) -> DataFrame:
    """reads and l, the start of their window: an as-of join (the latest l at or before s_start) by bins of the window
    size. A window starts in a bin once at most, so a read finds its own in its bin or takes the last one before it."""
    starts = window_starts(reads, size).withColumn("bin", F.floor(F.col("l") / size).cast("bigint"))
    keys = ["build_id", "chrom_id"]
    opened = starts.select(*keys, "bin", F.col("l").alias("__here"))
    bins = reads.select(*keys, F.floor(F.col("s_start") / size).cast("bigint").alias("bin")).distinct()
    # a row per bin: the windows opened in it, and the last one opened in an earlier bin, which is the largest of them;
    # LANE bins are looked through by a task, and one row of each LANE bins carries over
    line = bins.join(opened, [*keys, "bin"], "left").withColumn("__lane", F.floor(F.col("bin") / LANE).cast("bigint"))
    earlier = Window.partitionBy(*keys).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    carry = line.groupBy(*keys, "__lane").agg(F.max("__here").alias("__most")).withColumn("__carry", F.max("__most").over(earlier)).drop("__most")
    inside = Window.partitionBy(*keys, "__lane").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__in", F.max("__here").over(inside)).join(carry, [*keys, "__lane"])
    line = line.select(*keys, "bin", "__here", F.coalesce("__in", "__carry").alias("__before"))
    rows = reads.withColumn("bin", F.floor(F.col("s_start") / size).cast("bigint")).join(line, ["build_id", "chrom_id", "bin"])
    chosen = F.when(F.col("s_start") >= F.col("__here"), F.col("__here")).otherwise(F.col("__before"))
    return rows.withColumn("l", chosen).drop("bin", "__here", "__before")


def window_invariants(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """check, bad: reads that no window of their contig covers, windows whose reads don't follow those of the window before
    (by a join on read_id, for windows lie in the order of reads), windows without a read, and reads outside the stretch of
    the contig that their window states."""
    keys = ["build_id", "chrom_id"]
    ends = windows.select(*keys, F.col("last_read_id").alias("read_id"), F.lit(1).alias("__end"))
    n = reads.count()
    covered = windows.agg(F.coalesce(F.sum(F.col("last_read_id") - F.col("first_read_id") + 1), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("last_read_id") < F.col("first_read_id")).cast("bigint")), F.lit(0)).alias("empty")).first()
    after = windows.select(F.col("first_read_id").alias("__first"), "l")
    before = windows.select((F.col("last_read_id") + 1).alias("__first"), F.col("r").alias("__r"))
    gaps = after.join(before, "__first", "left").where((F.col("__first") > 0) & F.col("__r").isNull()).count()
    back = after.join(before, "__first").where((F.col("l") > 0) & (F.col("l") < F.col("__r"))).count()
    heads = windows.join(reads.select(F.col("read_id").alias("first_read_id"), F.col("s_start").alias("__s"), F.col("pos").alias("__p")), "first_read_id", "left")
    wrong = heads.where(~F.col("l").eqNullSafe(F.col("__s")) | ~F.col("genomic_start").eqNullSafe(F.col("__p"))).count()
    tails = ends.join(reads.select(*keys, "read_id"), [*keys, "read_id"], "left_anti").count()
    rows = [("windows_cover", abs(n - covered["n"])), ("windows_filled", covered["empty"] + tails), ("windows_adjoin", gaps), ("windows_order", back), ("windows_begin", wrong)]
    return reads.sparkSession.createDataFrame([(k, int(v)) for k, v in rows], "check string, bad bigint")


def windows_of_region(windows: DataFrame, chrom_id: int, start: int, end: int) -> DataFrame:
    """The windows that may hold matches of a region: the zone map of region queries."""
    return windows.where((F.col("chrom_id") == chrom_id) & (F.col("genomic_start") <= end) & (F.col("genomic_end") >= start))


def read_at(positions: DataFrame, reads: DataFrame, bin_width: int = 4096) -> DataFrame:
    """The columns of positions (build_id, s_pos) with read_id, offset and is_separator: an as-of join of text positions
    to the latest read start at or before them.

    Both sides meet in bins: a read is listed in every bin that its bases and separator touch, so the join is an equality
    join that a hot build doesn't gather in one task. Positions outside the text are dropped; the text ends with the bases
    of the build's last read, which no separator follows. Positions in a row each are kept; null ones match nothing.
    """
    ends = reads.groupBy("build_id").agg(F.max(F.col("s_start") + F.col("l_seq")).alias("__end"))  # one row per build
    touched = F.sequence(F.floor(F.col("s_start") / bin_width), F.floor((F.col("s_start") + F.col("l_seq")) / bin_width))
    right = reads.select("build_id", "read_id", "s_start", "l_seq", F.explode(touched).alias("__bin"))
    left = positions.join(ends, "build_id").where(F.col("s_pos") < F.col("__end")).withColumn("__bin", F.floor(F.col("s_pos") / bin_width))
    joined = left.join(right, ["build_id", "__bin"]).where("s_pos >= s_start and s_pos <= s_start + l_seq")
    return joined.select(*positions.columns, "read_id", (F.col("s_pos") - F.col("s_start")).alias("offset"), (F.col("s_pos") == F.col("s_start") + F.col("l_seq")).alias("is_separator"))
