"""Offset in a read -> position on the contig, computed on the read's own row: no join, no shuffle.

Aligned operations (M, = and X) move along read and contig, I and S along the read, D and N along the contig. A read that
is one aligned run, nearly all, is placed by one JVM expression. Other CIGARs of an Arrow batch are laid end to end and
placed by running sums, so the work is linear in the operations and, but for a binary search, in the matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTERS = b"MIDNSHP=X"
_IS_OP, _IS_DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_IS_OP[list(_LETTERS)] = True
_IS_DIGIT[list(b"0123456789")] = True


def _among(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_ALIGNED, _ON_READ, _ON_REF = _among(b"M=X"), _among(b"MIS=X"), _among(b"MDN=X")
_MOST_DIGITS = 18


class PlacedOps:
    """The operations of many CIGARs laid end to end, with their places.

    op, len, row; read_start and ref_start; before, the last contig base of an aligned operation before this one, and
    after, after_read, the starts of the next aligned one, where has_before and has_after hold. first[i] is the place of
    row i's first operation. A null CIGAR has no operations; what is no operation is passed over.
    """

    def __init__(self, cigars: pa.Array, anchors: np.ndarray):
        text = pc.fill_null(cigars.cast(pa.large_binary()), b"")
        cuts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]] if len(text) else np.zeros(0, np.uint8)
        cuts = cuts - cuts[0] if len(cuts) else np.zeros(1, np.int64)
        digit = _IS_DIGIT[raw]
        at = np.flatnonzero(_IS_OP[raw])
        row = np.searchsorted(cuts, at, "right") - 1
        begin = cuts[row]
        size, live, k = np.zeros(len(at), np.int64), np.ones(len(at), bool), 0
        while k < _MOST_DIGITS and len(at):
            spot = at - 1 - k
            live &= (spot >= begin) & digit[np.maximum(spot, 0)]
            if not live.any():
                break
            size[live] += (raw[spot[live]].astype(np.int64) - 48) * 10**k
            k += 1
        numbered = (at > begin) & digit[np.maximum(at - 1, 0)] if len(at) else np.zeros(0, bool)
        self.op, self.len, self.row = raw[at[numbered]], size[numbered], row[numbered]
        n, rows = len(self.op), len(cuts) - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.aligned, on_read = _ALIGNED[self.op], _ON_READ[self.op]

        def starts(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            before = np.concatenate(([0], np.cumsum(np.where(moves, self.len, 0))))
            return before[:-1] - before[self.first[self.row]], before[self.first[1:]] - before[self.first[:-1]]

        self.read_start, self.read_total = starts(on_read)
        ref, _ = starts(_ON_REF[self.op])
        self.anchors = anchors
        self.ref_start = ref + anchors[self.row]
        places = np.arange(n)
        last = np.maximum.accumulate(np.where(self.aligned & (self.len > 0), places, -1)) if n else places
        prev = np.concatenate(([-1], last[:-1])) if n else places
        self.has_before = prev >= self.first[self.row]
        self.before = np.where(self.has_before, self.ref_start[prev] + self.len[prev] - 1, 0) if n else places
        following = np.minimum.accumulate(np.where(self.aligned, places, n)[::-1])[::-1] if n else places
        nxt = np.concatenate((following[1:], [n])) if n else places
        self.has_after = nxt < self.first[self.row + 1]
        safe = np.minimum(nxt, max(n - 1, 0))
        self.after = np.where(self.has_after, self.ref_start[safe], 0) if n else places
        self.after_read = np.where(self.has_after, self.read_start[safe], 0) if n else places
        # operations that hold read bases, on one line of all rows' bases
        self.base = np.cumsum(self.read_total) - self.read_total
        self.holds = np.flatnonzero(on_read & (self.len > 0))
        self.line = (self.base[self.row] + self.read_start)[self.holds]

    def position(self, row: np.ndarray, offset: np.ndarray, right: bool) -> np.ndarray:
        """Position of the read base at `offset` of each row. Inside an insertion the nearest aligned base on the given
        side counts (right: the next one, else the last before; left: the last before); inside a soft clip the nearer
        aligned base, where the first clipped base has distance 0 from the base before it and ties go to the smaller
        position. Without any aligned base on the wanted side, and past the CIGAR, the read's own position."""
        anchor = self.anchors[row]
        if not len(self.holds):
            return anchor
        inside = (offset >= 0) & (offset < self.read_total[row])
        i = self.holds[np.maximum(np.searchsorted(self.line, self.base[row] + np.where(inside, offset, 0), "right") - 1, 0)]
        gap = offset - self.read_start[i]
        before = np.where(self.has_before[i], self.before[i], anchor)
        inserted = np.where(self.has_after[i], self.after[i], before) if right else before
        ahead = self.after_read[i] - offset
        nearer = np.where(gap == ahead, np.minimum(self.before[i], self.after[i]), np.where(gap < ahead, self.before[i], self.after[i]))
        clipped = np.where(self.has_before[i] & self.has_after[i], nearer, np.where(self.has_after[i], self.after[i], before))
        found = np.where(self.aligned[i], self.ref_start[i] + gap, np.where(self.op[i] == ord("I"), inserted, clipped))
        return np.where(inside, found, anchor)


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


_OP = T.StructType(
    [T.StructField("op", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("len", "read_start", "ref_start", "prev_aligned_ref", "next_aligned_ref", "next_aligned_read")]]
)


@F.arrow_udf(T.ArrayType(_OP))
def _placed_ops(cigar: pa.Array, anchor: pa.Array) -> pa.Array:
    ops = PlacedOps(cigar, _numbers(anchor))
    maybe = lambda x, known: pa.array(x, pa.int64(), mask=~known)
    columns = [
        pa.array(list(ops.op.tobytes().decode("ascii")), pa.string()),
        *[pa.array(x, pa.int64()) for x in (ops.len, ops.read_start, ops.ref_start)],
        maybe(ops.before, ops.has_before), maybe(ops.after, ops.has_after), maybe(ops.after_read, ops.has_after),
    ]
    return _lists(pa.StructArray.from_arrays(columns, names=_OP.names), np.diff(ops.first))


_ENDS = T.StructType([T.StructField("p_min", T.LongType()), T.StructField("p_max", T.LongType())])


@F.arrow_udf(T.ArrayType(_ENDS))
def _intervals(cigar: pa.Array, anchor: pa.Array, offsets: pa.Array, widths: pa.Array) -> pa.Array:
    """The places of matches, given per read as arrays of offsets and widths; a null array gives an empty one."""
    ops = PlacedOps(cigar, _numbers(anchor))
    sizes = _numbers(pc.list_value_length(offsets))
    row, first, width = np.repeat(np.arange(len(sizes)), sizes), _numbers(offsets.flatten()), _numbers(widths.flatten())
    a, z = ops.position(row, first, False), ops.position(row, first + width - 1, True)
    ends = pa.StructArray.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], names=_ENDS.names)
    return _lists(ends, sizes)


def with_placed_ops(df: DataFrame, cigar: Column, anchor: Column, name: str) -> DataFrame:
    """df with `name`: an array of op, len, read_start, ref_start, prev_aligned_ref (last contig base of an aligned
    operation before this one), next_aligned_ref and next_aligned_read (starts of the next aligned operation). A null CIGAR
    and one without operations give an empty array."""
    return df.withColumn(name, _placed_ops(cigar, anchor))


def match_intervals(cigar: Column, anchor: Column, hits: Column) -> Column:
    """array<struct<p_min, p_max>> of an array of matches (offset, width) on one read.

    A null or '*' CIGAR places every match at the anchor; one aligned run places it without Python, and the part past the
    run's end at the anchor. Only the other reads' matches are handed to the batch form.
    """
    run = F.regexp_extract(cigar, r"^(\d+)[M=X]$", 1)
    length = F.when(cigar.isNull() | cigar.isin("", "*"), F.lit(0)).when(run != "", run).cast("bigint")

    def on_run(h: Column) -> Column:
        spot = lambda at: F.when(at < length, anchor + at).otherwise(anchor)
        a, z = spot(h["offset"]), spot(h["offset"] + h["width"] - 1)
        return F.struct(F.least(a, z).alias("p_min"), F.greatest(a, z).alias("p_max"))

    other = F.when(length.isNull(), hits)
    placed = _intervals(F.when(length.isNull(), cigar), anchor, F.transform(other, lambda h: h["offset"]), F.transform(other, lambda h: h["width"]))
    return F.when(length.isNull(), placed).otherwise(F.transform(hits, on_run))


def with_match_interval(df: DataFrame) -> DataFrame:
    """df (pos, cigar, offset, width: a row per match) with p_min and p_max."""
    one = F.array(F.struct(F.col("offset").cast("bigint").alias("offset"), F.col("width").cast("bigint").alias("width")))
    # as a generator's output the two can be filtered on without the optimizer copying their expressions into the filter
    return df.select(*df.columns, F.inline(match_intervals(F.col("cigar"), F.col("pos"), one)))
