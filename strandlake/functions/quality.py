"""Quality arrays as expressions: missing values, lossy bins, deltas, cycle order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(qual: Column, length: Column | None = None) -> Column:
    """255 (missing) becomes 0. With a length, so many values come out: a null array, null elements and an absent tail are
    0 too."""
    if length is None:
        return F.transform(qual, lambda q: F.when(q == 255, 0).otherwise(q))
    n = length.cast("int")
    given = F.coalesce(qual, F.array().cast("array<int>"))
    padded = F.slice(F.concat(given, F.array_repeat(F.lit(0), F.greatest(n - F.size(given), F.lit(0)))), F.lit(1), n)
    return F.transform(padded, lambda q: F.when(q.isNull() | (q == 255), 0).otherwise(q))


def binned(qual: Column, bins: int) -> Column:
    """Each value becomes the middle of its bin of 93 div bins values; 0 and 94 or more bins change nothing."""
    if not 0 < bins < 94:
        return qual
    width = 93 // bins
    return F.transform(qual, lambda q: F.least(F.lit(93), F.floor(q / width).cast("int") * width + width // 2))


def delta(qual: Column) -> Column:
    """The first value, then differences to the value before plus 128, modulo 256."""
    return F.transform(qual, lambda q, i: F.when(i == 0, q).otherwise(F.pmod(q - F.get(qual, i - 1) + 128, F.lit(256))))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def undelta(coded: pa.Array) -> pa.Array:
    """Inverse of delta: running sums, each value after the first held within 0 .. 93 before the next is added to it. A null
    difference changes nothing; a null array stays null. Sums of all arrays are taken at once; only an array in which a
    value leaves the range is walked value by value."""
    sizes = pc.fill_null(pc.list_value_length(coded), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = pc.fill_null(coded.flatten(), 128).to_numpy(zero_copy_only=False).astype(np.int64) - 128
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[sizes > 0]
    step[begins] += 128
    total = np.cumsum(step)
    out = total - np.repeat(np.concatenate(([0], total))[begins], sizes[sizes > 0])
    wrong = (out < 0) | (out > 93)
    wrong[begins] = False
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in np.unique(owner[wrong]):
        value, held = 0, []
        for k, d in enumerate(step[ends[i] - sizes[i] : ends[i]].tolist()):
            value = d if k == 0 else min(93, max(0, value + d))
            held.append(value)
        out[ends[i] - sizes[i] : ends[i]] = held
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    mask = coded.is_null() if coded.null_count else None
    return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int32()), mask=mask)


def cycle_order(qual: Column, period: int) -> Column:
    """The values ordered by (place mod period, place): those of one cycle beside each other."""
    keyed = F.transform(qual, lambda q, i: F.struct((i % period).alias("c"), i.alias("i"), q.alias("q")))
    return F.transform(F.array_sort(keyed), lambda x: x["q"])


def uncycle(coded: Column, period: int) -> Column:
    """Inverse of cycle_order."""
    places = F.transform(F.array_sort(F.transform(coded, lambda _, i: F.struct((i % period).alias("c"), i.alias("i")))), lambda x: x["i"])
    return F.transform(F.array_sort(F.zip_with(places, coded, lambda i, q: F.struct(i.alias("i"), q.alias("q")))), lambda x: x["q"])
