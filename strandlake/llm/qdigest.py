"""Percentiles by compressed dyadic-tree counts (q-digest): mergeable, with deterministic rank error.

A value is quantised to an integer of a universe 0 .. 2^bits - 1. Node 1 is the root, node i has children 2i and 2i + 1,
and value v sits at leaf 2^bits + v. A digest of n values holds node counts; compression moves the counts of two
siblings into their parent where the three together stay at or below n * epsilon / bits. A rank read from a digest is
then wrong by at most epsilon * n: each of the `bits` ancestors of a leaf holds at most n * epsilon / bits values whose
place under it is unknown. Digests are put together by adding the counts of equal nodes and compressing again: a node's
count stays at or below the sum of the parts' bounds, so the error is at most epsilon of the sum of the n.

Every task keeps compressed digests while it reads, at most about 3 * bits / epsilon nodes each, and only those are
shuffled: neither the values nor their number of different ones reach another task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes that a task holds over all groups before it hands its digests on and begins anew.
ROOM = 2_000_000
#: Parts in which a group's digests are put together before the last step.
PARTS = 32


def added(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node once, ascending, with the sum of its counts."""
    own, inverse = np.unique(nodes, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, inverse, counts)
    return own, out


def compress(nodes: np.ndarray, counts: np.ndarray, bits: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The compressed digest of one group, nodes ascending. Counts and limit are integers, so that it is deterministic."""
    nodes, counts = added(np.asarray(nodes, np.int64), np.asarray(counts, np.int64))
    limit = int(int(counts.sum()) * epsilon / bits)
    if limit <= 0:
        return nodes, counts
    level = np.floor(np.log2(np.maximum(nodes, 1))).astype(np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    ids, held = nodes[level == bits], counts[level == bits]
    for l in range(bits, 0, -1):
        above, own = nodes[level == l - 1], counts[level == l - 1]
        parents, inverse = np.unique(ids >> 1, return_inverse=True)
        both = np.zeros(len(parents), np.int64)
        np.add.at(both, inverse, held)
        there = np.searchsorted(above, parents)
        safe = np.minimum(there, max(len(above) - 1, 0))
        mine = np.where((there < len(above)) & (above[safe] == parents), own[safe], 0) if len(above) else np.zeros(len(parents), np.int64)
        fits = both + mine <= limit
        kept.append((ids[~fits[inverse]], held[~fits[inverse]]))
        ids, held = added(np.concatenate((above, parents[fits])), np.concatenate((own, both[fits])))
    kept.append((ids, held))
    return added(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))


def _digest_task(n_keys: int, bits: int, epsilon: float, last: int):
    size = 1 << bits
    enough = max(4096, 8 * int(3 * bits / epsilon))  # nodes of one group after which it is compressed again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}
        total, names, kinds = 0, None, None

        def pack(group: tuple) -> None:
            nodes, counts = held[group]
            held[group] = [[x] for x in compress(np.concatenate(nodes), np.concatenate(counts), bits, epsilon)]

        def out() -> pa.RecordBatch:
            for g in held:
                pack(g)
            reps = [len(x[0][0]) for x in held.values()]
            rows = np.repeat(np.arange(len(reps)), reps)
            keys = [pa.array([g[i] for g in held], k).take(pa.array(rows)) for i, k in enumerate(kinds)]
            whole = [np.concatenate([x[i][0] for x in held.values()]) if held else np.zeros(0, np.int64) for i in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(rows), part, np.int64)), *map(pa.array, whole)], names=[*names, "__part", "node", "n"])

        for batch in batches:
            names, kinds = batch.schema.names[:n_keys], [f.type for f in batch.schema][:n_keys]
            column = batch.column(n_keys)
            row = np.arange(batch.num_rows)
            if pa.types.is_list(column.type):
                row = np.repeat(row, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
                column = column.flatten()
            values = pc.fill_null(column, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(n_keys):
                coded = pc.dictionary_encode(batch.column(i), null_encoding="encode")
                code = code * len(coded.dictionary) + coded.indices.to_numpy()
                _, code = np.unique(code, return_inverse=True)
            first = np.unique(code, return_index=True)[1]
            good = (values >= 0) & (values <= last)
            line, n = np.unique(code[row[good]] * size + values[good], return_counts=True)
            cuts = np.searchsorted(line, np.arange(len(first) + 1) * size)
            for g, at in enumerate(first.tolist()):
                a, z = cuts[g], cuts[g + 1]
                if a == z:
                    continue
                group = tuple(batch.column(i)[at].as_py() for i in range(n_keys))
                nodes, counts = held.setdefault(group, [[], []])
                nodes.append(line[a:z] - g * size + size), counts.append(n[a:z])
                total += z - a
                if sum(map(len, nodes)) > enough:
                    total -= sum(map(len, nodes))
                    pack(group)
                    total += len(held[group][0][0])
            if total > ROOM:
                yield out()
                total = 0
        if held:
            yield out()

    return run


_NODES = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType())]))


def _compressed(digest: Column, bits: int, epsilon: float) -> Column:
    """The compressed form of an array of (node, n), nodes maybe repeated."""

    @F.arrow_udf(_NODES)
    def run(digests: pa.Array) -> pa.Array:
        flat, ends = digests.flatten(), np.cumsum(pc.list_value_length(digests).to_numpy(zero_copy_only=False))
        node, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        done = [compress(node[a:z], n[a:z], bits, epsilon) for a, z in zip(np.concatenate(([0], ends[:-1])), ends)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x, _ in done])))
        both = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(b) for b in both], names=["node", "n"]))

    return run(digest)


def _gather(nodes: DataFrame, keys: list[str], part: Column, bits: int, epsilon: float) -> DataFrame:
    """Digests put together in two steps, first PARTS to a group (by `part`, so that a digest stays whole), then all: an
    array holds the nodes of a PARTS-th of the tasks, or PARTS compressed digests."""
    for step in ([*keys, "__p"], keys):
        rows = nodes.withColumn("__p", F.pmod(part, F.lit(PARTS))) if "__p" in step else nodes
        summed = rows.groupBy(*step, "node").agg(F.sum("n").alias("n"))
        grouped = summed.groupBy(*step).agg(F.collect_list(F.struct("node", "n")).alias("digest"))
        nodes = grouped.select(*step, F.inline(_compressed(F.col("digest"), bits, epsilon)))
    return nodes


def digest(df: DataFrame, keys: list[str], value: Column, bits: int, epsilon: float = 0.01, last: int | None = None) -> DataFrame:
    """keys, node, n: a digest per group of the integers `value`, a number or an array of numbers per row, in
    0 .. 2^bits - 1 (or up to `last`).

    Digests are compressed in the tasks that read the values; a hot group costs no more to shuffle than another. Values
    that are null or outside the universe are left out; a group without values has no rows; null keys form a group; an
    empty table gives no rows.
    """
    if not 1 <= bits <= 20:
        raise ValueError("bits must be in 1 .. 20")
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must be in (0, 1)")
    last = (1 << bits) - 1 if last is None else min(last, (1 << bits) - 1)
    rows = df.select(*keys, value.alias("__v"))
    kind = rows.schema["__v"].dataType
    rows = rows.withColumn("__v", F.col("__v").cast("array<bigint>" if isinstance(kind, T.ArrayType) else "bigint"))
    schema = T.StructType([*rows.schema.fields[: len(keys)], *[T.StructField(c, T.LongType()) for c in ("__part", "node", "n")]])
    parts = rows.mapInArrow(_digest_task(len(keys), bits, epsilon, last), schema)
    return _gather(parts, keys, F.col("__part"), bits, epsilon)


def merge(digests: DataFrame, keys: list[str], bits: int, epsilon: float = 0.01) -> DataFrame:
    """The digests of coarser groups `keys`: node counts added, compressed again. Digests of the columns that are no keys
    are what is put together."""
    finer = [c for c in digests.columns if c not in (*keys, "node", "n")]
    return _gather(digests, keys, F.xxhash64(*finer) if finer else F.lit(0), bits, epsilon)


def _quantiles(n_keys: int, bits: int, percents: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.array(percents, np.int64)
        for batch in batches:
            column, out = batch.column(n_keys), []
            flat, ends = column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            node, count = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, z in zip(np.concatenate(([0], ends[:-1])), ends):
                shift = bits - np.floor(np.log2(node[a:z])).astype(np.int64)
                first = (node[a:z] << shift) - (1 << bits)
                total = int(count[a:z].sum())
                for side in (first, first + (1 << shift) - 1):
                    order = np.argsort(side, kind="stable")
                    run_ = np.cumsum(count[a:z][order])
                    out.append(side[order][np.searchsorted(run_ * 100, want * total)])
                out.append(np.full(len(want), total))
            low, high, n = (np.concatenate(out[i::3]) if out else np.zeros(0, np.int64) for i in range(3))
            rows = np.repeat(np.arange(batch.num_rows), len(want))
            kept = [batch.column(k).take(pa.array(rows)) for k in range(n_keys)]
            pct = np.tile(want, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in (pct, n, low, high)]], names=[*batch.schema.names[:n_keys], "pct", "n", "low", "high"])

    return run


def percentiles(digests: DataFrame, keys: list[str], bits: int, percents: list[int]) -> DataFrame:
    """keys, pct, n, low, high: bounds of each percentile, the smallest value v with at least pct % of values <= v.

    low takes every node's values as its smallest, high as its largest, so low <= true percentile <= high always; at least
    pct % - epsilon of the values are <= low, and at most pct % + epsilon are < high.
    """
    grouped = digests.groupBy(*keys).agg(F.collect_list(F.struct("node", "n")).alias("__digest"))
    schema = T.StructType([*grouped.schema.fields[: len(keys)], *[T.StructField(c, T.LongType()) for c in ("pct", "n", "low", "high")]])
    return grouped.mapInArrow(_quantiles(len(keys), bits, percents), schema)
