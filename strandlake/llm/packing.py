"""Filling containers of fixed capacity by minimum bin slack.

Each task takes its items in windows. For every container it seeds with the longest remaining item and then finds, by a
subset-sum over a bitset (bit t set: total t can be reached), the multiset of remaining lengths that comes closest to the
free capacity; the counts are read back from the bitsets kept on the way. Items of containers that stay too empty go back
to wait for the next window, so only a task's last containers have much slack. Only (id, size) reaches Python, nothing is
shuffled, and memory is bounded by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 512
#: A container below this fill is opened again with the next window.
GOOD_FILL = 0.985
MAX_SPECS = 1000

_OUT = "spec_id bigint, container_id bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint, container_tokens bigint"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def fill_one(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The lengths, taken at most counts[l] times each, whose sum is the largest at or below room. lengths: descending."""
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for l in lengths:
        if l > room:
            continue
        left, chunk = min(counts[l], room // l), 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((l, chunk, reach))
            reach |= reach << l * chunk & mask
            left -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for l, chunk, before in reversed(steps):
        if not before >> total & 1:
            out += [l] * chunk
            total -= l * chunk
    return out


class _Packer:
    """Packs the items of one capacity. An item is (size, doc_id, piece, first_token)."""

    def __init__(self, spec: int, capacity: int):
        self.spec, self.capacity = spec, capacity
        self.waiting: list[tuple[int, int, int, int]] = []
        self.closed: list[list[tuple[int, int, int, int]]] = []

    def add(self, doc: int, size: int) -> None:
        piece = at = 0
        while size - at > self.capacity:
            self.closed.append([(self.capacity, doc, piece, at)])
            piece, at = piece + 1, at + self.capacity
        if size - at == self.capacity:
            self.closed.append([(self.capacity, doc, piece, at)])
        else:
            self.waiting.append((size - at, doc, piece, at))
            if len(self.waiting) >= WINDOW:
                self.pack(False)

    def pack(self, final: bool) -> None:
        items: dict[int, list] = {}
        for x in sorted(self.waiting, key=lambda item: -item[0]):
            items.setdefault(x[0], []).append(x)
        counts = {l: len(v) for l, v in items.items()}
        lengths = sorted(counts, reverse=True)
        poor: list[tuple[int, list]] = []
        while lengths:
            seed = lengths[0]
            counts[seed] -= 1
            chosen = [seed, *fill_one(counts, lengths, self.capacity - seed)]
            for l in chosen[1:]:
                counts[l] -= 1
            lengths = [l for l in lengths if counts[l] > 0]
            members = [items[l].pop() for l in chosen]
            if final or sum(chosen) >= GOOD_FILL * self.capacity:
                self.closed.append(members)
            else:
                poor.append((sum(chosen), members))
        # The fullest of the poor ones close until at most half a window waits, so every window makes room.
        poor.sort(key=lambda x: x[0])
        self.waiting = []
        for _, members in poor:
            if len(self.waiting) + len(members) <= WINDOW // 2:
                self.waiting += members
            else:
                self.closed.append(members)


def _pack_task(specs: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [_Packer(*s) for s in specs]
        made = TaskContext.get().partitionId() << 36

        def drain() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for p in packers:
                for members in p.closed:
                    total = sum(m[0] for m in members)
                    rows += [(p.spec, made, doc, piece, at, size, total) for size, doc, piece, at in members]
                    made += 1
                p.closed = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_NAMES), names=_NAMES)

        for batch in batches:
            for doc, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in packers:
                    p.add(doc, size)
            yield drain()
        for p in packers:
            p.pack(True)
        yield drain()

    return run


def byte_tokens(text: Column) -> Column:
    """Size in tokens of the public byte-level tokenizer ByT5: one per UTF-8 byte and one end token."""
    return F.octet_length(text).cast("bigint") + 1


def pack_documents(docs: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """spec_id, container_id, doc_id, piece, first_token, tokens, container_tokens: every document in one container of each
    capacity, or, if it is larger than a container, in full containers and a last piece that shares one.

    specs: spec_id, capacity; at most MAX_SPECS rows (checked), as they are given to every task. Null or non-positive
    capacities are left out. Null and blank texts go into no container; null ids are packed like others; repeated rows are
    separate items; empty tables give no rows; other columns are dropped. Containers are never shared between tasks, so at
    most a window of items per task and capacity can be packed loosely.
    """
    rows = specs.select("spec_id", "capacity").where("spec_id is not null and capacity > 0").distinct().orderBy("spec_id").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container sizes")
    items = docs.where(F.col(text).rlike(r"\S")).select(F.col(doc_id).cast("bigint").alias("doc_id"), byte_tokens(F.col(text)).alias("size"))
    return items.mapInArrow(_pack_task([(r["spec_id"], r["capacity"]) for r in rows]), _OUT)
