"""Long exact spans shared between records, by difference-cover anchors.

A stretch of at least `span` bases that occurs in two records shares all its windows of exactly `span` bases; a base is
shared if some window over it occurs in another record. Instead of all windows, only anchors are compared: the K-base
windows that start at a position whose remainder modulo PERIOD lies in COVER. COVER is a difference cover, so for any two
places there is one shift below PERIOD that brings both onto cover positions, and with K = span - PERIOD + 1 the anchor
still lies inside the window: two equal windows always share an aligned anchor. Equal anchors are then extended to the
whole window by the bases beside them.

Passes, each linear in the bases:

1. records with the same text become one (partial aggregation), are cut at everything but A, C, G, T, packed with two bits
   a base into chunks and written once (chunks are the unit of work and survive lost executors);
2. each chunk sends 32-bit tags of its anchors to hash buckets; buckets report which tags occur twice. The number of
   buckets follows the data, so tags stay as telling at any size; anchors that occur once, nearly all, go no further. A
   chunk sends a tag once, with its number: an anchor that is in every chunk adds no more than one entry a chunk to a bucket;
3. chunks send repeated anchors with the PERIOD - 1 bases on either side; buckets extend: for each of the PERIOD shifts
   they find windows seen in different records. On large data several chunks share the rows that they send to buckets and
   get back (a lot), so that rows stay long however many chunks and buckets there are;
4. chunks mark the shared windows and report maximal runs, which are joined to the records by text.

An anchor that is very frequent is not gathered in one bucket: its occurrences are keyed by the whole window (anchor,
shift, neighbouring bases), each chunk sends a window once, and the windows spread over all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import merge_intervals
from strandlake.session import materialize

PERIOD = 13
#: A perfect difference cover modulo 13: every remainder is a difference of two of these. Fixed values.
COVER = (0, 1, 3, 9)
SIDE = PERIOD - 1
K = 28
SPAN = K + SIDE
#: Bases of a chunk and anchors of a bucket, least and most, and most chunks that travel together: see exchange_sizes().
LEAST_SIZE, MOST_SIZE, MOST_CHUNKS = 1 << 20, 1 << 22, 64
#: Anchors that a row between chunks and buckets should have.
ROW_ANCHORS = 1000
HOT = 50_000

_CODE = np.full(256, 255, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

_CHUNK = "chunk bigint, h1 binary, h2 binary, copies binary, split binary, rec binary, off binary, len binary, codes binary, bases bigint"


def exchange_sizes(bases: int) -> tuple[int, int]:
    """(size, chunks): bases of a chunk and, as many, anchors of a bucket; and how many chunks share the rows to buckets.

    Rows between them have about size * size * chunks / bases anchors each. The sizes grow with the root of the data, and
    beyond MOST_SIZE the number of chunks with the data, so that a row keeps ROW_ANCHORS and rows grow in proportion to the
    bases, up to 1e12 bases; beyond, a task's memory bounds both, and at 1e14 a row has some ten anchors."""
    size = min(max(LEAST_SIZE, math.isqrt(ROW_ANCHORS * bases)), MOST_SIZE)
    return size, min(max(1, round(ROW_ANCHORS * bases / size**2)), MOST_CHUNKS)


def _pieces(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(offset, length) of the runs of A, C, G, T of at least SPAN bases; runs of more than `most` windows are cut into
    pieces that overlap by SPAN - 1 bases, so that every window lies in exactly one."""
    good = np.concatenate(([False], codes < 4, [False]))
    edges = np.flatnonzero(good[1:] != good[:-1])
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for s in range(a, b - SPAN + 1, most):
            out.append((s, min(s + most + SPAN - 1, b) - s))
    return out


def _pack(codes: np.ndarray) -> bytes:
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    four = padded.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)[:n]


def _make_chunks(most: int):
    """Packs distinct texts (h1, h2, copies, seq) into chunk rows of about `most` bases."""
    return lambda batches: _chunk_rows(batches, most)


def _chunk_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    heads: list[tuple[int, int, bool, bool]] = []
    rec: list[int] = []
    off: list[int] = []
    ln: list[int] = []
    body: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal made, size
        ids = (part << 32) | made
        cols = [
            pa.array([ids], pa.int64()),
            *[pa.array([np.array([h[i] for h in heads], np.int64).tobytes()], pa.binary()) for i in (0, 1)],
            *[pa.array([np.array([h[i] for h in heads], np.uint8).tobytes()], pa.binary()) for i in (2, 3)],
            *[pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (rec, off, ln)],
            pa.array([_pack(np.concatenate(body))], pa.binary()),
            pa.array([size], pa.int64()),
        ]
        made += 1
        for x in (heads, rec, off, ln, body):
            x.clear()
        size = 0
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _CHUNK.split(", ")])

    for batch in batches:
        for h1, h2, copies, seq in zip(*[batch.column(i) for i in range(4)]):
            codes = _CODE[np.frombuffer(seq.as_buffer() if hasattr(seq, "as_buffer") else seq.as_py().encode(), np.uint8)]
            pieces = _pieces(codes, most)
            long = len(codes) > most
            head = (h1.as_py(), h2.as_py(), copies.as_py() > 1, long)
            last = -1
            for a, n in pieces:
                if last != made:  # the record's entry in the chunk that is being filled
                    heads.append(head)
                    last = made
                rec.append(len(heads) - 1), off.append(a), ln.append(n), body.append(codes[a : a + n])
                size += n
                if size >= most:
                    yield flush()
    if body:
        yield flush()


class _Chunk:
    """A chunk's pieces, laid end to end, and its anchors in order of place."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.id = row["chunk"]
        self.h1, self.h2, self.copies, self.split = read("h1", np.int64), read("h2", np.int64), read("copies", np.uint8), read("split", np.uint8)
        self.rec, self.off, self.len = read("rec", np.int64), read("off", np.int64), read("len", np.int64)
        n = int(self.len.sum())
        self.codes = _unpack(row["codes"], n)
        self.begin = np.cumsum(self.len) - self.len
        inner = np.arange(n, dtype=np.int32) - np.repeat(self.begin.astype(np.int32), self.len)
        left = np.repeat(self.len.astype(np.int32), self.len) - inner
        self.at = np.flatnonzero(_IN_COVER[inner % PERIOD] & (left >= K))
        self.left = np.minimum(inner[self.at], SIDE).astype(np.int64)
        self.right = np.minimum(left[self.at] - K, SIDE).astype(np.int64)
        self.owner = self.h1[self.rec[np.searchsorted(self.begin, self.at, "right") - 1]]
        padded = np.zeros(n + K + 2 * SIDE, np.uint8)
        padded[SIDE : SIDE + n] = self.codes
        two = padded[:-1] << np.uint8(2) | padded[1:]
        four = two[:-2] << np.uint8(4) | two[2:]
        eight = four[:-4].astype(np.uint16) << np.uint16(8) | four[4:]
        p = self.at + SIDE
        take = lambda start, *parts: self._join(start, parts)
        self.anchor = take(p, (eight, 8), (eight, 8), (eight, 8), (four, 4))
        self.before = take(p - SIDE, (eight, 8), (four, 4))
        self.after = take(p + K, (eight, 8), (four, 4))

    @staticmethod
    def _join(start: np.ndarray, parts: tuple) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for codes, n in parts:
            out = out << np.uint64(2 * n) | codes[start]
            start = start + n
        return out

    def spread(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(self.anchor)
        return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers (the public splitmix64 finalizer)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in ascending order)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(bucket[group[0]]), group


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


# --- pass 2: which anchors occur twice


def _grouped(lots: dict[int, list[tuple]], kinds: list[tuple[str, type]]) -> Iterator[tuple]:
    """(bucket, chunks, counts, one array per kind): what several chunks send to a bucket, laid end to end."""
    for b, parts in lots.items():
        counts = np.array([len(p[1]) for p in parts], np.int64)
        yield b, np.array([p[0] for p in parts], np.int64).tobytes(), counts.tobytes(), *[np.concatenate([p[i + 1] for p in parts]).astype(k, copy=False).tobytes() for i, (_, k) in enumerate(kinds)]


def _send_tags(buckets: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[int, list[tuple]] = {}
        held = None

        def flush() -> pa.RecordBatch:
            out = [(b, held, *rest) for b, *rest in _grouped(lots, [("tags", np.uint32), ("more", np.uint16)])]
            lots.clear()
            return _batch(out, ["bucket", "lot", "chunks", "counts", "tags", "more"], [pa.int32(), pa.int64(), *[pa.binary()] * 4])

        for batch in batches:
            for row in _rows(batch):
                if held is not None and row["chunk"] // together != held:
                    yield flush()
                held = row["chunk"] // together
                chunk = _Chunk(row)
                bucket, tags = chunk.spread(buckets)
                for b, group in _by_bucket(bucket):
                    own, n = np.unique(tags[group], return_counts=True)
                    lots.setdefault(b, []).append((chunk.id, own, np.minimum(n - 1, 65535)))
        if lots:
            yield flush()

    return run


def _find_repeats(hot: int):
    def run(group: pa.Table) -> pa.Table:
        """Per row, for each of its chunks' distinct tags: 0 once in all, 1 repeated, 2 very frequent."""
        rows = group.to_pylist()
        tags = [np.frombuffer(r["tags"], np.uint32) for r in rows]
        more = [np.frombuffer(r["more"], np.uint16) for r in rows]
        _, inverse = np.unique(np.concatenate(tags), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(more).astype(np.int64) + 1)[inverse]
        state = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        cuts = np.cumsum([len(t) for t in tags])[:-1]
        states = [x.tobytes() for x in np.split(state, cuts)]
        return pa.table({"bucket": group["bucket"], "lot": group["lot"], "hot": pa.nulls(len(rows), pa.bool_()), "chunks": group["chunks"], "counts": group["counts"], "data": pa.array(states, pa.binary())})

    return run


class _Replies:
    """What buckets answered to a lot of chunks: by chunk, bucket and kind (None: states, else masks of usual or very
    frequent anchors)."""

    def __init__(self, table: pa.Table):
        self.by: dict[tuple, np.ndarray] = {}
        for r in table.to_pylist():
            data = np.frombuffer(r["data"], np.uint8 if r["hot"] is None else np.uint16)
            ends = np.cumsum(np.frombuffer(r["counts"], np.int64))
            for chunk, part in zip(np.frombuffer(r["chunks"], np.int64).tolist(), np.split(data, ends[:-1])):
                self.by[chunk, r["bucket"], r["hot"]] = part


# --- pass 3: extension to whole windows


def _window_keys(before: np.ndarray, after: np.ndarray, shift: int) -> np.ndarray:
    """The SIDE bases around the anchor that belong to the window which starts `shift` bases before it."""
    low = np.uint64((1 << 2 * shift) - 1)
    return (before & low) << np.uint64(2 * (SIDE - shift)) | after >> np.uint64(2 * shift)


class _Candidates:
    """The repeated anchors of a chunk: classes of equal anchor and surroundings, and windows of very frequent ones."""

    def __init__(self, chunk: _Chunk, replies: _Replies, buckets: int):
        bucket, tags = chunk.spread(buckets)
        state = np.zeros(len(tags), np.uint8)
        for b, group in _by_bucket(bucket):
            state[group] = replies.by[chunk.id, b, None][np.unique(tags[group], return_inverse=True)[1]]
        self.chunk, self.buckets = chunk, buckets
        self.usual, self.hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)

        def classes(owner: np.ndarray, *columns: np.ndarray):
            order = np.lexsort(columns[::-1])
            new = np.zeros(len(order), bool)
            if len(order):
                new[0] = True
                for c in columns:
                    new[1:] |= c[order][1:] != c[order][:-1]
            starts = np.flatnonzero(new)
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            firsts = order[starts]
            low = np.minimum.reduceat(owner[order], starts) if len(order) else owner[:0]
            high = np.maximum.reduceat(owner[order], starts) if len(order) else owner[:0]
            return of, [c[firsts] for c in columns], low, high

        u = self.usual
        room = (chunk.left[u] << 4 | chunk.right[u]).astype(np.uint64)
        sides = chunk.before[u] << np.uint64(32) | chunk.after[u] << np.uint64(8) | room
        self.usual_class, (self.anchor, self.sides), self.low, self.high = classes(chunk.owner[u], chunk.anchor[u], sides)
        h = self.hot
        places, keys = [], []
        for shift in range(PERIOD):
            fits = np.flatnonzero((chunk.left[h] >= shift) & (chunk.right[h] >= SIDE - shift))
            places.append(np.stack([h[fits], np.full(len(fits), shift)]))
            keys.append(np.uint64(shift << 2 * SIDE) | _window_keys(chunk.before[h[fits]], chunk.after[h[fits]], shift))
        self.hot_places = np.concatenate(places, axis=1)
        anchors = chunk.anchor[self.hot_places[0]]
        self.hot_class, (self.hot_anchor, self.hot_key), self.hot_low, self.hot_high = classes(chunk.owner[self.hot_places[0]], anchors, np.concatenate(keys))

    def lots(self) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(bucket, very frequent?, places in the list of classes), always in the same order."""
        usual = ((_mix(self.anchor) >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        for b, group in _by_bucket(usual):
            yield b, False, group
        hot = (_mix(self.hot_anchor ^ _mix(self.hot_key)) % np.uint64(self.buckets)).astype(np.int64)
        for b, group in _by_bucket(hot):
            yield b, True, group


def _send_candidates(buckets: int):
    def run(chunks: pa.Table, flags: pa.Table) -> pa.Table:
        replies, lots = _Replies(flags), {False: {}, True: {}}
        for row in chunks.to_pylist():
            found = _Candidates(_Chunk(row), replies, buckets)
            for b, hot, g in found.lots():
                columns = (found.hot_anchor, found.hot_key, found.hot_low, found.hot_high) if hot else (found.anchor, found.sides, found.low, found.high)
                lots[hot].setdefault(b, []).append((row["chunk"], *[c[g] for c in columns]))
        lot, out = chunks["lot"][0].as_py(), []
        for hot in (False, True):
            for b, held, counts, anchors, sides, low, high in _grouped(lots[hot], [("anchors", np.uint64), ("sides", np.uint64), ("low", np.int64), ("high", np.int64)]):
                first, last = np.frombuffer(low, np.int64), np.frombuffer(high, np.int64)
                wide = np.flatnonzero(first != last)
                out.append((b, lot, hot, held, counts, anchors, sides, low, wide.astype(np.uint32).tobytes(), last[wide].tobytes()))
        names = ["bucket", "lot", "hot", "chunks", "counts", "anchors", "sides", "low", "wide", "high"]
        return pa.Table.from_batches([_batch(out, names, [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 7])])

    return run


def _shared_classes(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """True for the entries whose key (all arrays together) is held by more than one owner."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
    out = np.empty(len(order), bool)
    out[order] = np.repeat(several, np.diff(np.append(starts, len(order))))
    return out


def _extend(group: pa.Table) -> pa.Table:
    """Per row: a 16-bit mask of the shared shifts for usual classes, 0 or 1 for windows of frequent ones."""
    rows = group.to_pylist()
    masks: list[bytes] = [b""] * len(rows)
    for hot in (False, True):
        own = [i for i, r in enumerate(rows) if r["hot"] == hot]
        if not own:
            continue
        parts = {n: [np.frombuffer(rows[i][n], np.int64 if n == "low" else np.uint64) for i in own] for n in ("anchors", "sides", "low")}
        highs = []
        for i, low in zip(own, parts["low"]):
            high = low.copy()
            high[np.frombuffer(rows[i]["wide"], np.uint32)] = np.frombuffer(rows[i]["high"], np.int64)
            highs.append(high)
        anchor, sides, low, high = (np.concatenate(x) for x in (parts["anchors"], parts["sides"], parts["low"], highs))
        mask = np.zeros(len(anchor), np.uint16)
        if hot:
            mask |= _shared_classes([anchor, sides], low, high)
        else:
            several = np.flatnonzero(_shared_classes([anchor], low, high))
            _, rank = np.unique(anchor[several], return_inverse=True)
            s = sides[several]
            before, after = s >> np.uint64(32), s >> np.uint64(8) & np.uint64((1 << 2 * SIDE) - 1)
            left, right = (s >> np.uint64(4) & np.uint64(15)).astype(np.int64), (s & np.uint64(15)).astype(np.int64)
            for shift in range(PERIOD):
                fits = np.flatnonzero((left >= shift) & (right >= SIDE - shift))
                if len(fits):
                    key = rank[fits].astype(np.uint64) << np.uint64(2 * SIDE) | _window_keys(before[fits], after[fits], shift)
                    at = several[fits]
                    mask[at] |= _shared_classes([key], low[at], high[at]).astype(np.uint16) << np.uint16(shift)
        for i, m in zip(own, np.split(mask, np.cumsum([len(p) for p in parts["anchors"]])[:-1])):
            masks[i] = m.tobytes()
    return pa.table({**{c: group[c] for c in ("bucket", "lot", "hot", "chunks", "counts")}, "data": pa.array(masks, pa.binary())})


# --- pass 4: maximal runs


def _mark(buckets: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        replies, out = _Replies(answers), []
        for row in chunks.to_pylist():
            chunk = _Chunk(row)
            found = _Candidates(chunk, replies, buckets)
            usual, hot = np.zeros(len(found.anchor), np.uint16), np.zeros(len(found.hot_anchor), np.uint16)
            for b, is_hot, g in found.lots():
                (hot if is_hot else usual)[g] = replies.by[chunk.id, b, is_hot]
            n = len(chunk.codes)
            step = np.zeros(n + 1, np.int64)
            mine = usual[found.usual_class]
            for shift in range(PERIOD):
                start = chunk.at[found.usual[(mine >> np.uint16(shift) & np.uint16(1)).astype(bool)]] - shift
                np.add.at(step, start, 1), np.add.at(step, start + SPAN, -1)
            place, shift = found.hot_places[:, hot[found.hot_class].astype(bool)]
            np.add.at(step, chunk.at[place] - shift, 1), np.add.at(step, chunk.at[place] - shift + SPAN, -1)
            whole = chunk.copies[chunk.rec].astype(bool)
            np.add.at(step, chunk.begin[whole], 1), np.add.at(step, chunk.begin[whole] + chunk.len[whole], -1)
            covered = np.cumsum(step[:n]) > 0
            first = np.zeros(n, bool)
            first[chunk.begin] = True
            last = np.zeros(n, bool)
            last[chunk.begin + chunk.len - 1] = True
            starts = np.flatnonzero(covered & (first | ~np.concatenate(([False], covered[:-1]))))
            ends = np.flatnonzero(covered & (last | ~np.concatenate((covered[1:], [False])))) + 1
            piece = np.searchsorted(chunk.begin, starts, "right") - 1
            move, rec = chunk.off[piece] - chunk.begin[piece], chunk.rec[piece]
            out.append((chunk.h1[rec], chunk.h2[rec], chunk.split[rec].astype(bool), starts + move, ends + move))
        names = ["h1", "h2", "split", "span_start", "span_end"]
        return pa.table({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(names)})

    return run


def text_key(seq: Column) -> list[Column]:
    """Two independent 64-bit hashes: records with the same pair are taken as equal in text."""
    return [F.xxhash64(seq).alias("h1"), F.xxhash64(F.lit(1), seq).alias("h2")]


def shared_spans(records: DataFrame, hot: int = HOT) -> DataFrame:
    """rec_kind, rec_id, span_start, span_end (0-based, end exclusive): the maximal runs of shared bases of each record.

    records: rec_kind, rec_id (together unique) and seq in upper case; every letter but A, C, G, T, and separators such
    as '#', end a stretch. A base is shared if it lies in a stretch of at least SPAN (40) bases that occurs in a different
    record too; a repeat within one record alone doesn't count; reverse complements are not looked at. Records without
    text, with less than SPAN bases or without anything shared have no row; an empty table gives none. A record may be of
    any length: long ones are cut into overlapping pieces. Records with equal text (a third of all rows, say) are handled
    as one until the last join, whose skewed keys adaptive execution splits.
    """
    spark = records.sparkSession
    keyed = records.where(F.length("seq") >= SPAN).select("rec_kind", "rec_id", "seq", *text_key(F.col("seq")))
    texts = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first("seq").alias("seq"))
    size, together = exchange_sizes(records.agg(F.sum(F.length("seq"))).first()[0] or 0)
    chunks = materialize(texts.select("h1", "h2", "copies", "seq").mapInArrow(_make_chunks(size), _CHUNK), "chunks")
    bases = chunks.agg(F.sum("bases")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(bases * len(COVER) / PERIOD / size))
    reply = "bucket int, lot bigint, hot boolean, chunks binary, counts binary, data binary"

    tags = chunks.mapInArrow(_send_tags(buckets, together), "bucket int, lot bigint, chunks binary, counts binary, tags binary, more binary")
    # A lot's replies are some bits per anchor of its chunks; a lot is what a task takes at a time.
    states = materialize(tags.groupBy("bucket").applyInArrow(_find_repeats(hot), reply), "states")
    lots = chunks.withColumn("lot", F.floor(F.col("chunk") / together).cast("bigint"))
    sent = lots.groupBy("lot").cogroup(states.groupBy("lot")).applyInArrow(
        _send_candidates(buckets), "bucket int, lot bigint, hot boolean, chunks binary, counts binary, anchors binary, sides binary, low binary, wide binary, high binary"
    )
    masks = sent.groupBy("bucket").applyInArrow(_extend, reply)
    spans = lots.groupBy("lot").cogroup(states.unionByName(masks).groupBy("lot")).applyInArrow(_mark(buckets), "h1 bigint, h2 bigint, split boolean, span_start bigint, span_end bigint")
    spans = materialize(spans, "spans")
    cut = spans.where("split").withColumn("last", F.col("span_end") - 1)
    merged = merge_intervals(cut, ["h1", "h2"], "span_start", "last").select("h1", "h2", F.col("period_start").alias("span_start"), (F.col("period_end") + 1).alias("span_end"))
    spans = spans.where("not split").drop("split").unionByName(merged)
    return keyed.select("rec_kind", "rec_id", "h1", "h2").join(spans, ["h1", "h2"]).select("rec_kind", "rec_id", "span_start", "span_end")
