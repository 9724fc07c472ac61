"""Suffix arrays and what follows from them, for many texts at once.

texts: text_id, s over A, C, G, T, N and the separator '#'. Every text gets an end mark that is smaller than all; the order
of XX
What an index of the transform does is built on blocks of BWT symbols with counts before them: rank at any place, the
mapping from a row to the one of the suffix a position further left (LF), backward search, and positions of rows by walks
along LF to sampled rows, of which all are walked at once by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.ordering import with_rank, with_running_sum, with_running_sums
from strandlake.session import materialize

SYMBOLS = "$ACGTN#"
#: Symbols in one 63-bit key, of three bits each; three keys are made at first.
PER_KEY = 21
FIRST = 3 * PER_KEY
SLICE = 1 << 18
#: The longest text that is ranked and checked as a whole in one task.
WHOLE = 1 << 20

_CODE = np.full(256, 5, np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
_SYMBOL = np.full(128, -1, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every suffix of every text with its first FIRST symbols as numbers, in slices of SLICE suffixes."""
    names = ["text_id", "s_pos", "k1", "k2", "k3", "code", "bwt"]
    for batch in batches:
        for text_id, s in zip(batch.column(0), batch.column(1).to_pylist()):
            codes = np.concatenate(([0], _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)], np.zeros(FIRST + 1, np.uint8)))
            for a in range(0, len(s) + 1, SLICE):
                n = min(SLICE, len(s) + 1 - a)
                part = codes[a + 1 : a + 1 + n + FIRST].astype(np.int64)
                keys = []
                for k in range(3):
                    key = np.zeros(n, np.int64)
                    for j in range(PER_KEY):
                        key = key << 3 | part[k * PER_KEY + j : k * PER_KEY + j + n]
                    keys.append(key)
                columns = [np.arange(a, a + n), *keys, codes[a + 1 : a + 1 + n].astype(np.int32), codes[a : a + n].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.repeat(text_id, n), *map(pa.array, columns)], names=names)


def _starts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, the place of the first row with equal keys, and whether another row has them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    again = ~new
    again[:-1] |= ~new[1:]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)), again


def _whole(ids: list[pa.Scalar], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of the texts' suffix arrays, by prefix doubling over all of them at once."""
    sizes = np.array([len(x) + 1 for x in texts])
    ends = np.cumsum(sizes)
    n, text = int(ends[-1]), np.repeat(np.arange(len(texts)), sizes)
    symbols = np.concatenate([part for x in texts for part in (x, np.zeros(1, np.uint8))])
    place, left = np.arange(n) - (ends - sizes)[text], ends[text] - np.arange(n)
    padded, key = np.concatenate((symbols, np.zeros(PER_KEY, np.uint8))).astype(np.int64), np.zeros(n, np.int64)
    for j in range(PER_KEY):
        key = key << 3 | np.where(j < left, padded[j : j + n], 0)
    order = np.lexsort((key, text))
    first, again = _starts(text[order], key[order])
    rank, width = np.empty(n, np.int64), PER_KEY
    rank[order] = first
    open_ = order[again]
    while len(open_):
        # a suffix that has ended comes before the longer ones
        after = np.where(width < left[open_], rank[np.minimum(open_ + width, n - 1)], -1 - place[open_])
        by = np.lexsort((after, rank[open_]))
        open_, now, after = open_[by], rank[open_[by]], after[by]
        first, again = _starts(now, after)
        rank[open_] = now + first - _starts(now)[0]
        open_, width = open_[again], width * 2
    at = np.empty(n, np.int64)
    at[rank] = np.arange(n)
    last = np.where(place[at] == 0, 0, symbols[at - 1])
    names = ["text_id", "row", "s_pos", "code", "bwt"]
    columns = [pa.array(ids, ids[0].type).take(pa.array(text)), *map(pa.array, (place, place[at], symbols[at].astype(np.int32), last.astype(np.int32)))]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    yield from (whole.slice(a, SLICE) for a in range(0, n, SLICE))


def _whole_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix arrays of texts that fit a task, in bunches of SLICE symbols or one longer text."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for text_id, s in zip(batch.column(0), batch.column(1)):
            codes = _CODE[np.frombuffer(s.as_py().encode("ascii", "replace"), np.uint8)]
            if ids and n + len(codes) > SLICE:
                yield from _whole(ids, texts)
                ids, texts, n = [], [], 0
            ids.append(text_id), texts.append(codes)
            n += len(codes) + 1
    if ids:
        yield from _whole(ids, texts)


def _runs(keys: list[int]):
    """Adds to sorted rows the partition, the place of the first row with equal keys, and whether another row has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, start, held = TaskContext.get().partitionId(), 0, 0, None

        def finish(batch: pa.RecordBatch, first: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
            own = [pa.repeat(pa.scalar(part, pa.int64()), batch.num_rows), pa.array(first), pa.array(again)]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "__part", "__in", "__again"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)  # differs from the row before
            for k in keys:
                c = batch.column(k)
                new[1:] &= ~pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) if batch.num_rows > 1 else True
            new[1:] = ~new[1:]
            if held is not None:
                new[0] = any(batch.column(k)[0] != held[0].column(k)[-1] for k in keys)
            places = np.arange(n, n + batch.num_rows)
            first = np.maximum.accumulate(np.where(new, places, start))
            again = ~new
            again[:-1] |= ~new[1:]
            if held is not None:
                held[2][-1] |= not new[0]
                yield finish(*held)
            held, n, start = (batch, first, again), n + batch.num_rows, int(first[-1])
        if held is not None:
            yield finish(*held)

    return run


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __rank, how many rows have smaller keys (equal rows having the same), and __again, whether another has it.
    One shuffle: rows are numbered where the range sort leaves them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__in", T.LongType()), T.StructField("__again", T.BooleanType())])
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialize(sorted_.mapInArrow(_runs([rows.columns.index(k) for k in keys]), schema), "suffixes")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(before), "__part")  # at most n rows
    return joined.withColumn("__rank", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def suffix_array(texts: DataFrame, whole: int = WHOLE) -> DataFrame:
    """text_id, row, s_pos, code, bwt: row is the place of the suffix at s_pos among its text's suffixes, code its first
    symbol, bwt the symbol before it ('$' for the whole text's suffix).

    Letters other than A, C, G, T count as N. The end mark has the position length(s). Texts that are null have no rows, an empty one its end mark only; text_id
    must be unique; an empty table gives none; other columns are dropped. Texts of at most `whole` symbols are dealt to tasks
    as they are, the suffixes of longer ones one by one.
    """
    kind = texts.schema["text_id"].dataType.simpleString()
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.where("s is not null and text_id is not null").select("text_id", "s")
    short, long = rows.where(F.length("s") <= whole), rows.where(F.length("s") > whole)
    made = short.repartition(n, "text_id").mapInArrow(_whole_arrays, f"text_id {kind}, row bigint, s_pos bigint, code int, bwt int")
    if not long.isEmpty():
        made = made.unionByName(_long_arrays(long))
    symbol = lambda c: F.substring(F.lit(SYMBOLS), F.col(c) + 1, F.lit(1)).alias(c)
    return made.select("text_id", "row", "s_pos", symbol("code"), symbol("bwt"))


def _long_arrays(texts: DataFrame) -> DataFrame:
    """The same with symbols as numbers, for texts (text_id, s) of any length."""
    kind = texts.schema["text_id"].dataType.simpleString()
    rows = texts.mapInArrow(_first_keys, f"text_id {kind}, s_pos bigint, k1 bigint, k2 bigint, k3 bigint, code int, bwt int")
    state = _ranked(rows, ["text_id", "k1", "k2", "k3"]).drop("k1", "k2", "k3")
    done, open_, width = state.where("not __again"), state.where("__again"), FIRST
    while not open_.isEmpty():
        # of all ranks only those that open suffixes need are fetched, so that a small rest moves nothing else
        wanted = open_.select("text_id", (F.col("s_pos") + width).alias("s_pos")).distinct()
        after = done.select("text_id", "s_pos", "__rank").unionByName(open_.select("text_id", "s_pos", "__rank")).join(wanted, ["text_id", "s_pos"])
        after = after.select("text_id", (F.col("s_pos") - width).alias("s_pos"), F.col("__rank").alias("__next"))
        pairs = open_.withColumnRenamed("__rank", "__now").drop("__again").join(after, ["text_id", "s_pos"], "left")
        fresh = _ranked(pairs.withColumn("__next", F.coalesce("__next", F.lit(-1))), ["__now", "__next"])
        least = fresh.groupBy("__now").agg(F.min("__rank").alias("__least"))
        moved = fresh.join(least, "__now").withColumn("__rank", F.col("__now") + F.col("__rank") - F.col("__least"))
        state = materialize(moved.select(*state.columns), "ranks")
        done, open_, width = done.unionByName(state.where("not __again")), state.where("__again"), width * 2
    first = done.groupBy("text_id").agg(F.min("__rank").alias("__first"))
    return done.join(first, "text_id").select("text_id", (F.col("__rank") - F.col("__first")).alias("row"), "s_pos", "code", "bwt")


def c_array(texts: DataFrame) -> DataFrame:
    """text_id, code, c: for each symbol the number of smaller ones in the text, the end mark included. Counts only."""
    counted = texts.where("s is not null").select(
        "text_id", *[F.lit(1).cast("bigint").alias("k0") if x == "$" else F.regexp_count("s", F.lit(x)).cast("bigint").alias(f"k{i}") for i, x in enumerate(SYMBOLS)]
    )
    sums = [F.struct(F.lit(x).alias("code"), sum((F.col(f"k{j}") for j in range(i)), F.lit(0).cast("bigint")).alias("c")) for i, x in enumerate(SYMBOLS)]
    return counted.select("text_id", F.inline(F.array(*sums)))


def occ_checkpoints(sa: DataFrame, step: int = 64) -> DataFrame:
    """text_id, checkpoint, code, n: how often each symbol stands in the BWT before row checkpoint * step."""
    per = sa.groupBy("text_id", F.floor(F.col("row") / step).cast("bigint").alias("checkpoint")).pivot("bwt", list(SYMBOLS)).count().na.fill(0)
    each = F.array(*[F.struct(F.lit(x).alias("code"), F.col(f"`{x}`").alias("count")) for x in SYMBOLS])
    rows = per.select("text_id", "checkpoint", F.inline(each)).withColumn("__line", F.struct("text_id", "code"))
    return with_running_sum(rows, "__line", "checkpoint", "count", "n").select("text_id", "checkpoint", "code", "n")


def bwt_blocks(bwt: DataFrame, step: int = 64) -> DataFrame:
    """text_id, block, symbols, before: the transform (text_id, row, bwt) in strings of `step` symbols, and how often each
    of SYMBOLS stands in earlier blocks. Written once, as it is what the index is read from."""
    rows = bwt.select("text_id", F.floor(F.col("row") / step).cast("bigint").alias("block"), F.struct("row", "bwt").alias("x"))
    blocks = rows.groupBy("text_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bwt"]), "").alias("symbols"))
    counted = blocks.select("*", *[_times(F.col("symbols"), F.lit(x)).alias(f"__n{i}") for i, x in enumerate(SYMBOLS)])
    summed = with_running_sums(counted, "text_id", "block", {f"__s{i}": f"__n{i}" for i in range(len(SYMBOLS))})
    return materialize(summed.select("text_id", "block", "symbols", F.array(*[F.col(f"__s{i}") for i in range(len(SYMBOLS))]).alias("before")), "blocks")


def _times(text: Column, symbol: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, symbol, F.lit("")))).cast("bigint")


def _code(symbol: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), symbol) - 1


def symbol_starts(blocks: DataFrame) -> DataFrame:
    """text_id, c, rows: from the blocks, an array of the first row of every symbol's suffixes, and the number of rows."""
    last = blocks.groupBy("text_id").agg(F.max_by(F.struct("symbols", "before"), "block").alias("x"), F.sum(F.length("symbols")).alias("rows"))
    total = [F.get("x.before", F.lit(i)) + _times(F.col("x.symbols"), F.lit(s)) for i, s in enumerate(SYMBOLS)]
    counts = last.select("text_id", "rows", *[t.alias(f"__t{i}") for i, t in enumerate(total)])
    return counts.select("text_id", F.array(*[sum((F.col(f"__t{j}") for j in range(i)), F.lit(0).cast("bigint")) for i in range(len(SYMBOLS))]).alias("c"), "rows")


def rank_at(blocks: DataFrame, places: DataFrame, symbol: str, place: str, name: str, step: int = 64) -> DataFrame:
    """places (text_id, symbol, place) with `name`: how often the symbol stands in the transform before row `place`, any
    from 0 to the number of rows. Places beyond, and of texts that aren't there, are dropped."""
    block = F.when(F.col(place) == 0, 0).otherwise(F.floor((F.col(place) - 1) / step)).cast("bigint")
    right = blocks.select(F.col("text_id").alias("__t"), F.col("block").alias("__b"), "symbols", "before")
    joined = places.withColumn("__block", block).join(right, (F.col("text_id") == F.col("__t")) & (F.col("__block") == F.col("__b")))
    inside = F.col("symbols").substr(F.lit(1), (F.col(place) - F.col("__block") * step).cast("int"))
    joined = joined.where(F.col(place) - F.col("__block") * step <= F.length("symbols"))
    return joined.select(*places.columns, (F.get("before", _code(F.col(symbol))) + _times(inside, F.col(symbol))).alias(name))


def backward_search(blocks: DataFrame, pattern: str, step: int = 64) -> DataFrame:
    """text_id, lo, hi: the rows of the suffixes that start with the pattern, half-open; (0, 0) where there are none. The
    range is narrowed from the pattern's last symbol on, by the symbols' first rows and two ranks a symbol; a step handles
    all texts, and of the blocks only those that hold a bound are joined."""
    starts = materialize(symbol_starts(blocks), "starts")
    zero = F.lit(0).cast("bigint")
    state = starts.select("text_id", "c", zero.alias("lo"), F.col("rows").alias("hi"))
    for x in reversed(pattern):
        for bound in ("lo", "hi"):
            state = rank_at(blocks, state.withColumn("__x", F.lit(x)), "__x", bound, "__rank", step).withColumn(bound, F.get("c", _code(F.lit(x))) + F.col("__rank")).drop("__rank", "__x")
        state = materialize(state, "range")
    some = F.col("lo") < F.col("hi")
    return state.select("text_id", *[F.when(some, F.col(b)).otherwise(zero).alias(b) for b in ("lo", "hi")])


def lf_mapping(blocks: DataFrame, step: int = 64) -> DataFrame:
    """text_id, row, symbol, lf: for every row its symbol and the row of the suffix one position to the left, from the
    symbols' first rows and their ranks inside the block; no row is joined with another."""
    rows = blocks.join(symbol_starts(blocks), "text_id").select("text_id", "block", "symbols", "before", "c", F.posexplode(F.split("symbols", "")).alias("i", "symbol"))
    rank = F.get("before", _code(F.col("symbol"))) + _times(F.col("symbols").substr(F.lit(1), F.col("i")), F.col("symbol"))
    return rows.where("symbol <> ''").select("text_id", (F.col("block") * step + F.col("i")).alias("row"), "symbol", (F.get("c", _code(F.col("symbol"))) + rank).alias("lf"))


def walked_positions(blocks: DataFrame, known: DataFrame, step: int = 64) -> DataFrame:
    """text_id, row, s_pos, symbol of every row, from the transform and the rows whose position is known (text_id, row,
    s_pos: samples of the suffix array, of its inverse, or both).

    A row's position is that of the first known row on its walk along LF, plus the number of steps. All walks are taken at
    once: each round doubles the steps of those that haven't arrived. The whole text's suffix (symbol '$', position 0) is
    known without a sample, so every walk arrives.
    """
    lf = materialize(lf_mapping(blocks, step), "lf")
    zero = F.lit(0).cast("bigint")
    sure = known.select("text_id", "row", "s_pos").unionByName(lf.where("symbol = '$'").select("text_id", "row", zero.alias("s_pos"))).groupBy("text_id", "row").agg(F.min("s_pos").alias("s_pos"))
    sure = materialize(sure, "known")
    ways = lf.select("text_id", "row", F.col("lf").alias("to"), F.lit(1).cast("bigint").alias("n")).join(sure.select("text_id", "row"), ["text_id", "row"], "left_anti")
    here = sure.select("text_id", F.col("row").alias("to"), F.col("s_pos").alias("__at"))
    arrived = sure
    longest = blocks.agg(F.max("block")).first()[0] or 0
    # no walk has more steps than its text has rows; a damaged transform may lead in circles, whose rows get no position
    for _ in range(((longest + 1) * step).bit_length() + 1):
        # the ways that end on a known row are done; the rest go on by the ways that begin where they end
        ends = materialize(ways.join(here, ["text_id", "to"], "left"), "ways")
        arrived = arrived.unionByName(ends.where("__at is not null").select("text_id", "row", (F.col("__at") + F.col("n")).alias("s_pos")))
        rest = ends.where("__at is null").drop("__at")
        if rest.isEmpty():
            break
        # where a way ends on a row that has arrived meanwhile, its known place ends it
        onward = ends.select("text_id", F.col("row").alias("to"), F.col("to").alias("__to"), F.col("n").alias("__n"))
        ways = rest.join(onward, ["text_id", "to"]).select("text_id", "row", F.col("__to").alias("to"), (F.col("n") + F.col("__n")).alias("n"))
        here = here.unionByName(ends.where("__at is not null").select("text_id", F.col("row").alias("to"), (F.col("__at") + F.col("n")).alias("__at")))
    return arrived.join(lf.select("text_id", "row", "symbol"), ["text_id", "row"])


def locate_rows(blocks: DataFrame, known: DataFrame, pattern: str, step: int = 64) -> DataFrame:
    """text_id, s_pos: the places of the pattern in every text, by backward search and walks to known rows."""
    found = backward_search(blocks, pattern, step).where("lo < hi")
    places = walked_positions(blocks, known, step)
    return places.join(found, "text_id").where("row >= lo and row < hi").select("text_id", "s_pos")


def bwt_runs(sa: DataFrame) -> DataFrame:
    """text_id, runs, length, ratio: runs of equal symbols in the BWT. A row is compared with the one before it by a join
    on row, so no text is sorted in one task."""
    after = sa.select("text_id", (F.col("row") + 1).alias("row"), F.col("bwt").alias("__last"))
    joined = sa.select("text_id", "row", "bwt").join(after, ["text_id", "row"], "left")
    new = F.when(F.col("__last").isNull() | (F.col("bwt") != F.col("__last")), 1).otherwise(0)
    counted = joined.groupBy("text_id").agg(F.sum(new).alias("runs"), (F.count(F.lit(1)) - 1).alias("length"))
    return counted.withColumn("ratio", F.col("length") / F.col("runs"))


def sa_samples(sa: DataFrame, step: int) -> DataFrame:
    """text_id, k, s_pos of every step-th row."""
    return sa.where(F.col("row") % step == 0).select("text_id", (F.col("row") / step).cast("bigint").alias("k"), "s_pos")


def isa_samples(sa: DataFrame, step: int) -> DataFrame:
    """text_id, k, row of every step-th text position."""
    return sa.where(F.col("s_pos") % step == 0).select("text_id", (F.col("s_pos") / step).cast("bigint").alias("k"), "row")


def range_count(samples: DataFrame, lo: int, hi: int, first: int, last: int, step: int = 1) -> DataFrame:
    """text_id, n: samples with index in [lo, hi) and a value in [first, last]; bounds are cut to multiples of step, so
    with step > 1 the count may be too large and serves for pruning only."""
    value = F.floor(F.col("s_pos") / step)
    return samples.where((F.col("k") >= lo) & (F.col("k") < hi) & (value >= first // step) & (value <= last // step)).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


def text_from_bwt(blocks: DataFrame, known: DataFrame, step: int = 64) -> DataFrame:
    """text_id, read_idx, seq: the reads of each text, put together from the transform and some known rows alone. A read's
    symbols are gathered per read, never per text."""
    walked = materialize(walked_positions(blocks, known, step), "walked")
    symbols = walked.where("symbol <> '$'").select("text_id", (F.col("s_pos") - 1).alias("s_pos"), "symbol")
    marks = symbols.where("symbol = '#'").select("text_id", "s_pos").unionByName(walked.where("row = 0").select("text_id", "s_pos"))
    ranked = with_rank(marks, ["text_id", "s_pos"], "__k")
    last = ranked.select("text_id", (F.col("__k") + 1).alias("__k"), (F.col("s_pos") + 1).alias("__last"))
    first = ranked.groupBy("text_id").agg(F.min("__k").alias("__first"))
    reads = ranked.join(last, ["text_id", "__k"], "left").join(first, "text_id")
    reads = reads.select("text_id", (F.col("__k") - F.col("__first") + 1).alias("read_idx"), F.coalesce("__last", F.lit(0)).alias("begin"), F.col("s_pos").alias("end"))
    width = 4096
    cells = reads.select("*", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))).alias("bin"))
    joined = symbols.where("symbol <> '#'").withColumn("bin", F.floor(F.col("s_pos") / width)).join(cells, ["text_id", "bin"]).where("s_pos >= begin and s_pos < end")
    put = joined.groupBy("text_id", "read_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_pos", "symbol"))), lambda x: x["symbol"]), "").alias("seq"))
    return reads.select("text_id", "read_idx").join(put, ["text_id", "read_idx"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one text as one row of lists: a text's rows lie together, so few rows are shuffled."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0)
            new = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), c) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cuts[:-1])), *lists], names=batch.schema.names)


CHECKS = ("sa_permutation", "bwt_symbols", "lf", "search", "locate")


def _bad(s: str, want: int, row: np.ndarray, place: np.ndarray, bwt: np.ndarray, pattern: str, step: int) -> list[int] | None:
    """The figures of CHECKS for one text, given its array in any order, bwt as ASCII; None where rows aren't 0 to len(s),
    each once, or a position or symbol can't be."""
    size = len(s) + 1
    code = _SYMBOL[bwt]
    if len(row) != size or row.min() < 0 or row.max() >= size or place.min() < 0 or place.max() >= size or code.min() < 0 or np.bincount(row, minlength=size).max() > 1:
        return None
    at, symbol, code = (x[np.argsort(row)] for x in (place, bwt, code))
    told = np.concatenate(([ord("$")], np.frombuffer(s.encode("ascii", "replace"), np.uint8)))[at] != symbol
    lf = np.empty(size, np.int64)
    lf[np.argsort(code, kind="stable")] = np.arange(size)
    starts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(SYMBOLS)))))
    lo, hi = 0, size
    for x in reversed(pattern):
        if x not in SYMBOLS:
            lo = hi = 0
            break
        c = SYMBOLS.index(x)
        lo, hi = (int(starts[c] + np.count_nonzero(code[:bound] == c)) for bound in (lo, hi))
    # walks, all at once by doubling; a known row leads to itself
    found = np.full(size, -1)
    found[::step] = at[::step]
    found[code == 0] = 0
    to, n = np.where(found < 0, lf, np.arange(size)), (found < 0).astype(np.int64)
    for _ in range(size.bit_length()):
        if (found[to] >= 0).all():
            break
        to, n = to[to], n + n[to]
    walked = np.where(found[to] < 0, -1, found[to] + n)
    twice = np.bincount(at, minlength=size).max() > 1
    return [int(x) for x in (twice, told.sum(), (at[lf] != (at - 1) % size).sum(), max(hi - lo, 0) != want, (walked != at).sum())]


def _checked(pattern: str, step: int):
    def check(texts: pa.Table, rows: pa.Table) -> pa.Table:
        row, place, bwt = (pc.list_flatten(rows.column(c)).combine_chunks() for c in ("row", "s_pos", "bwt"))
        bad = None
        if texts.num_rows == 1 and not (row.null_count or place.null_count or bwt.null_count):
            bad = _bad(texts.column("s")[0].as_py(), texts.column("want")[0].as_py(), *(x.to_numpy(zero_copy_only=False) for x in (row, place, bwt)), pattern, step)
        return pa.table([texts.column("text_id").slice(0, 1), *(pa.array([x], pa.int64()) for x in bad or [None] * len(CHECKS))], names=["text_id", *CHECKS])

    return check


def invariants(texts: DataFrame, sa: DataFrame, pattern: str, step: int = 16, whole: int = WHOLE) -> DataFrame:
    """check, bad of a suffix array with its transform (text_id, row, s_pos, code, bwt): sa_permutation, texts with rows or
    positions that are missing or stand twice; bwt_symbols, rows whose symbol isn't the text's; lf, rows that don't lead one
    position to the left; search, texts where backward search finds another number of places than the text holds; locate,
    rows whose walk to a sample gives another position than the array.

    A text of at most `whole` symbols that has as many rows as it should is checked inside a task. Longer ones, and those
    where rows are missing, stand twice or hold what can't be, are checked by joins.
    """
    kind = texts.schema["text_id"].dataType.simpleString()
    sizes = texts.where("s is not null").select("text_id", (F.length("s") + 1).cast("bigint").alias("size"))
    both = materialize(sizes.join(sa.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")), "text_id", "full_outer"), "sizes")
    fit = both.where((F.col("n") == F.col("size")) & (F.col("size") <= whole + 1)).select("text_id").distinct()
    # what isn't a row or position of such a text, or no symbol, becomes null
    cell = lambda c: F.when(F.col(c).between(0, whole), F.col(c)).cast("int").alias(c)
    letter = F.when((F.length("bwt") == 1) & F.ascii("bwt").between(1, 127), F.ascii("bwt")).cast("tinyint").alias("bwt")
    packed = sa.select("text_id", cell("row"), cell("s_pos"), letter).mapInArrow(_packed, f"text_id {kind}, row array<int>, s_pos array<int>, bwt array<tinyint>")
    held = texts.where("s is not null").select("text_id", "s", F.regexp_count("s", F.lit(f"(?={pattern})")).cast("bigint").alias("want"))
    pairs = held.join(fit, "text_id", "left_semi").groupBy("text_id").cogroup(packed.join(fit, "text_id", "left_semi").groupBy("text_id"))
    done = materialize(pairs.applyInArrow(_checked(pattern, step), ", ".join([f"text_id {kind}", *[f"{c} bigint" for c in CHECKS]])), "checked").where(F.col(CHECKS[0]).isNotNull())
    sums = done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CHECKS])
    out = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("bad")) for c in CHECKS])))
    ids = done.select("text_id")
    if both.join(ids, "text_id", "left_anti").isEmpty():
        return out
    rest = _joined_invariants(texts.join(ids, "text_id", "left_anti"), materialize(sa.join(ids, "text_id", "left_anti"), "suffixes"), pattern, step)
    return out.join(rest.withColumnRenamed("bad", "__more"), "check").select("check", (F.col("bad") + F.col("__more")).alias("bad"))


def _joined_invariants(texts: DataFrame, sa: DataFrame, pattern: str, step: int) -> DataFrame:
    """The same for texts of any length and arrays with any damage."""
    zero = F.lit(0).cast("bigint")
    size = texts.where("s is not null").select("text_id", (F.length("s") + 1).cast("bigint").alias("size"))
    per = sa.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("rows"), F.count_distinct("s_pos").alias("places"), F.max("row").alias("top"), F.max("s_pos").alias("far"))
    wrong = size.join(per, "text_id", "left").where(~(F.col("n").eqNullSafe(F.col("size")) & F.col("rows").eqNullSafe(F.col("size")) & F.col("places").eqNullSafe(F.col("size")) & (F.col("top") == F.col("size") - 1) & (F.col("far") == F.col("size") - 1)))
    symbols = texts.where("s is not null").select("text_id", F.posexplode(F.split("s", "")).alias("i", "symbol")).where("symbol <> ''").select("text_id", (F.col("i") + 1).cast("bigint").alias("s_pos"), "symbol")
    told = sa.join(symbols, ["text_id", "s_pos"], "left").where(F.col("bwt") != F.coalesce("symbol", F.lit("$")))
    blocks = bwt_blocks(sa, step)
    at = sa.select("text_id", "row", "s_pos")
    led = lf_mapping(blocks, step).join(at, ["text_id", "row"], "left").join(at.select("text_id", F.col("row").alias("lf"), F.col("s_pos").alias("__to")), ["text_id", "lf"], "left").join(size, "text_id")
    led = led.where(~F.col("__to").eqNullSafe(F.pmod(F.col("s_pos") - 1, F.col("size"))))
    held = texts.where("s is not null").select("text_id", F.regexp_count("s", F.lit(f"(?={pattern})")).cast("bigint").alias("want"))
    found = backward_search(blocks, pattern, step)
    missed = held.join(found, "text_id", "left").where(~F.col("want").eqNullSafe(F.coalesce(F.col("hi") - F.col("lo"), zero)))
    known = sa_samples(sa, step).select("text_id", (F.col("k") * step).alias("row"), "s_pos")
    walked = walked_positions(blocks, known, step).select("text_id", "row", F.col("s_pos").alias("__walked"))
    strayed = at.join(walked, ["text_id", "row"], "left").where(~F.col("__walked").eqNullSafe(F.col("s_pos")))
    out = None
    for name, rows in (("sa_permutation", wrong), ("bwt_symbols", told), ("lf", led), ("search", missed), ("locate", strayed)):
        one = rows.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out
