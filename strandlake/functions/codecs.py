"""Byte codecs: variable-length integers, move-to-front, runs, an adaptive arithmetic coder, record metadata.

Storage itself is Parquet with zstd; these serve parity. Work is cut into blocks of rows, results are those of whole columns.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
_OPS = "MIDNSHP=X"


def put_varint(value: int, out: bytearray) -> None:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


def mtf(symbols: list[int], size: int = 6, recent: list[int] | None = None) -> list[int]:
    """Each symbol's place in the list of recent symbols, which it then heads. recent: the list to begin with."""
    recent, out = list(range(size)) if recent is None else list(recent), []
    for s in symbols:
        i = recent.index(s)
        out.append(i)
        recent.insert(0, recent.pop(i))
    return out


def unmtf(places: list[int], size: int = 6) -> list[int]:
    recent, out = list(range(size)), []
    for i in places:
        s = recent.pop(i)
        out.append(s)
        recent.insert(0, s)
    return out


def rle(symbols: list[int]) -> bytes:
    """(symbol, run length as varint) pairs."""
    out, i = bytearray(), 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        out.append(symbols[i])
        put_varint(j - i, out)
        i = j
    return bytes(out)


def unrle(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        symbol = data[at]
        n, at = get_varint(data, at + 1)
        out += [symbol] * n
    return out


class _Frequencies:
    """Counts of byte values that adapt and are halved before they grow out of the coder's range."""

    def __init__(self) -> None:
        self.n, self.total = [1] * 256, 256

    def span(self, symbol: int) -> tuple[int, int]:
        low = sum(self.n[:symbol])
        return low, low + self.n[symbol]

    def find(self, at: int) -> int:
        run = 0
        for s, n in enumerate(self.n):
            run += n
            if at < run:
                return s
        raise ValueError("damaged data")

    def add(self, symbol: int) -> None:
        self.n[symbol] += 32
        self.total += 32
        if self.total >= 1 << 14:
            self.n = [(x + 1) // 2 for x in self.n]
            self.total = sum(self.n)


def arithmetic_encode(data: bytes) -> bytes:
    """Adaptive order-0 coding into one exact interval: the length, then the bytes of a number inside the interval."""
    low, width, model, digits = 0, 1 << 32, _Frequencies(), bytearray()

    def carry() -> None:
        i = len(digits) - 1
        while digits[i] == 255:
            digits[i] = 0
            i -= 1
        digits[i] += 1

    for b in data:
        a, z = model.span(b)
        step = width // model.total
        low, width = low + step * a, step * (z - a)
        if low >> 32:
            low &= 0xFFFFFFFF
            carry()
        while width < 1 << 24:
            digits.append(low >> 24)
            low, width = low << 8 & 0xFFFFFFFF, width << 8
        model.add(b)
    out = bytearray()
    put_varint(len(data), out)
    return bytes(out + digits + low.to_bytes(4, "big"))


def arithmetic_decode(data: bytes) -> bytes:
    n, at = get_varint(data, 0)
    code, width, model, out = int.from_bytes(data[at : at + 4], "big"), 1 << 32, _Frequencies(), bytearray()
    at += 4
    for _ in range(n):
        step = width // model.total
        b = model.find(min(code // step, model.total - 1))
        a, z = model.span(b)
        code, width = code - step * a, step * (z - a)
        while width < 1 << 24:
            code = (code << 8 | (data[at] if at < len(data) else 0)) & 0xFFFFFFFFFF
            width, at = width << 8, at + 1
        model.add(b)
        out.append(b)
    return bytes(out)


def pack_text(symbols: list[int]) -> bytes:
    """A block of transformed text: move-to-front, runs, arithmetic coding, behind the number of symbols and of run bytes."""
    runs = rle(mtf(symbols, 7))
    return struct.pack("<QQ", len(symbols), len(runs)) + arithmetic_encode(runs)


def unpack_text(data: bytes) -> list[int]:
    n, _ = struct.unpack_from("<QQ", data)
    out = unmtf(unrle(arithmetic_decode(data[16:])), 7)
    if len(out) != n:
        raise ValueError("damaged data")
    return out


def pack_meta(flag: int, cigar: str, aux: bytes | None) -> bytes:
    """Flag (16 bits), number of operations, (length << 4 | operation) as varints, then the aux bytes."""
    ops = re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")
    out = bytearray(struct.pack("<H", flag))
    put_varint(len(ops), out)
    for n, op in ops:
        put_varint(int(n) << 4 | _OPS.index(op), out)
    return bytes(out) + (aux or b"")


def unpack_meta(data: bytes) -> tuple[int, str, bytes]:
    (flag,) = struct.unpack_from("<H", data)
    n, at = get_varint(data, 2)
    cigar = ""
    for _ in range(n):
        v, at = get_varint(data, at)
        cigar += f"{v >> 4}{_OPS[v & 15]}"
    return flag, cigar, data[at:]


def pack_meta_fixed(flag: int, cigar: str, aux: bytes | None) -> bytes:
    """The same with fixed widths: flag and number of operations in 32 bits, operation in 8 and length in 32, length of aux
    in 32, aux. Made to be compressed as a whole afterwards."""
    ops = re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")
    out = bytearray(struct.pack("<II", flag, len(ops)))
    for n, op in ops:
        out += struct.pack("<BI", _OPS.index(op), int(n))
    return bytes(out) + struct.pack("<I", len(aux or b"")) + (aux or b"")


def unpack_meta_fixed(data: bytes) -> tuple[int, str, bytes]:
    flag, n = struct.unpack_from("<II", data)
    ops = [struct.unpack_from("<BI", data, 8 + 5 * i) for i in range(n)]
    at = 8 + 5 * n
    (size,) = struct.unpack_from("<I", data, at)
    if len(data) != at + 4 + size:
        raise ValueError("damaged data")
    return flag, "".join(f"{length}{_OPS[op]}" for op, length in ops), data[at + 4 :]


_META = {"TYPED_SPLIT": (pack_meta, unpack_meta), "ZSTD_FALLBACK": (pack_meta_fixed, unpack_meta_fixed)}


def meta_bytes(flag: Column, cigar: Column, aux: Column, codec: str = "TYPED_SPLIT") -> Column:
    """Packed metadata of a record; '*' and null CIGARs pack as no operations, a null flag as 0."""
    pack = _META[codec][0]

    def run(flags: pd.Series, cigars: pd.Series, auxes: pd.Series) -> pd.Series:
        return pd.Series([pack(0 if f is None or f != f else int(f), c, a) for f, c, a in zip(flags, cigars, auxes)])

    return F.pandas_udf(run, "binary")(flag, cigar, aux)


def meta_fields(packed: Column, codec: str = "TYPED_SPLIT") -> Column:
    """struct<flag, cigar, aux> of packed metadata; no operations give an empty CIGAR, no aux empty bytes."""
    unpack = _META[codec][1]

    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpack(d) for d in data], columns=["flag", "cigar", "aux"])

    return F.pandas_udf(run, "flag bigint, cigar string, aux binary")(packed)


def _blocks(symbols: DataFrame, keys: list[str], order: str, symbol: str, size: int) -> DataFrame:
    return symbols.select(*keys, F.col(order).cast("bigint").alias("__o"), F.col(symbol).alias("__s"), F.floor(F.col(order) / size).cast("bigint").alias("block"))


def mtf_blocks(symbols: DataFrame, keys: list[str], order: str, symbol: str, alphabet: str = "ACGTN#", size: int = BLOCK_ROWS) -> DataFrame:
    """keys, block, n, places: move-to-front of each key's whole column in order, cut into blocks of `size` rows only to
    spread the work; symbols outside the alphabet are left out.

    The list of recent symbols that a block starts with is the order of the symbols' last places in earlier blocks (those
    that haven't occurred keep the alphabet's order behind them), so it needs one row per block, not the blocks before.
    """
    rank = F.create_map(*[F.lit(x) for c, i in zip(alphabet, range(len(alphabet))) for x in (c, i)])
    rows = _blocks(symbols, keys, order, symbol, size).where(F.col("__s").isin(*alphabet))
    last = [F.max(F.when(F.col("__s") == c, F.col("__o"))).alias(f"__l{i}") for i, c in enumerate(alphabet)]
    per = rows.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", rank[F.col("__s")].alias("c")))), lambda x: x["c"]).alias("codes"), *last)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    recent = F.array(*[F.struct(F.coalesce(F.max(f"__l{i}").over(earlier), F.lit(-1 - i)).alias("at"), F.lit(i).alias("c")) for i in range(len(alphabet))])
    start = F.transform(F.reverse(F.array_sort(recent)), lambda x: x["c"])

    def run(recents: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([mtf(list(c), len(r), list(r)) for r, c in zip(recents, codes)])

    placed = per.withColumn("__start", start)
    return placed.select(*keys, "block", F.size("codes").cast("bigint").alias("n"), F.pandas_udf(run, "array<bigint>")("__start", "codes").alias("places"))


def run_lengths(symbols: DataFrame, keys: list[str], order: str, symbol: str, size: int = BLOCK_ROWS) -> DataFrame:
    """keys, run, symbol, n: the maximal runs of equal symbols (nulls are equal) of each key's whole column in order, run
    counting from 0. Runs are counted inside blocks of `size` rows; a run that goes on over a block's end is put together
    by a table with one row per block."""
    rows = _blocks(symbols, keys, order, symbol, size)
    place = Window.partitionBy(*keys, "block").orderBy("__o")
    new = F.when(F.row_number().over(place) == 1, 0).when(F.lag("__s").over(place).eqNullSafe(F.col("__s")), 0).otherwise(1)
    inside = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(place))
    parts = inside.groupBy(*keys, "block", "__run", "__s").agg(F.count(F.lit(1)).alias("n"))
    ends = parts.groupBy(*keys, "block").agg(F.max("__run").alias("__more"), F.min_by(F.struct("__s"), "__run").alias("__head"), F.max_by(F.struct("__s"), "__run").alias("__tail"))
    line = Window.partitionBy(*keys).orderBy("block")
    fresh = F.when(F.lag("__tail").over(line).isNull(), 0).when(F.lag("__tail").over(line).eqNullSafe(F.col("__head")), 0).otherwise(1)
    ends = ends.withColumn("__fresh", fresh).withColumn("__base", F.sum(F.col("__fresh")).over(line) + F.coalesce(F.sum("__more").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = parts.join(ends.select(*keys, "block", "__base"), [*keys, "block"])
    whole = whole.groupBy(*keys, (F.col("__base") + F.col("__run")).alias("run"), F.col("__s").alias("symbol")).agg(F.sum("n").alias("n"))
    return whole.select(*keys, "run", "symbol", "n")


def packed_blocks(symbols: DataFrame, keys: list[str], order: str, symbol: str, alphabet: str = "$ACGTN#", size: int = BLOCK_ROWS) -> DataFrame:
    """keys, block, n, packed: each block of a transformed text as bytes (move-to-front, runs, arithmetic coding). Blocks
    are packed on their own, so that any can be read alone."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i)])
    rows = _blocks(symbols, keys, order, symbol, size).where(F.col("__s").isin(*alphabet))
    per = rows.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", rank[F.col("__s")].alias("c")))), lambda x: x["c"]).alias("codes"))
    pack = F.pandas_udf(lambda codes: pd.Series([pack_text(list(c)) for c in codes]), "binary")
    return per.select(*keys, "block", F.size("codes").cast("bigint").alias("n"), pack("codes").alias("packed"))


def unpacked_blocks(packed: DataFrame, keys: list[str], alphabet: str = "$ACGTN#") -> DataFrame:
    """keys, block, symbols: the text of every packed block."""
    unpack = F.pandas_udf(lambda data: pd.Series(["".join(alphabet[c] for c in unpack_text(d)) for d in data]), "string")
    return packed.select(*keys, "block", unpack("packed").alias("symbols"))
