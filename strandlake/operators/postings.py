"""K-mer postings: which reads hold which words of k bases, so that a search need not scan all reads.

The table has one row per read and different word, range-partitioned and sorted by word: a lookup of a few words reads the
few row groups whose statistics admit them. A pattern of at least k bases is answered by its rarest words: every read that
holds the pattern holds them. The reads found are then searched like any others, so results equal the scan's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.patterns import orientations
from strandlake.schema import EngineError, ErrorCode, Strand

_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def word_code(word: str) -> int:
    """Two bits a base, A, C, G, T as 0 to 3; words with other letters have none (-1)."""
    out = 0
    for c in _CODE[np.frombuffer(word.encode(), np.uint8)].tolist():
        if c > 3:
            return -1
        out = out << 2 | c
    return out


def _words(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            raw = b"".join(texts.to_pylist())
            codes = _CODE[np.frombuffer(raw, np.uint8)].astype(np.int64)
            n = max(0, len(codes) - k + 1)
            word, bad = np.zeros(n, np.int64), np.zeros(n, bool)
            for j in range(k):
                word = word << 2 | codes[j : j + n] & 3
                bad |= codes[j : j + n] > 3
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.repeat(np.cumsum(sizes), sizes)
            good = ~bad & (np.arange(n) + k <= ends[:n])
            ids = batch.column(0).to_numpy()[row[:n][good]]
            pairs = np.unique(np.stack([ids, word[good]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], names=["word", "read_id"])

    return run


def build_postings(reads: DataFrame, k: int = 12, partitions: int | None = None) -> DataFrame:
    """word, read_id: reads (read_id, seq) by their different words of k bases. Words with N are left out, as are null and
    short sequences; an empty table gives none."""
    if not 4 <= k <= 31:
        raise EngineError(ErrorCode.INVALID_CONFIG, "words of 4 to 31 bases")
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reads.where(F.length("seq") >= k).select(F.col("read_id").cast("bigint").alias("read_id"), "seq").mapInArrow(_words(k), "word bigint, read_id bigint")
    return rows.repartitionByRange(n, "word", "read_id").sortWithinPartitions("word", "read_id")


def _rarest(postings: DataFrame, words: list[list[int]]) -> list[int | None]:
    """Of each list of words the one with the fewest rows; None if a word of the list has no row at all."""
    every = sorted({w for ws in words for w in ws})
    counts = {r["word"]: r["n"] for r in postings.where(F.col("word").isin(every)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [min(ws, key=lambda w: (counts[w], w)) if all(w in counts for w in ws) else None for ws in words]


def candidates(reads: DataFrame, postings: DataFrame, k: int, pattern: str, strand: Strand = Strand.COMPLETE) -> DataFrame:
    """The reads that may hold the pattern on either strand; all reads, for patterns shorter than k or with N."""
    words = [[word_code(w[i : i + k]) for i in range(len(w) - k + 1)] for w, _ in orientations(pattern, strand)]
    if any(not ws or -1 in ws for ws in words):
        return reads
    seeds = sorted({w for w in _rarest(postings, words) if w is not None})
    found = postings.where(F.col("word").isin(seeds) if seeds else F.lit(False)).select("read_id").distinct()
    return reads.join(found, "read_id", "left_semi")
