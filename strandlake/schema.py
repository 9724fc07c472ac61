"""Enums, errors and build settings."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Strand(str, Enum):
    """Both strands (a pattern equal to its reverse complement is searched once) or the pattern as written."""

    COMPLETE = "complete"
    SINGLE = "single"


class Overlap(str, Enum):
    ALL = "all"
    NONE = "none"


class ErrorCode(str, Enum):
    INVALID_BAM_INPUT = "INVALID_BAM_INPUT"
    EMPTY_PATTERN = "EMPTY_PATTERN"
    INVALID_PATTERN = "INVALID_PATTERN"
    INVALID_REGION = "INVALID_REGION"
    INVALID_READ_ID = "INVALID_READ_ID"
    INVALID_STREAM = "INVALID_STREAM"
    UNSUPPORTED_CODEC = "UNSUPPORTED_CODEC"
    UNSUPPORTED_CIGAR_OP = "UNSUPPORTED_CIGAR_OP"
    INVALID_CONFIG = "INVALID_CONFIG"
    IO_ERROR = "IO_ERROR"
    VERSION_MISMATCH = "VERSION_MISMATCH"
    CHECKSUM_MISMATCH = "CHECKSUM_MISMATCH"
    ORDERING_MISMATCH = "ORDERING_MISMATCH"
    MANIFEST_MISMATCH = "MANIFEST_MISMATCH"
    LOSSY_RECONSTRUCTION = "LOSSY_RECONSTRUCTION"
    NOT_IMPLEMENTED = "NOT_IMPLEMENTED"


class EngineError(Exception):
    """Any refusal of the engine; `code` says which."""

    def __init__(self, code: ErrorCode, message: str):
        super().__init__(f"{code.value}: {message}")
        self.code = code


QUALITY_CODECS = ("RANGE_CYCLE", "RANS_DELTA", "ZSTD_DICT", "BINNED_RANGE")
META_CODECS = ("TYPED_SPLIT", "ZSTD_FALLBACK")
MAP_CODECS = ("DELTA_RANGE", "RAW")


@dataclass(frozen=True)
class BuildConfig:
    """Settings of an index build.

    quality_bins and the codec BINNED_RANGE change the stored qualities; window_size makes the windows and enhanced has
    region queries ask them first; overlap and strand are the defaults of counting; block_size makes the directory of the
    streams; word_size above 0 adds postings of words of so many bases. Storage is Parquet with zstd whatever the codecs,
    and no query walks sampled suffixes or starts threads of its own: quality_codec (but for BINNED_RANGE), meta_codec,
    map_codec, sample_step, isa_step, reference, threads, entropy_k and seed_length are recorded in info, nothing more."""

    window_size: int = 100_000
    sample_step: int = 64
    isa_step: int = 0
    block_size: int = 1024
    quality_codec: str = "RANGE_CYCLE"
    quality_bins: int = 0
    meta_codec: str = "TYPED_SPLIT"
    map_codec: str = "DELTA_RANGE"
    strand: Strand = Strand.COMPLETE
    overlap: Overlap = Overlap.ALL
    enhanced: bool = False
    bidirectional: bool = False
    word_size: int = 0
    reference: str = ""
    threads: int = 1
    entropy_k: int = 0
    seed_length: int = 0

    def __post_init__(self) -> None:
        if self.bidirectional:
            raise EngineError(ErrorCode.NOT_IMPLEMENTED, "bidirectional index")
        for value, known in ((self.quality_codec, QUALITY_CODECS), (self.meta_codec, META_CODECS), (self.map_codec, MAP_CODECS)):
            if value not in known:
                raise EngineError(ErrorCode.UNSUPPORTED_CODEC, value)
        if min(self.window_size, self.sample_step, self.block_size) < 1:
            raise EngineError(ErrorCode.INVALID_CONFIG, "window, sample and block sizes start at 1")

    @property
    def lossless(self) -> bool:
        return not (0 < self.quality_bins < 94 or self.quality_codec == "BINNED_RANGE")
