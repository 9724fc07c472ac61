"""Small read sets with known results."""

READ_SCHEMA = "qname string, flag bigint, chrom string, pos bigint, mapq bigint, cigar string, seq string, qual array<int>, aux binary, source_file_id bigint, bam_offset bigint"

_TEN = [
    (0, 101, "16M", "ACGTACGTACGTACGT", 73),
    (0, 201, "16M", "CCGGTTAACCGGTTAA", 72),
    (0, 301, "16M", "AAAACCCCGGGGTTTT", 69),
    (0, 401, "4M2I6M", "ACGTACGTACGT", 73),
    (0, 501, "6M2D6M", "TTTTCCCCAAAA", 72),
    (0, 601, "2S8M2S", "GGGGCCCCAAAA", 69),
    (16, 701, "16M", "ACGTACGTACGTACGT", 73),
    (0, 801, "8M1I7M", "AACCGGTTAACCGGTT", 72),
    (0, 901, "3S10M3S", "CCCCAAAATTTTGGGG", 69),
    (0, 1001, "8M", "ACGTACGT", 73),
]
TEN_READS = [(f"read{i + 1:02d}", f, "chr1", p, 60, c, s, [q] * len(s), None, 0, i) for i, (f, p, c, s, q) in enumerate(_TEN)]


def offsets(text: str, word: str) -> list[int]:
    return [i for i in range(len(text) - len(word) + 1) if text[i : i + len(word)] == word]


def revcomp(word: str) -> str:
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))
