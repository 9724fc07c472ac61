import random

import pytest

from strandlake.operators import matching, postings
from strandlake.plans.index import ReadIndex
from strandlake.schema import BuildConfig, EngineError, Strand
from tests.fixtures import READ_SCHEMA, TEN_READS


def test_words(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=r.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "ACGTA")]
    df = spark.createDataFrame(rows, "read_id bigint, seq string").repartition(3)
    got = sorted(map(tuple, postings.build_postings(df, 5).collect()))
    want = sorted({(postings.word_code(s[i : i + 5]), n) for n, s in rows if s for i in range(len(s) - 4) if "N" not in s[i : i + 5]})
    assert got == want
    table = spark.createDataFrame(got, "word bigint, read_id bigint")
    for pattern in ("ACGTA", "ACGTAC", "GGATC", "TTTTTTT", "ACG", "ACGNA", "A" * 70):
        for strand in Strand:
            few = postings.candidates(df, table, 5, pattern, strand)
            assert matching.count_matches(few, [pattern], strand).first()["n"] == matching.count_matches(df, [pattern], strand).first()["n"]
    assert postings.build_postings(df.where("read_id < 0"), 5).count() == 0
    with pytest.raises(EngineError):
        postings.build_postings(df, 40)


def test_index_with_postings(spark, tmp_path):
    raw = spark.createDataFrame(TEN_READS, READ_SCHEMA)
    index = ReadIndex.build(spark, raw, f"file://{tmp_path}/w", BuildConfig(word_size=4))
    assert index.info["mode"] == "ENHANCED"
    assert [index.count(p) for p in ("ACGT", "CCGGTTAA", "ACGTACGT", "GATTACA", "A")] == [13, 5, 9, 0, 70]
    assert index.locate("GGGG").count() == 7 and index.exists("ACGT", 13) and not index.exists("ACGT", 14)
