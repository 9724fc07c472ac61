"""The index of the transform and bit vectors against plain Python, on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import bits, fm

ORDER = str.maketrans("$ACGTN#", "0123456")


def texts_of(seed):
    r = random.Random(seed)
    out = {1: "", 2: "A", 3: "#", 4: "ACGT" * 50, 5: "N" * 70}
    for i in range(6, 12):
        out[i] = "".join(r.choices("ACGTN#", [5, 5, 5, 5, 1, 1], k=r.randint(1, 300)))
    return out


def arrays(text):
    s = text + "$"
    order = sorted(range(len(s)), key=lambda i: s[i:].translate(ORDER))
    return order, [s[i - 1] for i in order]


@pytest.mark.parametrize("seed,step", [(1, 64), (2, 7)])
def test_blocks_search_and_walks(spark, seed, step):
    texts = texts_of(seed)
    df = spark.createDataFrame([*texts.items(), (99, None)], "text_id bigint, s string").repartition(3)
    sa = fm.suffix_array(df)
    blocks = fm.bwt_blocks(sa, step)
    known = {t: arrays(s) for t, s in texts.items()}
    asked = [(t, x, p) for t, (_, b) in known.items() for x in "$ACN#" for p in {0, 1, step, len(b) - 1, len(b), len(b) + 1}]
    got = fm.rank_at(blocks, spark.createDataFrame(asked, "text_id bigint, symbol string, place bigint"), "symbol", "place", "n", step)
    assert sorted(map(tuple, got.collect())) == sorted((t, x, p, known[t][1][:p].count(x)) for t, x, p in asked if 0 <= p <= len(known[t][1]))
    for pattern in ("A", "ACGT", "N#", "GGGGGGG"):
        want = {t: [r for r, i in enumerate(o) if texts[t][i:].startswith(pattern)] for t, (o, _) in known.items()}
        rows = {x["text_id"]: (x["lo"], x["hi"]) for x in fm.backward_search(blocks, pattern, step).collect()}
        assert rows == {t: (w[0], w[-1] + 1) if w else (0, 0) for t, w in want.items()}
    samples = fm.sa_samples(sa, 16).select("text_id", (F.col("k") * 16).alias("row"), "s_pos")
    both = samples.unionByName(fm.isa_samples(sa, 5).select("text_id", "row", (F.col("k") * 5).alias("s_pos")))
    for given in (samples, both):
        walked = {(x["text_id"], x["row"]): x["s_pos"] for x in fm.walked_positions(blocks, given, step).collect()}
        assert walked == {(t, r): i for t, (o, _) in known.items() for r, i in enumerate(o)}
    found = sorted(map(tuple, fm.locate_rows(blocks, both, "CG", step).collect()))
    assert found == sorted((t, i) for t, s in texts.items() for i in range(len(s)) if s[i:].startswith("CG"))
    back = {}
    for x in fm.text_from_bwt(blocks, samples, step).orderBy("text_id", "read_idx").collect():
        back.setdefault(x["text_id"], []).append(x["seq"])
    assert {t: "#".join(v) for t, v in back.items()} == texts
    assert fm.invariants(df, sa, "AC", 8).where("bad > 0").isEmpty()


def test_no_texts(spark):
    df = spark.createDataFrame([], "text_id bigint, s string")
    blocks = fm.bwt_blocks(fm.suffix_array(df))
    assert fm.backward_search(blocks, "A").count() == 0 and fm.lf_mapping(blocks).count() == 0
    assert fm.walked_positions(blocks, spark.createDataFrame([], "text_id bigint, row bigint, s_pos bigint")).count() == 0


def test_bit_vectors(spark):
    r = random.Random(3)
    lengths = {1: 100, 2: 1, 3: 37, 4: 0, 5: 64}
    ones = {1: sorted(r.sample(range(100), 30)), 2: [0], 3: [], 5: [0, 63]}
    rows = [(t, p) for t, ps in ones.items() for p in ps] + [(1, ones[1][0]), (1, 100), (1, -1), (1, None), (9, 3)]
    marks = spark.createDataFrame(rows, "line bigint, p bigint")
    vector = bits.bit_vector(marks, spark.createDataFrame([*lengths.items(), (6, None)], "line bigint, length bigint"), "line", "p", 8)
    asked = spark.createDataFrame([(t, p) for t, n in lengths.items() for p in range(-1, n + 2)], "line bigint, p bigint")
    inside = [(t, p) for t, n in lengths.items() for p in range(n)]
    own = lambda t: ones.get(t, [])
    assert sorted(map(tuple, bits.access(vector, asked, "line", "p", 8).collect())) == sorted((t, p, p in own(t)) for t, p in inside)
    assert sorted(map(tuple, bits.rank(vector, asked, "line", "p", 8).collect())) == sorted((t, p, sum(x <= p for x in own(t))) for t, p in inside)
    ks = spark.createDataFrame([(t, k) for t in lengths for k in range(33)], "line bigint, k bigint")
    assert sorted(map(tuple, bits.select(vector, ks, "line", "k", 8).collect())) == sorted((t, k + 1, p) for t in lengths for k, p in enumerate(own(t)))
