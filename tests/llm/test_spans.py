import random

import pytest

from strandlake.llm import spans

SCHEMA = "rec_kind string, rec_id bigint, seq string, h1 int, chunk string"


def test_cover():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))
    for i in range(spans.PERIOD):
        for j in range(spans.PERIOD):
            assert any((i + d) % spans.PERIOD in spans.COVER and (j + d) % spans.PERIOD in spans.COVER for d in range(spans.PERIOD))
    assert spans.SPAN == 40


def brute(rows):
    where = {}
    for k, i, s in rows:
        for p in range(len(s or "") - 39):
            w = s[p : p + 40]
            if set(w) <= set("ACGT"):
                where.setdefault(w, set()).add((k, i))
    out = []
    for k, i, s in rows:
        mark = [False] * len(s or "")
        for p in range(len(mark) - 39):
            if len(where.get(s[p : p + 40], ())) > 1:
                mark[p : p + 40] = [True] * 40
        start = None
        for p, m in enumerate([*mark, False]):
            if m and start is None:
                start = p
            elif not m and start is not None:
                out.append((k, i, start, p))
                start = None
    return sorted(out)


def make(seed, n=120):
    r = random.Random(seed)
    rand = lambda k: "".join(r.choices("ACGT", k=k))
    genome, rows = rand(1500), []
    for i in range(n):
        a = r.randint(0, 1400)
        s = r.choice([genome[a : a + r.randint(30, 100)], rand(r.randint(0, 120)), rand(20) + genome[a : a + r.choice([39, 40, 41, 55])] + rand(15)])
        if r.random() < 0.15 and s:
            p = r.randrange(len(s))
            s = s[:p] + "N" + s[p + 1 :]
        rows.append(("read", i, s))
    rows += [("read", 1000 + i, rows[3][2]) for i in range(5)]
    rows += [("read", 2000 + i, "ACGGT" * r.randint(8, 40)) for i in range(6)] + [("read", 2100, "A" * 300), ("read", 2101, "A" * 41), ("read", 2102, "TTGCA" * 30)]
    half = rand(60)
    rows += [("read", 2200, half + rand(30) + half), ("read", 2300, None), ("read", 2301, ""), ("read", 2302, "N" * 80)]
    rows += [("bundle", i, "#".join(genome[a : a + 70] if r.random() < 0.5 else rand(70) for a in (r.randint(0, 1400) for _ in range(8)))) for i in range(8)]
    rows += [("bundle", 90, genome * 3)]
    return rows


@pytest.mark.parametrize("hot,chunk,together", [(50_000, 1 << 20, 1), (3, 400, 1), (0, 997, 5), (3, 400, 64)])
def test_brute_force(spark, monkeypatch, hot, chunk, together):
    """Also with every repeated anchor taken as very frequent, with records cut into many pieces, and with many chunks that
    share their rows."""
    rows = make(hot + 7)
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], SCHEMA).repartition(3)
    # workers import the module afresh: the piece size must travel with the function
    monkeypatch.setattr(spans, "exchange_sizes", lambda bases: (chunk, together))
    assert sorted(map(tuple, spans.shared_spans(df, hot).collect())) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.shared_spans(df).count() == 0
    one = spark.createDataFrame([("read", 1, "ACGT" * 30, 1, "")], SCHEMA)
    assert spans.shared_spans(one).count() == 0
    two = one.union(spark.createDataFrame([("bundle", 1, "ACGT" * 30, 1, "")], SCHEMA))
    assert sorted(map(tuple, spans.shared_spans(two).collect())) == [("bundle", 1, 0, 120), ("read", 1, 0, 120)]


def test_sizes():
    """Anchors of a row stay the same from a billion bases to a trillion, as the number of rows to the bases does."""
    assert spans.exchange_sizes(0) == spans.exchange_sizes(10**8) == (spans.LEAST_SIZE, 1)
    for bases in (2 * 10**9, 2 * 10**10, 2 * 10**11, 10**12):
        size, together = spans.exchange_sizes(bases)
        rows = (bases / size / together) * (bases * 4 / 13 / size)
        assert 0.7 < bases * 4 / 13 / rows / spans.ROW_ANCHORS < 1.5
