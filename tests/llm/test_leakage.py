import random

import pytest

from strandlake.llm import leakage

DOCS = "doc_id bigint, text string, item_id string, n_words int"
ITEMS = "item_id bigint, text string, doc_id int"


def test_words():
    text = 'It\'s <b>so</b> &amp; so[...] "Wide"\n> <p\n> class="post">Über-Äpfel_9'
    assert leakage.words([text, "", "x\0y"]) == ["it", "s", "so", "so", "wide", "über", "äpfel", "9", "\0", "\0", "x", "y", "\0"]


def brute(docs, items, least):
    out = []
    for i, t in items:
        for d, u in docs:
            if t is None or u is None or i is None or d is None:
                continue
            a, b = leakage.words([t])[:-1], leakage.words([u])[:-1]
            end = 0
            for y in range(len(b)):
                best = 0
                for x in range(len(a)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
                if best >= least and y + best > end:
                    out.append((i, d, y, best))
                    end = y + best
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(600_000, 8_000_000), (10, 300)])
def test_brute_force(spark, monkeypatch, shard, block):
    r = random.Random(shard)
    vocab = [f"w{i}" for i in range(40)] + ["a"] * 6
    say = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, say(r.choice([2, 5, 12, 30]))) for i in range(15)] + [(100, None), (None, say(20)), (101, ""), (102, "a " * 30)]
    docs = []
    for d in range(60):
        t = say(r.randint(0, 40))
        if r.random() < 0.5:
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(w))
            t += " <br>" + "\n> ".join(w[a : a + r.randint(1, 20)]).upper() + ". " + say(5)
        docs.append((d, t))
    docs += [(500, None), (None, say(30)), (501, ""), (502, "a " * 60), (3, docs[3][1])]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", block)
    monkeypatch.setattr(leakage, "_search", _small_shards(shard))
    df = spark.createDataFrame([(*x, "q", 1) for x in docs], DOCS).repartition(3)
    got = leakage.leaked_passages(df, spark.createDataFrame([(*x, 1) for x in items], ITEMS), 5)
    got = [tuple(x) for x in got.collect()]
    assert sorted((i, d, y, n) for i, d, _, y, n in got) == brute(docs, items, 5)
    held = dict(items)
    for i, d, x, y, n in got:
        assert any(leakage.words([held[i]])[x : x + n] == leakage.words([u])[y : y + n] for e, u in docs if e == d and u)


def _small_shards(size):
    real = leakage._search

    def make(items, least):
        inner = real(items, least)

        def run(batches):
            from strandlake.llm import leakage as m

            m.SHARD_WORDS = size
            return inner(batches)

        return run

    return make


def test_edges(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "one two three four", "", 1), (2, None, "", 1)], DOCS)
    some = spark.createDataFrame([(7, "Two, three FOUR", 1)], ITEMS)
    assert leakage.leaks(docs, some, 3).count() == 0 and leakage.leaks(full, items, 3).count() == 0
    found = leakage.leaks(full, some, 3)
    assert [tuple(x) for x in found.collect()] == [(7, 1, 1, 3)]
    assert [x["doc_id"] for x in leakage.without_leaks(full, found).collect()] == [2]
    assert leakage.leaks(full, some, 4).count() == 0


def test_repeated_words_cost_no_pairs():
    """An item of one word over and over, and documents of it: linear, not a row per pair of places."""
    import time

    def seconds(n):
        tests, docs = leakage._Tests([(1, "spam " * n)]), ["spam " * n] * 5
        began = time.time()
        item, doc, at, place, size = leakage._search_shard(list(range(5)), docs, tests, 12)
        assert list(doc) == list(range(5)) and set(size) == {n} and set(place) == {0}
        return time.time() - began

    seconds(1000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.02)
