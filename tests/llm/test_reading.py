import numpy as np

from strandlake.llm import reading


def test_own_prose():
    cases = {
        "> quoted\n>> more\nmine": "mine",
        "bob wrote:\n> hard words\n\nmine": "mine",
        "[quote=a]x [quote=b]y[/quote] z[/quote]mine": "mine",
        "<blockquote>x <blockquote>y</blockquote></blockquote>mine": "mine",
        "mine\n-- \nBob since 2001": "mine",
        "mine\nSent from my Phone": "mine",
        "mine [code]int x[/code]": "mine",
        "mine <pre>int x</pre>": "mine",
        "mi<b>n</b>e http://a.b/c": "mi n e",
        "[img]http://pix/x.png[/img]&nbsp;mine": "mine",
        "[deleted]": "",
        "": "",
        "[quote=a] never closed": "",
    }
    for text, want in cases.items():
        assert reading.own_prose(text).split() == want.split(), text


def flat_corpus():
    return reading.Corpus(np.ones(reading.WORDS, np.float32), np.ones(reading.TRIPLES, np.float32), np.zeros(reading.WORDS, bool), 2.0)


def test_features():
    texts = [reading.prepared(t) for t in (None, "> all quoted", "We approx. saw it. They (cf. no. 4.2) left!\n - One\n - Two things", "Don’t, don't… “stop”\u00a0now")]
    words = reading.Words(texts)
    assert words.n.tolist() == [0, 0, 11, 4]
    x = reading.plain_features(words, texts, flat_corpus())
    assert np.isclose(x[2, 0], 11 / 4) and not x[:2].any() and x.shape == (4, len(reading.FEATURES) - 2)


def test_words_are_the_expressions():
    """Runs of letters with inner apostrophes, as a regular expression finds them; equal words in one place."""
    import re

    r = np.random.default_rng(3)
    letters = list("abzAÉß'’ .,-–“”…\u00a07\n")
    texts = ["".join(r.choice(letters, 60)) for _ in range(200)]
    words = reading.Words(texts)
    want = [re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", t.lower()) for t in texts]
    assert words.n.tolist() == [len(w) for w in want]
    assert words.letters.tolist() == [len(x) for w in want for x in w]
    place = {}
    for x, p in zip((x for w in want for x in w), words.word.tolist()):
        assert place.setdefault(x, p) == p


def test_ranker_uses_all_pairs():
    """The blockwise sums against the pairs written out."""
    r = np.random.default_rng(5)
    z, level = r.normal(size=(60, 3)), r.integers(1, 5, 60).astype(float)
    z[:, 0] += level / 2
    w = reading.rank_weights(z, level)
    a, b = np.nonzero(level[:, None] > level[None, :])
    loss = lambda w: np.log1p(np.exp(-(z[a] - z[b]) @ w)).mean() + 5e-4 * w @ w
    assert all(loss(w) <= loss(w + e) for e in 1e-3 * np.vstack([np.eye(3), -np.eye(3)]))


def test_isotonic():
    knots, levels = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert knots.tolist() == [1, 1, 2, 3, 4, 4] and levels.tolist() == [1, 1, 2.5, 2.5, 5, 5]


def sample(n, seed):
    r = np.random.default_rng(seed)
    easy, hard = "the cat saw my dog and a hen".split(), "notwithstanding institutional considerations perpetuate multidimensional heterogeneity".split()
    out = []
    for i in range(n):
        level = int(r.integers(1, 6))
        text = ""
        for _ in range(12):
            k = 3 + 3 * level
            text += " ".join(r.choice(hard if r.random() < level / 7 else easy) for _ in range(k)) + ". "
        quote = "\n".join("> " + " ".join(r.choice(hard, 9)) for _ in range(int(r.integers(0, 8))))
        out.append((i, quote + "\n" + text, level))
    return out


def test_held_out(spark):
    train, test = sample(150, 1), sample(200, 2)
    docs = spark.createDataFrame([(i, t, "e") for i, t, _ in train], "doc_id bigint, text string, level string")
    labels = spark.createDataFrame([(i, r, None if r == 2 and i % 5 == 0 else l) for i, _, l in train for r in range(3)], "doc_id bigint, rater int, read_level int")
    model = reading.train(docs, labels, reading.corpus_counts(docs))
    out = reading.reading_levels(spark.createDataFrame([(i, t, 1) for i, t, _ in test], "doc_id bigint, text string, score int"), model).collect()
    level = {i: l for i, _, l in test}
    assert len(out) == 200
    assert np.mean([(x["level"] >= 3.5) == (level[x["doc_id"]] >= 4) for x in out]) > 0.93
    assert np.mean([abs(x["level"] - level[x["doc_id"]]) for x in out]) < 0.5


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b c. " * 30), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, rater int, read_level int")
    assert [x["level"] for x in reading.reading_levels(docs, reading.train(docs, none, reading.corpus_counts(docs))).collect()] == [3.0, 3.0]
    one = spark.createDataFrame([(1, 1, 4), (2, 1, 2), (3, 1, None)], none.schema)
    assert {x["level"] for x in reading.reading_levels(docs, reading.train(docs, one, reading.corpus_counts(docs))).collect()} == {4.0}
    assert reading.reading_levels(docs.where("doc_id > 5"), reading.train(docs, one, reading.corpus_counts(docs))).count() == 0


def test_more_labels_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(reading, "MAX_LABELLED", 40)
    train = sample(90, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, l) for i, _, l in train], "doc_id bigint, rater int, read_level int")
    a, b = reading.train(docs, labels, reading.corpus_counts(docs)), reading.train(docs.repartition(5), labels.repartition(3), reading.corpus_counts(docs.repartition(7)))
    assert np.allclose(a.weights, b.weights)
