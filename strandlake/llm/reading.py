"""Reading level of a text: a linear pairwise ranker on syntax and vocabulary features, calibrated by isotonic regression.

What counts as a rare word, a common word or an unusual spelling is learned from the whole corpus, by counts in tables of
fixed size (words and letter triples are hashed); which words and which patterns of common words mark a level is learned
from the graded posts. No word list is given. Training sees at most MAX_LABELLED graded posts (a documented bound of a
model fit; posts beyond it are left out by a hash of their id), and all pairs of different grade among them. Scoring covers
every post, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 10_000
#: Sizes of the tables: words, patterns of two words, triples of letters.
WORDS, PATTERNS, TRIPLES = 1 << 16, 1 << 15, 1 << 15
#: So many of the most frequent words of the corpus stand for themselves in a pattern; others by their length.
COMMON = 128
#: Posts without a say in a word's grade: it is drawn towards the mean as if so many posts of the mean level held it.
SHRINK = 5.0
#: Features are held within so many deviations of their mean, so that one odd text has no outsized weight.
CLIP = 4.0
SLICE = 400

_QUOTED_LINE = re.compile(r"^[ \t]*(?:>|&gt;).*$", re.M)
#: A line that ends like "Ann wrote:" names who is quoted; lines with more characters before the verb are prose.
ATTRIBUTION_CHARS = 80
_ATTRIBUTION = re.compile(rf"^[^\n]{{0,{ATTRIBUTION_CHARS}}}\b(?:wrote|said|writes|schrieb|escribió|a écrit)\s*:[ \t]*$", re.M | re.I)
_BLOCK = re.compile(r"(\[/?quote[^\[\]]*\]|</?blockquote[^<>]*>)", re.I)
_CODE = re.compile(r"\[code[^\[\]]*\].*?(?:\[/code\]|\Z)|<(pre|code)\b[^<>]*>.*?(?:</\1>|\Z)|```.*?(?:```|\Z)|\[img[^\[\]]*\].*?(?:\[/img\]|\Z)", re.S | re.I)
_SIGNATURE = re.compile(r"^(?:--[ \t]*$|_{5,}[ \t]*$).*\Z|^[ \t]*(?:Sent from my|Gesendet von|Enviado desde|Envoyé de)\b[^\n]*$", re.M | re.S)
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\[\]]+", re.I)
_BREAK = re.compile(r"<(?:br|/?p)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|&#?\w{1,10};")
#: Abbreviations whose full stop ends no sentence. Fixed values.
_SHORT = re.compile(r"\b(approx|cf|no|vs|etc|ca|resp|bzw|fig|i\.e|e\.g|z\.B)\.", re.I)
_SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n{2,}|\n\s*(?:[-*•]|\d{1,3}[.)])\s|\n[ \t]*(?=[A-ZÀ-ÖØ-Þ])")

FEATURES = (
    "sentence_words", "sentence_spread", "word_letters", "long_7", "long_10", "long_13", "commas", "common", "rarity", "rare", "spelling", "different", "log_words",
    "word_grade", "pattern_grade",
)
#: Marks the end of a sentence in prepared text.
_STOP = 1


def own_prose(text: str) -> str:
    """The author's own prose: without quotes, attribution lines, signatures, markup, links and code."""
    if "[" in text or "<" in text or "`" in text:
        text = _CODE.sub(" ", text)
        low = text.lower()
        if "quote" in low:
            depth, kept = 0, []
            for part in _BLOCK.split(text):
                if _BLOCK.fullmatch(part):
                    depth = max(0, depth - 1) if part[1] == "/" else depth + 1
                elif depth == 0:
                    kept.append(part)
                else:
                    kept.append("\n")
            text = "".join(kept)
    if ">" in text or "&gt;" in text:
        text = _QUOTED_LINE.sub("", text)
    if ":" in text:
        text = _ATTRIBUTION.sub("", text)
        text = _LINK.sub(" ", text)
    if "--" in text or "ent " in text or "___" in text or "nv" in text:
        text = _SIGNATURE.sub("", text)
    if "<" in text or "[" in text or "&" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", text))
    return text


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    """Places in a table of a power of two entries (multiplicative hashing)."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


_IS_MARK = np.isin(np.arange(256), np.frombuffer(b",;:()-", np.uint8))
_POWERS = np.cumprod(np.concatenate(([1], np.full(63, 1099511628211, np.uint64))).astype(np.uint64))


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes of lower-case UTF-8 text belong to words: letters, and an apostrophe between two letters. Of the signs
    beyond ASCII, those of the blocks U+0080-00BF, U+2000-207F and U+3000-303F are none."""
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    two = np.flatnonzero(raw[:-1] == 0xC2)
    three = np.flatnonzero(((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81))) | ((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80)))
    for start, n in ((two, 2), (three, 3)):
        for k in range(n):
            letter[start + k] = False
    plain = np.flatnonzero(raw == 39)
    plain = plain[(plain > 0) & (plain < len(raw) - 1)]
    letter[plain[letter[plain - 1] & letter[plain + 1]]] = True
    curly = three[(raw[three] == 0xE2) & (raw[three + 1] == 0x80) & (raw[three + 2] == 0x99)]
    curly = curly[(curly > 0) & (curly < len(raw) - 3)]
    curly = curly[letter[curly - 1] & letter[curly + 3]]
    for k in range(3):
        letter[curly + k] = True
    return letter


class Words:
    """The words of many texts laid end to end: text (which one), place in the table of words, letters, sentence (numbered
    through all texts), and whether a comma, colon, dash or bracket stands before it. A word is a run of letters; its hash
    takes its first 64 bytes; an apostrophe between letters belongs to the word."""

    def __init__(self, texts: list[str]):
        whole = [t.lower().encode() for t in texts]
        raw = np.frombuffer(b"\0".join([*whole, b""]), np.uint8)
        sizes = np.array([len(w) + 1 for w in whole], np.int64)
        letter = _letters(raw)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        self.raw, self.letter = raw, letter
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.text = self.of[self.begin].astype(np.int64)
        spelled = np.concatenate(([0], np.cumsum(letter & ((raw & 0xC0) != 0x80))))
        self.letters = spelled[self.end] - spelled[self.begin]
        size = self.end - self.begin
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        # only letters are left, in order, so a word's bytes lie side by side
        value = (raw[letter].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(inner, 63)] * (inner < 64)
        summed = np.concatenate(([np.uint64(0)], np.cumsum(value)))
        upto = np.cumsum(size)
        self.word = _mixed(summed[upto] - summed[upto - size], WORDS) if len(size) else size
        stop = np.cumsum((raw == _STOP) | (raw == 0))
        self.sentence = stop[self.begin] if len(size) else size
        marks = np.concatenate(([0], np.cumsum(_IS_MARK[raw])))
        before = np.concatenate(([0], self.end[:-1])) if len(size) else size
        self.marked = marks[self.begin] > marks[before]
        self.n = np.bincount(self.text, minlength=len(texts))

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the table) of every three letters of a word that follow each other."""
        r = self.raw.astype(np.uint64)
        at = np.flatnonzero(self.letter[:-2] & self.letter[1:-1] & self.letter[2:]) if len(r) > 2 else np.zeros(0, np.int64)
        code = r[at] << np.uint64(16) | r[at + 1] << np.uint64(8) | r[at + 2]
        return self.of[at], _mixed(code, TRIPLES)

    def patterns(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the table) of every two words of a sentence that follow each other: common ones as they are,
        others by their number of letters, and whether a mark stands between them."""
        token = np.where(common[self.word], self.word + 64, np.minimum(self.letters, 63)).astype(np.uint64)
        same = np.flatnonzero(self.sentence[1:] == self.sentence[:-1]) if len(token) else np.zeros(0, np.int64)
        code = (token[same] << np.uint64(20) | token[same + 1]) << np.uint64(1) | self.marked[same + 1].astype(np.uint64)
        return self.text[same], _mixed(code, PATTERNS)


def prepared(text: str | None) -> str:
    """Own prose with a mark at the end of every sentence."""
    return _SENTENCE.sub("\x01 ", _SHORT.sub(r"\1", own_prose(text or "").replace("\0", " ").replace("\x01", " ")))


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The values of a column in lists that the processor's caches hold; sizes change no result."""
    for a in range(0, len(column), SLICE):
        yield column.slice(a, SLICE).to_pylist()


# --- what is learned from the whole corpus


@dataclass(frozen=True)
class Corpus:
    """How surprising each word and letter triple is (minus the logarithm of its share), and which words are common."""

    rarity: np.ndarray
    spelling: np.ndarray
    common: np.ndarray
    rare_from: float


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(WORDS + TRIPLES, np.int64)
    for batch in batches:
        for texts in _slices(pc.fill_null(batch.column(0), "")):
            words = Words(texts)
            np.add.at(counts, words.word, 1)
            np.add.at(counts, WORDS + words.triples()[1], 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["place", "n"])


def corpus_counts(docs: DataFrame) -> Corpus:
    """Counts over the whole texts of all documents (docs: text); a task hands on one table of fixed size."""
    rows = docs.select("text").mapInArrow(_count_task, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(WORDS + TRIPLES)
    for r in rows:
        counts[r["place"]] = r["n"]
    words, triples = counts[:WORDS], counts[WORDS:]
    surprise = lambda n: -np.log((n + 0.5) / (n.sum() + 0.5 * len(n)))
    order = np.argsort(-words, kind="stable")
    common = np.zeros(WORDS, bool)
    common[order[:COMMON][words[order[:COMMON]] > 0]] = True
    rarity = surprise(words)
    # rare: the least frequent words that together are a tenth of all words
    share = np.cumsum(words[order][::-1]) / max(words.sum(), 1)
    edge = order[::-1][min(int(np.searchsorted(share, 0.1)), WORDS - 1)]
    return Corpus(rarity.astype(np.float32), surprise(triples).astype(np.float32), common, float(rarity[edge]))


# --- features


def _means(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=value, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)


def plain_features(words: Words, texts: list[str], corpus: Corpus) -> np.ndarray:
    """All FEATURES but the grades, a row per text; zeros for a text without words."""
    n, t = len(texts), words.text
    size = np.maximum(words.n, 1)
    sentences, of = np.unique(words.sentence, return_inverse=True)
    length = np.bincount(of, minlength=len(sentences)).astype(float)
    owner = np.zeros(len(sentences), np.int64)
    owner[of] = t
    per = np.maximum(np.bincount(owner, minlength=n), 1)
    mean = np.bincount(owner, weights=length, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, weights=length**2, minlength=n) / per - mean**2, 0))
    commas = np.bincount(words.of[np.flatnonzero(words.raw == ord(","))], minlength=n)
    rarity = corpus.rarity[words.word]
    where, triple = words.triples()
    different = np.bincount(np.unique(t * WORDS + words.word) // WORDS, minlength=n)
    columns = [
        mean,
        spread,
        _means(t, words.letters, n),
        *[_means(t, words.letters >= k, n) for k in (7, 10, 13)],
        commas / per,
        _means(t, corpus.common[words.word], n),
        _means(t, rarity, n),
        _means(t, rarity >= corpus.rare_from, n),
        _means(where, corpus.spelling[triple], n),
        different / np.sqrt(size),
        np.log(size),
    ]
    return np.stack(columns, axis=1) * (words.n > 0)[:, None]


class Grades:
    """Per table place the mean level of the graded texts that hold it, as the distance from their mean, shrunk to 0."""

    def __init__(self, size: int, pairs: np.ndarray, level: np.ndarray):
        """pairs: (text, place) of the graded texts, each once."""
        away = (level - level.mean()) if len(level) else level
        self.n = np.bincount(pairs[1], minlength=size).astype(np.float32)
        self.total = np.bincount(pairs[1], weights=away[pairs[0]], minlength=size).astype(np.float32)

    def mean(self, text: np.ndarray, place: np.ndarray, n: int, own: np.ndarray | None = None) -> np.ndarray:
        """The mean grade of each text's places. own: the texts' own distances, taken out of the grades (in training)."""
        mine = 0 if own is None else own[text]
        return _means(text, (self.total[place] - mine) / (np.maximum(self.n[place] - (own is not None), 0) + SHRINK), n)


@dataclass(frozen=True)
class Model:
    """Corpus counts, grades, standardisation, weights of the ranker, and the calibration curve from score to level."""

    corpus: Corpus
    words: Grades
    patterns: Grades
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of own words, and FEATURES, of prepared texts."""
        words = Words(texts)
        where, pattern = words.patterns(self.corpus.common)
        grades = [self.words.mean(words.text, words.word, len(texts)), self.patterns.mean(where, pattern, len(texts))]
        return words.n, np.column_stack([plain_features(words, texts, self.corpus), *grades])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP) @ self.weights

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), self.knots, self.levels)


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares curve through (score, level), by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], level[order]):
        blocks.append([y, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, n2, _, last = blocks.pop()
            y1, n1, first, _ = blocks.pop()
            blocks.append([(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, first, last])
    knots = [k for b in blocks for k in ((b[2], b[0]), (b[3], b[0]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def rank_weights(z: np.ndarray, level: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic ranker by Newton steps over all pairs of rows of different level. Pairs are never listed: their scores are
    differences, so sums over pairs come from blocks of one level's rows against another's."""
    d, groups = z.shape[1], [np.flatnonzero(level == v) for v in np.unique(level)]
    pairs = sum(len(a) * len(b) for i, a in enumerate(groups) for b in groups[:i])
    w = np.zeros(d)
    if not pairs:
        return w
    for _ in range(30):
        score = z @ w
        pull, grad, hess = np.zeros(len(z)), -ridge * w, ridge * np.eye(d)
        for i, upper in enumerate(groups):
            for lower in groups[:i]:
                for a in range(0, len(upper), 1024):
                    up = upper[a : a + 1024]
                    miss = 1 / (1 + np.exp(np.clip(score[up][:, None] - score[lower][None, :], -30, 30)))
                    pull[up] += miss.sum(1)
                    pull[lower] -= miss.sum(0)
                    miss *= 1 - miss
                    cross = z[up].T @ (miss @ z[lower])
                    hess += ((z[up] * miss.sum(1)[:, None]).T @ z[up] + (z[lower] * miss.sum(0)[:, None]).T @ z[lower] - cross - cross.T) / pairs
        step = np.linalg.solve(hess, grad + z.T @ pull / pairs)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], level: np.ndarray, corpus: Corpus) -> Model:
    """Grades, ranker and calibration from prepared texts and their levels.

    Without two different levels there is nothing to rank: the weights are then zero and every level the mean (3 without
    any label).
    """
    words = Words(texts)
    where, pattern = words.patterns(corpus.common)
    grades = [Grades(size, np.unique(np.stack([t, p]), axis=1) if len(t) else np.zeros((2, 0), np.int64), level) for size, t, p in ((WORDS, words.text, words.word), (PATTERNS, where, pattern))]
    if not len(level):
        d = len(FEATURES)
        return Model(corpus, *grades, np.zeros(d), np.ones(d), np.zeros(d), np.zeros(1), np.full(1, 3.0))
    away = level - level.mean()
    x = np.column_stack([plain_features(words, texts, corpus), grades[0].mean(words.text, words.word, len(texts), away), grades[1].mean(where, pattern, len(texts), away)])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / scale, -CLIP, CLIP)
    weights = rank_weights(z, level)
    if not weights.any():
        return Model(corpus, *grades, centre, scale, weights, np.zeros(1), np.full(1, float(level.mean())))
    return Model(corpus, *grades, centre, scale, weights, *isotonic(z @ weights, level))


def agreed_levels(labels: DataFrame) -> DataFrame:
    """doc_id, level: the median of a post's levels; null levels are no vote."""
    return labels.where("read_level is not null and doc_id is not null").groupBy("doc_id").agg(F.expr("percentile(read_level, 0.5)").alias("level"))


def _prepare_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [prepared(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(Words(texts).n), pa.array(texts, pa.string())], names=["doc_id", "own_words", "prose"])


def graded_prose(docs: DataFrame, labels: DataFrame, least_words: int = 40) -> tuple[list[int], list[str], np.ndarray]:
    """Ids, prepared texts and levels of at most MAX_LABELLED graded posts among docs (doc_id, text) that have at least
    least_words own words."""
    graded = agreed_levels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # graded has at most MAX_LABELLED rows of two numbers: with it broadcast, no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id")
    seen = rows.select("doc_id", "text").mapInArrow(_prepare_task, "doc_id bigint, own_words bigint, prose string")
    got = seen.join(F.broadcast(graded), "doc_id").where(F.col("own_words") >= least_words).orderBy("doc_id").select("doc_id", "prose", "level").collect()
    return [r["doc_id"] for r in got], [r["prose"] for r in got], np.array([r["level"] for r in got], float)


def train(docs: DataFrame, labels: DataFrame, corpus: Corpus, least_words: int = 40) -> Model:
    """Fit on the graded posts among docs."""
    _, texts, level = graded_prose(docs, labels, least_words)
    return fit(texts, level, corpus)


def held_out(docs: DataFrame, labels: DataFrame, corpus: Corpus, least_words: int = 40, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(level, estimate) of every graded post, estimated by a model that was fitted without its fold."""
    ids, texts, level = graded_prose(docs, labels, least_words)
    fold, guess = np.array(ids, np.int64) % folds, np.zeros(len(ids))
    for k in np.unique(fold):
        rest, mine = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        model = fit([texts[i] for i in rest], level[rest], corpus)
        guess[mine] = model.level(model.features([texts[i] for i in mine])[1])
    return level, guess


def _level_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features([prepared(t) for t in texts]) for texts in _slices(batch.column(1))]
            n, x = (np.concatenate([f[i] for f in found] or [empty]) for i, empty in enumerate((np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(model.score(x)), pa.array(model.level(x))],
                names=["doc_id", "own_words", "score", "level"],
            )

    return run


def reading_levels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, own_words, score, level (1 easiest to 5 hardest) of every document of docs (doc_id, text).

    Null, empty and quote-only texts have 0 own words and the level of an all-zero feature vector: filter on own_words.
    Repeated rows are each scored; an empty table gives no rows; other columns are dropped.
    """
    return docs.select("doc_id", "text").mapInArrow(_level_task(model), "doc_id bigint, own_words bigint, score double, level double")
