"""Evaluation passages inside a training corpus, by suffix arrays over the corpus.

The corpus is read once, in shards of about SHARD_WORDS words that a task holds at a time. Of each shard and the test items
one suffix array is made, by prefix doubling over the words: after the ranks of the first `least` words only suffixes that
share them with another are ranked further, until a round tells nothing new. Every corpus suffix that shares `least` words
with an item is then binary-searched among the item's suffixes; its neighbours there hold the longest match, whose length
is read from the ranks of the rounds. So a place of a document costs one search per item that it matches, however often
the words repeat in either: pairs of suffixes are never listed. Documents are never split between shards.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_WORDS = 600_000
#: Test items are sent to the executors in blocks of at most this many characters; the corpus is read once per block, that
#: is once for all usual test sets.
BLOCK_CHARS = 64_000_000

#: What is no word and doesn't interrupt a run: tags (also when a quote mark stands inside them), brackets, entities.
_MARKUP = re.compile(r'<[^<>\0]*>(?:[\s>]*[a-z]+="[^"<>\0]*"\s*/?>)?|\[[^\[\]\0]*\]|&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});')
_WORD = re.compile(r"[^\W_]+|\0")

_SPAN = "item_id bigint, doc_id bigint, item_word bigint, doc_word bigint, n_words bigint"


def words(texts: list[str]) -> list[str]:
    """The words of the texts in lower case, each text followed by the separator '\\0'."""
    whole = "\0".join([t.replace("\0", " ") for t in texts] + [""]).lower()
    return _WORD.findall(_MARKUP.sub(" ", whole))


class _Tests:
    """The word sequence of the test items, each word with its item and its place in it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.tokens = words([t for _, t in items])
        stop = np.array([t == "\0" for t in self.tokens], bool)
        self.item = np.cumsum(stop) - stop
        self.begin = np.concatenate(([0], np.flatnonzero(stop)[:-1] + 1)) if stop.any() else np.zeros(0, np.int64)


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the pairs (high, low), whole numbers from 0; equal pairs share one."""
    key = high * (int(low.max()) + 1) + low if len(low) else high
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if len(order) else order
    return out


def _window_ranks(ids: np.ndarray, width: int) -> np.ndarray:
    """Ranks of all windows of `width` words, in the words' order, by doubling; words beyond the end are smallest."""
    n, rank, done = len(ids), ids, 1
    while done < width:
        step = min(done, width - done)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        rank, done = _ranks(rank, later), done + step
    return rank


class _Suffixes:
    """Suffixes of a word sequence, ranked by their first least, 2 least, 4 least, ... words.

    Every text must end with a word that occurs once, so that no match runs over it. Only the suffixes whose first `least`
    words occur again are held, in `at`; levels[k] has their ranks by the first least * 2^k words, the last level the full
    order. A suffix that isn't held is like no other; its place in the order is known by its first words.
    """

    def __init__(self, ids: np.ndarray, least: int):
        n = len(ids)
        rank = _window_ranks(ids, least)
        again = np.bincount(rank)[rank] > 1
        self.ids, self.least, self.at = ids, least, np.flatnonzero(again)
        self.levels, width = [rank[self.at]], least
        self.where = np.full(n + 1, -1, np.int64)
        self.where[self.at] = np.arange(len(self.at))
        rank = np.append(rank, -1)
        while len(self.at):
            last = self.levels[-1]
            spot = np.minimum(self.at + width, n)
            behind = self.where[spot]
            # last ranks refine the first, so of what comes behind a held suffix they tell all; the others are known apart
            # by their first words
            tail = _ranks(rank[spot] + 1, np.where(behind >= 0, last[np.maximum(behind, 0)], 0))
            fresh = _ranks(last, tail)
            self.levels.append(fresh)
            if fresh.max() == len(self.at) - 1:
                break
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the held suffixes a[i] and b[i] (places in `at`), which share their first words, have in
        common."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = self._go(a, n), self._go(b, n)
            same = (x >= 0) & (y >= 0)
            same[same] = self.levels[k][x[same]] == self.levels[k][y[same]]
            n[same] += self.least << k
        live = np.ones(len(a), bool)
        for _ in range(self.least):  # fewer than `least` words are left
            p, q = self.at[a] + n, self.at[b] + n
            live &= (p < len(self.ids)) & (q < len(self.ids))
            live[live] = self.ids[p[live]] == self.ids[q[live]]
            if not live.any():
                break
            n[live] += 1
        return n

    def _go(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.where[np.minimum(self.at[a] + n, len(self.ids))]


def _search_shard(doc_ids: list[int], texts: list[str], tests: _Tests, least: int) -> list[np.ndarray]:
    """Columns of the matches: item, doc (both as numbers in their lists), item_word, doc_word, n_words."""
    none = [np.zeros(0, np.int64)] * 5
    tokens = words(texts)
    vocabulary: dict[str, int] = defaultdict()
    vocabulary.default_factory = lambda: len(vocabulary) + 1
    vocabulary["\0"]
    corpus = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
    test = np.fromiter((vocabulary.get(t, 0) for t in tests.tokens), np.int64, len(tests.tokens))
    if len(corpus) < least or len(test) < least:
        return none
    # ends of texts, and words of items that no document of the shard has, break runs: each is a word of its own
    ids = np.concatenate((test, corpus))
    breaks = ids <= 1
    ids[breaks] = len(vocabulary) + 1 + np.arange(int(breaks.sum()))
    s = _Suffixes(ids, least)
    if not len(s.at):
        return none
    n_test, size = len(test), len(s.at)
    first, full = s.levels[0], s.levels[-1]
    own = np.flatnonzero(s.at < n_test)
    theirs = np.flatnonzero(s.at >= n_test)
    # (first words, item): which items hold the words that a corpus suffix begins with
    item = tests.item[s.at[own]]
    pairs = np.unique(np.stack([first[own], item]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
    low, high = np.searchsorted(pairs[0], first[theirs], "left"), np.searchsorted(pairs[0], first[theirs], "right")
    n = high - low
    place = np.repeat(theirs, n)
    if not len(place):
        return none
    which = pairs[1][np.repeat(low, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
    # the corpus suffix among the item's suffixes: the nearest below and above share most with it
    line = item * (size + 1) + full[own]
    order = np.argsort(line, kind="stable")
    line, members = line[order], own[order]
    spot = np.searchsorted(line, which * (size + 1) + full[place], "left")
    above, below = members[np.minimum(spot, len(members) - 1)], members[np.maximum(spot - 1, 0)]
    long = [np.where((tests.item[s.at[m]] == which) & (first[m] == first[place]), s.common(place, m), 0) for m in (below, above)]
    best, count = np.where(long[0] >= long[1], below, above), np.maximum(*long)
    ends = np.flatnonzero(corpus == 1)
    at = s.at[place] - n_test
    doc = np.searchsorted(ends, at)
    begin = np.concatenate(([0], ends[:-1] + 1))[doc]
    # a match that ends where the one before it in the document ends is a part of that one
    order = np.lexsort((at, doc, which))
    which, doc, at, begin, count, best = (x[order] for x in (which, doc, at, begin, count, best))
    new = np.ones(len(at), bool)
    new[1:] = (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] + count[1:] > at[:-1] + count[:-1])
    which, doc, at, begin, count, best = (x[new] for x in (which, doc, at, begin, count, best))
    return [which, doc, s.at[best] - tests.begin[which], at - begin, count]


_indexed: list[tuple[list, _Tests]] = []


def _search(items: Broadcast, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that is used again has the items' words already; the list is held, so no other can be taken for it
        if not _indexed or _indexed[0][0] is not items.value:
            _indexed[:] = [(items.value, _Tests(items.value))]
        tests = _indexed[0][1]
        docs: list[int] = []
        texts: list[str] = []
        chars = 0

        def search() -> pa.RecordBatch:
            nonlocal chars
            item, doc, at, place, n = _search_shard(docs, texts, tests, least)
            cols = [tests.ids[item] if len(item) else item, np.array(docs, np.int64)[doc] if len(doc) else doc, at, place, n]
            docs.clear(), texts.clear()
            chars = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _SPAN.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc), texts.append(text)
                chars += len(text) + 1
                if chars >= 6 * SHARD_WORDS:
                    yield search()
        if docs:
            yield search()

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """item_id, doc_id, item_word, doc_word, n_words: the stretches of a document that stand in an item too, word for word
    and at least `least` words long: for every place of the document the longest match that begins there, but for those
    that lie in the one before. item_word is a place of the item that has it. Offsets count words.

    docs: doc_id, text; items: item_id, text. Words are runs of letters and digits in lower case; tags, bracketed parts,
    entities, punctuation and line breaks neither are words nor interrupt a run. Null ids or texts match nothing; items
    below `least` words match nothing; repeated documents and items are each reported; empty tables give no rows; other
    columns are dropped. Items are a stated query set: they are sent out as broadcast variables of at most BLOCK_CHARS
    characters (more only if one item is longer), of which the driver holds one at a time, and searched against all
    documents.
    """
    context = docs.sparkSession.sparkContext
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    corpus = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    out, block, size = None, [], 0

    def flush(done: list[tuple[int, str]]) -> DataFrame:
        found = corpus.mapInArrow(_search(context.broadcast(done), least), _SPAN)
        return found if out is None else out.unionByName(found)

    for r in rows.orderBy("item_id").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_CHARS:
            out, block, size = flush(block), [], 0
    return flush(block) if block or out is None else out


def leaks(docs: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """item_id, doc_id, n_spans, longest: one row per item and document with a match. Cases as for leaked_passages."""
    return leaked_passages(docs, items, least).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.max("n_words").alias("longest"))


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
