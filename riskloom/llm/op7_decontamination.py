"""Benchmark decontamination: BM25 with block-max WAND, then overlap checks.

The test items are indexed in shards of bounded size (``MAX_SHARD_BYTES`` of
text): an inverted index with BM25 impacts, each divided by the item's own full
score, so that an item that a passage holds entirely scores 1, and the greatest
impact of every term in every block of ``BLOCK_ITEMS`` items.  Each shard is
broadcast in turn and every passage of every training document is run against
it; passages overlap by at least the longest item of the shard, so an item that
a document holds lies whole in some passage.

WAND's bound is applied twice.  The commonest terms of an item, which together
stay below ``LIGHT`` of its score, cannot lift it to the threshold alone: per
batch of documents, the block maxima of the other terms' impacts are summed for
all (passage, block) pairs at once, and only where they can reach the threshold
a walk over the block's postings follows, which skips by the block maxima of all
terms and scores items exactly.  Every item at or above the threshold goes on to
the check: shared five-word shingles must cover the item as a whole
(``MIN_OVERLAP``), and shared words its question and its answer each
(``MIN_PART``).  The
question is the item up to its last question mark, or else up to its last line
or sentence; the rest is the answer.

Defined results: null or empty texts and items without words match nothing; an
item of fewer than five words counts as one shingle of all its words; of rows
with one doc_id, or with none, each is reported; an item listed twice is reported twice; extra
columns are ignored.  Nothing is capped: all pairs above the thresholds are
returned, at most one row per document and item.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common as C

K1, B = 1.2, 0.75
SHINGLE = 5
MIN_SCORE = 0.5
MIN_OVERLAP = 0.8
MIN_PART = 0.5
#: Share of an item's full score that its commonest terms stay below.
LIGHT = 0.25
PASSAGE_STRIDE = 64
BLOCK_ITEMS = 4
MAX_SHARD_BYTES = 16 << 20
#: Characters of text that a task matches at a time.
CHUNK_CHARS = 1_000_000

_WORD = re.compile(C.WORD_CLASS)


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(w: list[bytes]) -> set[bytes]:
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def answer_at(text: str) -> int:
    """Where the answer of an item begins, in characters; 0 if it has no question."""
    body = text.rstrip()
    for mark in ("?", "\n", ". "):
        at = body[:-1].rfind(mark)
        if at > 0:
            return at + len(mark)
    return 0


class Index:
    """Inverted index of one shard of items with block maxima."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, t, words(t)) for i, t in items]
        items = [x for x in items if x[2]]
        self.ids = [i for i, _, _ in items]
        self.words = [w for *_, w in items]
        self.parts = []
        for _, t, w in items:
            k = len(words(t[:answer_at(t)]))
            q, a = w[:k], w[k:]
            self.parts.append((shingles(w), [set(p) for p in (q, a) if p]))
        n = max(1, len(items))
        mean = sum(map(len, self.words)) / n
        df: dict[bytes, int] = {}
        for w in self.words:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        post: list[list[tuple[int, float]]] = [[] for _ in df]
        for i, w in enumerate(self.words):
            tf: dict[bytes, int] = {}
            for t in w:
                tf[t] = tf.get(t, 0) + 1
            norm = K1 * (1 - B + B * len(w) / mean)
            imp = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            total = sum(imp.values())
            for t, x in imp.items():
                post[self.terms[t]].append((i, x / total))
        # Postings term by term, items ascending: term t has the places at[t] to at[t + 1].
        self.at = array("q", np.concatenate([[0], np.cumsum([len(p) for p in post])]).astype(np.int64).tobytes())
        self.items = array("i", [i for p in post for i, _ in p])
        self.impact = array("d", [x for p in post for _, x in p])
        self._block_maxima()
        self.stride = max(PASSAGE_STRIDE, max(map(len, self.words), default=1))

    def postings(self, term: int) -> dict[int, float]:
        a, b = self.at[term], self.at[term + 1]
        return dict(zip(self.items[a:b], self.impact[a:b], strict=True))

    def _block_maxima(self) -> None:
        """Greatest impact of every term in every block: of all its items there, and
        of those in which it is not among the light terms."""
        items, impact = np.frombuffer(self.items, np.int32), np.frombuffer(self.impact, np.float64)
        term = np.repeat(np.arange(len(self.terms)), np.diff(np.frombuffer(self.at, np.int64)))
        self.n_blocks = len(self.ids) // BLOCK_ITEMS + 1
        # An item's lightest terms, as long as they stay below LIGHT together.
        order = np.lexsort((impact, items))
        total = np.cumsum(impact[order])
        first = np.searchsorted(items[order], items[order])
        heavy = np.empty(len(items), bool)
        heavy[order] = total - np.where(first > 0, total[first - 1], 0.0) >= LIGHT

        def maxima(which):
            key = term[which] * self.n_blocks + items[which] // BLOCK_ITEMS  # ascending
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            top = np.maximum.reduceat(impact[which], start) if len(key) else np.zeros(0)
            key = key[start]
            at = np.searchsorted(key // self.n_blocks, np.arange(len(self.terms) + 1))
            return at, key % self.n_blocks, top

        self.heavy_at, self.heavy_block, self.heavy_max = maxima(heavy)
        at, block, top = maxima(np.ones(len(items), bool))
        self.block_at, self.block, self.block_max = array("q", at.astype(np.int64).tobytes()), array("q", block.astype(np.int64).tobytes()), array("d", top.tobytes())

    def search_block(self, terms: list[int], block: int, least: float) -> list[int]:
        """Items of the block with at least the score, for distinct terms, by
        WAND: cursors in order of their item, skipping to the item at which the
        terms' block maxima can first reach the threshold."""
        first, last = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        items, cur = self.items, []
        for t in terms:
            k = bisect_left(self.block, block, self.block_at[t], self.block_at[t + 1])
            if k < self.block_at[t + 1] and self.block[k] == block:
                at, end = bisect_left(items, first, self.at[t], self.at[t + 1]), bisect_left(items, last, self.at[t], self.at[t + 1])
                cur.append([items[at], t, at, self.block_max[k], end])
        found = []
        while cur:
            cur.sort()
            bound, pivot = 0.0, None
            for c in cur:
                bound += c[3]
                if bound >= least - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            score, stay = 0.0, []
            aligned = cur[0][0] == pivot
            for c in cur:
                if c[0] <= pivot:
                    if aligned:
                        score += self.impact[c[2]]
                        c[2] += 1
                    else:
                        c[2] = bisect_left(items, pivot, c[2], c[4])
                    if c[2] == c[4]:
                        continue
                    c[0] = items[c[2]]
                stay.append(c)
            if aligned and score >= least - 1e-9:
                found.append(pivot)
            cur = stay
        return found

    def passages(self, texts) -> list[tuple[int, int, int, list[int]]]:
        """(text, first word, item, terms) of all scores at or above the threshold."""
        ids, at, doc = [], [], []
        known = self.terms
        for k, text in enumerate(texts):
            got = [known.get(w, -1) for w in words(text)]
            ids.append(np.array(got, dtype=np.int64))
        out = []
        # Passage p of a text is its words [p * stride, (p + 2) * stride).
        s = self.stride
        keys, owners, base = [], [], 0
        for k, a in enumerate(ids):
            pos = np.flatnonzero(a >= 0)
            if not len(pos):
                continue
            p = pos // s
            n_pass = len(a) // s + 1
            t = a[pos]
            both = np.concatenate([p, p[p > 0] - 1]) + base
            keys.append(both * len(known) + np.concatenate([t, t[p > 0]]))
            owners.append(np.full(n_pass, k))
            at.append(np.arange(n_pass) * s)
            base += n_pass
        if not keys:
            return out
        uniq = np.sort(np.concatenate(keys))
        uniq = uniq[np.r_[True, uniq[1:] != uniq[:-1]]]
        passage, term = uniq // len(known), uniq % len(known)
        owners, at = np.concatenate(owners), np.concatenate(at)
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        ends = np.r_[starts[1:], len(passage)]
        where = dict(zip(passage[starts].tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        # Expand every (passage, term) to the blocks where the term is heavy, and sum the maxima.
        n = (self.heavy_at[1:] - self.heavy_at[:-1])[term]
        src = np.repeat(np.arange(len(term)), n)
        at_heavy = self.heavy_at[term][src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        key = passage[src] * self.n_blocks + self.heavy_block[at_heavy]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return out
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        bound = np.add.reduceat(self.heavy_max[at_heavy][order], first)
        key = key[first]
        may = key[bound >= MIN_SCORE - LIGHT - 1e-9]
        for who, blk in zip((may // self.n_blocks).tolist(), (may % self.n_blocks).tolist(), strict=True):
            a, b = where[who]
            out += [(int(owners[who]), int(at[who]), item) for item in self.search_block(term[a:b].tolist(), blk, MIN_SCORE)]
        return out

    def verify(self, item: int, held: set[bytes], known: set[bytes]) -> float | None:
        """Share of the item's shingles in ``held``, if it and the shares of the
        question's and the answer's words in ``known`` pass."""
        whole, parts = self.parts[item]
        share = len(whole & held) / len(whole)
        return share if share >= MIN_OVERLAP and all(len(p & known) >= MIN_PART * len(p) for p in parts) else None


def _slices(texts: list) -> list[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS, at least one each, so that a task's
    arrays stay small whatever the size of its batches."""
    out, first, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            out.append((first, k + 1))
            first, size = k + 1, 0
    return [*out, (first, len(texts))]


def held_items(texts: list, index: Index) -> dict[int, dict[int, tuple[float, int]]]:
    """Text number -> item -> (greatest overlap, first word of its passage)."""
    best: dict[int, dict[int, tuple[float, int]]] = {}
    for first, last in _slices(texts):
        held: dict[tuple[int, int], set[bytes]] = {}
        at_text, w = -1, []
        for k, at, item in index.passages(texts[first:last]):
            if k != at_text:
                at_text, w, held = k, words(texts[first + k]), {}
            passage, size = w[at:at + 2 * index.stride], min(SHINGLE, len(index.words[item]))
            if (at, size) not in held:
                held[at, size] = {b" ".join(passage[i:i + size]) for i in range(len(passage) - size + 1)}
            share = index.verify(item, held[at, size], set(passage))
            if share is not None and share > best.get(first + k, {}).get(item, (0.0, 0))[0]:
                best.setdefault(first + k, {})[item] = (share, at)
    return best


def _search(batches, index: Index):
    for pdf in batches:
        found = held_items(pdf["text"].tolist(), index)
        rows = [(pdf["_row"].iloc[k], index.ids[i], x, at) for k, per in found.items() for i, (x, at) in per.items()]
        yield pd.DataFrame(rows, columns=["_row", "item_id", "overlap", "first_word"]).astype(
            {"item_id": "Int64", "overlap": "float64", "first_word": "int64"})


def item_shards(benchmark: DataFrame, limit: int = MAX_SHARD_BYTES):
    """The items in shards of at most ``limit`` bytes of text (one longer item is
    a shard), in order of item_id; one shard at a time is on the driver."""
    shard, size = [], 0
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    for r in rows:
        n = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if shard and size + n > limit:
            yield shard
            shard, size = [], 0
        shard.append((r["item_id"], r["text"] or ""))
        size += n
    if shard:
        yield shard


def matches(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """(key, item_id, overlap, first_word): the items that each row holds, ``key``
    being a long column of ``docs``; it is null where the row's is."""
    spark = docs.sparkSession
    # The key as text: pandas has no null among longs without rounding the large ones.
    schema = "_row string, item_id long, overlap double, first_word long"
    src = docs.select(F.col(key).cast("long").cast("string").alias("_row"), "text").where(F.col("text").isNotNull())
    out = spark.createDataFrame([], schema)
    for shard in item_shards(benchmark):
        index = spark.sparkContext.broadcast(Index(shard))  # bounded by MAX_SHARD_BYTES
        out = out.unionByName(src.mapInPandas(lambda it, ix=index: _search(it, ix.value), schema))
    return out.select(F.col("_row").cast("long").alias(key), "item_id", "overlap", "first_word")


def _holds(index):
    """Column function: the text holds an item of the broadcast index."""
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        found = held_items(text.tolist(), index.value)
        return pd.Series([k in found for k in range(len(text))], dtype=bool)

    return holds


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item: one filter per index shard, so neither
    texts nor row numbers move."""
    for shard in item_shards(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(shard))  # bounded by MAX_SHARD_BYTES
        docs = docs.where(~_holds(index)("text"))
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), "doc_id")
