"""Benchmark decontamination: n-gram seeds, a bound on the score, then Smith-Waterman alignment of words.

1. Test items are cut into passages of at most PASSAGE words (overlapping by half). The benchmark is taken in
   slices of at most SLICE_WORDS words, so what is broadcast has a fixed bound; a larger benchmark takes more
   passes over the texts.
2. One pass finds the passages' n-grams in each text. Every n-gram is a seed, however many documents hold it,
   so no leak is lost because it is frequent or edited. A window around seeds is aligned only if it has enough
   of the passage's words for the score asked for (matches cannot be more than the words in common), which
   phrases that every text has seldom reach. Where a text meets many passages, those that have too few words
   anywhere in the text are left out first, all in one pass.
3. The words of the windows are aligned with the passage (match 2, mismatch and gap -1). A text is contaminated
   by an item if the best alignment reaches `least` of the score that the whole passage has, which allows for
   about one word in three being edited, if n consecutive words are left anywhere.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z, so punctuation
doesn't count.

Defined results: null or empty texts and items match nothing, nor do items of fewer than n words (too little to
tell); repeated rows of a document or item give one row a pair, the best, ties to the earlier place; texts of
any length are searched whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, buffers, by_ids, text_of
from waymark.llm.words import ALNUM, ngrams, words

N, PASSAGE, SLICE_WORDS = 4, 256, 1_000_000


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of a in b, and its first and last place + 1 in b."""
    here = np.arange(len(b) + 1)
    rows = [np.zeros(len(b) + 1, np.int64)]
    for x in a:
        up = rows[-1]
        t = np.zeros(len(b) + 1, np.int64)
        t[1:] = np.maximum(up[:-1] + np.where(b == x, 2, -1), up[1:] - 1)
        np.maximum(t, 0, out=t)
        rows.append(np.maximum.accumulate(t + here) - here)  # gaps along b
    h = np.array(rows)
    i, j = np.unravel_index(int(np.argmax(h)), h.shape)
    best, end = int(h[i, j]), int(j)
    while h[i, j] > 0:
        if i and j and h[i, j] == h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return best, int(j), end


class Seeds:
    """Sorted n-grams of a slice of the benchmark, and where each stands in the passages."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n = n
        col = pa.array([t for _, t in items], pa.string())
        h, rows, _, _ = words(*buffers(col), ALNUM)
        self.passages: list[tuple[int, np.ndarray]] = []
        grams, where = [], []
        for (item, _), a, b in zip(items, rows[:-1], rows[1:], strict=True):
            step = PASSAGE // 2
            for s in range(a, max(a + 1, b - step), step) if b - a > PASSAGE else [a]:
                p = h[s : min(s + PASSAGE, b)]
                if len(p) < n:
                    continue
                g, at, _ = ngrams(p, np.array([0, len(p)]), n, short=False)
                grams.append(g)
                where.append(np.stack([np.full(len(g), len(self.passages)), at], 1))
                self.passages.append((item, p))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        w = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(g, kind="stable")
        self.all, self.where = g[order], w[order]
        self.grams, self.first = np.unique(self.all, return_index=True)
        self.last = np.append(self.first[1:], len(self.all))
        # the passages' words one after another, for bounds on many passages at once
        self.lengths = np.array([len(a) for _, a in self.passages], np.int64)
        self.vocabulary, self.flat = np.unique(np.concatenate([a for _, a in self.passages]) if self.passages else np.zeros(0, np.uint64), return_inverse=True)
        bits = max(18, int(len(self.grams) * 64).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.flag = np.zeros(1 << bits, bool)
        self.flag[self.grams & self.mask] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in g, n-gram numbers) of g's members that are seeds."""
        at = np.flatnonzero(self.flag[g & self.mask])
        if not len(at):
            return at, at
        k = np.searchsorted(self.grams, g[at]).clip(max=len(self.grams) - 1)
        hit = self.grams[k] == g[at]
        return at[hit], k[hit]


    def possible(self, h: np.ndarray, least: float) -> np.ndarray:
        """Whether each passage has enough words that stand anywhere in a document with the words h."""
        there = np.zeros(len(self.vocabulary), bool)
        each = np.unique(h)
        k = np.searchsorted(self.vocabulary, each).clip(max=len(self.vocabulary) - 1)
        there[k[self.vocabulary[k] == each]] = True
        begin = np.cumsum(self.lengths) - self.lengths
        return np.add.reduceat(there[self.flat].astype(np.int64), begin) >= least * self.lengths


MANY = 64


def matches(seeds: Seeds, h: np.ndarray, hits: list[tuple[int, int]], least: float) -> dict[int, tuple[float, int, int]]:
    """item -> (share, first word, last word + 1) in one document's words h; hits: (place, n-gram number)."""
    by: dict[int, list[int]] = {}
    for at, k in hits:
        for p, i in seeds.where[seeds.first[k] : seeds.last[k]].tolist():
            by.setdefault(p, []).append(at - i)
    out: dict[int, tuple[float, int, int]] = {}
    if len(by) > MANY:  # a phrase that many items have: one pass over the slice's words bounds all of them
        can = seeds.possible(h, least)
        by = {p: found for p, found in by.items() if can[p]}
    for p, found in by.items():
        item, a = seeds.passages[p]
        held, times = np.unique(a, return_counts=True)
        pad = max(4, len(a) // 4)
        found.sort()
        groups = [[found[0], found[0]]]
        for start in found[1:]:
            if start - groups[-1][1] <= pad:
                groups[-1][1] = start
            else:
                groups.append([start, start])
        for low, high in groups:
            # a run of seeds may spread over repeated copies: cut it so that no table grows with the text
            for s in range(low, high + 1, 2 * len(a) + pad):
                e = min(high, s + 2 * len(a) + pad - 1)
                begin = max(0, s - pad)
                window = h[begin : e + len(a) + pad]
                k = np.searchsorted(held, window).clip(max=len(held) - 1)
                common = np.bincount(k[held[k] == window], minlength=len(held))
                if np.minimum(common, times).sum() / len(a) < least:  # the score is 2 a match at most
                    continue
                score, first, last = align(a, window)
                share = score / (2 * len(a))
                if share >= least and (item not in out or (-share, begin + first) < (-out[item][0], out[item][1])):
                    out[item] = (share, begin + first, begin + last)
    return out


SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"


def _slice(docs: DataFrame, items: list[tuple[int, str]], least: float) -> DataFrame | None:
    seeds = Seeds(items)
    if not seeds.passages:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(seeds)  # bounded by SLICE_WORDS

    def run(batches):
        seeds = shared.value
        for batch, data, off in blocks(batches):
            h, rows, _, _ = words(data, off, ALNUM)
            g, first, cut = ngrams(h, rows, seeds.n, short=False)
            at, k = seeds.find(g)
            doc = np.searchsorted(cut, at, "right") - 1
            ids, out = batch.column("doc_id"), []
            for d in np.unique(doc):
                own = doc == d
                found = matches(seeds, h[rows[d] : rows[d + 1]], list(zip((first[at[own]] - rows[d]).tolist(), k[own].tolist(), strict=True)), least)
                out += [(ids[int(d)].as_py(), item, *x) for item, x in found.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return text_of(docs).mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """One row a contaminated (document, item): score is the alignment's share of a whole passage's score;
    first_word and last_word (exclusive) are its place among the document's words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-size // (4 * SLICE_WORDS)) or 1
    parts = []
    for s in range(int(slices)):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(int(slices))) == s).orderBy("item_id", "text").collect()  # bounded: about 4 MB of text
        parts.append(_slice(docs, [(r["item_id"], r["text"]) for r in rows], least))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.first_word", "b.last_word")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns of documents, that no test item has leaked into."""
    bad = leaks(docs, benchmark, least).select("doc_id").distinct()
    return by_ids(docs, bad, "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
