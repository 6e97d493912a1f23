"""License scans: an exact set-similarity join of text blocks with licence templates.

A template is a licence statement or a whole licence text, as a set of words; a block is a run of 2 m consecutive words taken
every m words, m being the template's words, so that any m consecutive words of a text lie within a block.
A block meets a template if it holds at least `percent` of its distinct words.

1. One pass counts in how many documents each template word occurs; the words are ordered by that, rarest
   first. The counts are as many as the templates have words, whatever the corpus.
2. Prefix filter: a block that meets a template T with need = ceil(percent |T| / 100) has one of T's
   |T| - need + 1 rarest words, so only blocks around such words are looked at. Length filter: a block with
   fewer than `need` distinct words (of any kind) can't meet T. Positional filter: the first common word's place
   in either order bounds what can still be common. What remains is counted exactly: every block that meets a
   template gives its label, also where related licences share most words; `best` is the label that fits best.

Beside it, the base phrases are found where their words stand consecutively.

Defined results: null and empty texts have no words, no labels and score 0. Texts of any length are scanned
whole; repeated rows are each scanned; a null doc_id stays; other columns are ignored. The score is 1 for a
base phrase, else the largest share of a template's words in a block that meets it, else 0. best: a base phrase
counts as a share of 1; ties go to more words in common, then to the first label; null without labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, text_of
from waymark.llm.license_texts import PHRASES, TEMPLATES
from waymark.llm.words import ALNUM, word_hash, words

@dataclass
class Plan:
    """Word numbers, templates as sorted ranks, and prefixes: rank 0 is the rarest word."""

    hashes: np.ndarray
    labels: list[str]
    spans: list[int]
    sets: list[np.ndarray]
    needs: list[int]
    phrases: list[tuple[str, list[int]]]
    flag: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))

    def number(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for words of no template or phrase."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.flag[h & np.uint64(0xFFFF)])
        order = np.argsort(self.hashes)
        at = np.searchsorted(self.hashes[order], h[maybe]).clip(max=len(order) - 1)
        hit = self.hashes[order][at] == h[maybe]
        out[maybe[hit]] = order[at[hit]]
        return out


def plan(templates, phrases, percent: int, counts: dict[int, int]) -> Plan:
    every = sorted({w for _, t in templates for w in t.split()} | {w for p, _ in phrases for w in p.split()}, key=lambda w: (counts.get(word_hash(w), 0), w))
    rank = {w: i for i, w in enumerate(every)}
    sets = [np.array(sorted({rank[w] for w in t.split()})) for _, t in templates]
    out = Plan(np.array([word_hash(w) for w in every], np.uint64), [n for n, _ in templates], [len(t.split()) for _, t in templates], sets, [-(-percent * len(s) // 100) for s in sets], [(n, [rank[w] for w in p.split()]) for p, n in phrases])
    out.flag[out.hashes & np.uint64(0xFFFF)] = True
    return out


def word_counts(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> dict[int, int]:
    """In how many documents each word of the templates occurs, over all documents."""
    base = plan(templates, phrases, 100, {})

    def run(batches):
        total = np.zeros(len(base.hashes), np.int64)
        for _, data, off in blocks(batches):
            h, rows, _, _ = words(data, off, ALNUM)
            k = base.number(h)
            at = np.flatnonzero(k >= 0)
            doc = np.searchsorted(rows, at, "right") - 1
            total += np.bincount(np.unique(doc * len(total) + k[at]) % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(base.hashes.view(np.int64)), pa.array(total)], names=["word", "n"])

    rows = text_of(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    return {r["word"] & ((1 << 64) - 1): r["n"] for r in rows}


def block_matches(p: Plan, k: np.ndarray, h: np.ndarray) -> list[tuple[float, int, str]]:
    """(share, words in common, label) of the blocks of one document that meet a template; k and h: the ranks and
    the hashes of its words."""
    out = []
    for label, m, t, need in zip(p.labels, p.spans, p.sets, p.needs, strict=True):
        prefix = t[: len(t) - need + 1]
        at = np.flatnonzero((k >= 0) & np.isin(k, prefix))
        if not len(at):
            continue
        for b in np.unique(np.concatenate([at // m, np.maximum(at // m - 1, 0)])):
            block = slice(b * m, (b + 2) * m)
            if len(k[block]) < need or len(np.unique(h[block])) < need:  # length filter
                continue
            ranks = np.unique(k[block])
            ranks = ranks[ranks >= 0]
            first = np.flatnonzero(np.isin(ranks, t, assume_unique=True))
            if not len(first):
                continue
            i = int(np.searchsorted(t, ranks[first[0]]))
            if min(len(t) - i, len(ranks) - int(first[0])) < need:  # positional filter
                continue
            if len(first) >= need:
                out.append((len(first) / len(t), len(first), label))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, best string"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = 80) -> DataFrame:
    p = plan(templates, phrases, percent, word_counts(docs, templates, phrases))
    telling = np.unique(np.concatenate([t[: len(t) - need + 1] for t, need in zip(p.sets, p.needs, strict=True)]))

    def run(batches):
        told = np.zeros(len(p.hashes) + 1, bool)
        told[telling] = True  # at -1: False
        for batch, data, off in blocks(batches):
            h, rows, _, _ = words(data, off, ALNUM)
            n, k = batch.num_rows, p.number(h)
            counts, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            base: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            found: dict[int, list[tuple[float, int, str]]] = {}
            for label, ranks in p.phrases:
                at = np.flatnonzero(k[: max(0, len(k) - len(ranks) + 1)] == ranks[0])
                for i, r in enumerate(ranks[1:], 1):
                    at = at[k[at + i] == r]
                doc = np.searchsorted(rows, at, "right") - 1
                whole = at + len(ranks) <= rows[doc + 1]
                at, doc = at[whole], doc[whole]
                np.add.at(counts, doc, 1)
                np.minimum.at(first, doc, at - rows[doc])
                np.maximum.at(last, doc, at - rows[doc])
                for d in set(doc.tolist()):
                    base[d].add(label)
                    found.setdefault(d, []).append((1.0, len(ranks), label))
            for d in np.unique(np.searchsorted(rows, np.flatnonzero(told[k]), "right") - 1):
                for x in block_matches(p, k[rows[d] : rows[d + 1]], h[rows[d] : rows[d + 1]]):
                    labels[d].add(x[2])
                    found.setdefault(int(d), []).append(x)
            top = [min(found[d], key=lambda x: (-x[0], -x[1], x[2])) if d in found else (0.0, 0, None) for d in range(n)]
            none = counts == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(counts),
                pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(b)) for b in base], pa.string()),
                pa.array([",".join(sorted(a | b)) for a, b in zip(base, labels, strict=True)], pa.string()),
                pa.array([x[0] for x in top], pa.float64()), pa.array([x[2] for x in top], pa.string()),
            ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "best"])

    return text_of(docs).mapInArrow(run, SCHEMA)
