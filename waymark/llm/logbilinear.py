"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Words are runs without ASCII white space, A-Z as a-z; every text ends with one end token.

1. Counts of all words of all training texts, as a distributed table keyed by a 64-bit word hash. N and V
   come from it. Words with at least the count that leaves HEAD of them or fewer are broadcast; all others
   are joined from the table, so every count is exact.
2. The log-bilinear model has the V most frequent words, V growing with the square root of the training tokens
   (WIDTH times that, HEAD at most, which bounds the broadcast): each has vectors of its own as context and as
   output. A context of two words predicts r = R[w1] C1 + R[w2] C2, and the score of w is r . Q[w] + b[w]. Words
   are in about sqrt(V) classes by frequency, classes have scores of the same form, and rarer words and the end
   are a class each. Words and classes are trained by noise-contrastive AdaGrad.
3. Every training text is used. Texts are dealt to shards of about SHARD bytes by a hash, so a shard, its order and
   its model are the same however the input is partitioned; each starts from the same parameters, and these are
   averaged by a plain aggregate, every word's weighted by its occurrences.
4. Scores: normalised log10 probabilities, of the class given the context times the word given class and context,
   each by batched matrix products: about 2 sqrt(V) outputs a token. A rarer word has its class's probability
   times (c + 0.1) / (N' + 0.1 (V' + 1)), N' and V' being the rarer words' tokens and number: over all words,
   known or not, the probabilities sum to 1.

Defined results: null and empty texts consist of the end token. Repeated rows are scored each. A null doc_id
is neither learnt from nor held out. Without training texts the base score is 0 and the model's that of its
start. Texts of any length are used whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, bucket, drop, materialize, text_of
from waymark.llm.words import SPACED, words

END = 0x5EED0E0D5EED0E0D  # the end token's key
WIDTH, LEAST, HEAD, SHARD = 4.0, 1022, 1 << 20, 16 << 20
DIM, NOISE, BATCH, RATE = 16, 32, 2048, 0.2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all whole texts, end tokens included."""

    def run(batches):
        held, size = [], 0

        def flush():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])

        for batch, data, off in blocks(batches):
            held += [words(data, off, SPACED)[0], np.full(batch.num_rows, END, np.uint64)]
            size += len(held[-2]) + len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The frequent words with their counts; rank gives the model's number of a word (-1: not one of its words)."""

    words: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    total: int
    distinct: int
    outputs: int  # words of the model; then follow the rarer words, the end, and as context the start
    rare_total: int
    rare_distinct: int
    noise: np.ndarray  # shares of the model's words, the rarer words and the end

    def __post_init__(self):
        self.side = max(1, int(np.ceil(self.outputs**0.5)))  # words a class
        self.classes = -(-self.outputs // self.side)

    def class_of(self, t: np.ndarray) -> np.ndarray:
        return np.where(t < self.outputs, t // self.side, self.classes + t - self.outputs)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in the table, found) of each word."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        each, where = np.unique(h, return_inverse=True)  # in order the table is read once, not at random
        at = np.searchsorted(self.words, each).clip(max=len(self.words) - 1)
        return at[where], (self.words[at] == each)[where]

    def numbers(self, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.outputs, np.int32)
        if len(self.rank):
            r = self.rank[at]
            out = np.where(hit & (r >= 0), r, self.outputs).astype(np.int32)
        return out


def head_of(counts: DataFrame, most: int = HEAD, width: float = WIDTH) -> Head:
    size = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(size[0] or 0), int(size[1])
    vocabulary = max(LEAST, int(width * total**0.5))
    least = 1
    if distinct > most:
        # words by the count's power of 2**(1/8): a few hundred rows
        steps = counts.groupBy(F.ceil(F.log2("c") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
        taken = 0
        for r in steps:
            if taken + r["count"] > most:
                break
            taken, least = taken + r["count"], r["step"]
        got = counts.where(F.ceil(F.log2("c") * 8) >= least)
    else:
        got = counts
    got = got.toArrow()  # at most `most` rows of 16 bytes
    w, c = got["word"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(w)
    w, c = w[order], c[order]
    best = np.lexsort([w, -c])
    best = best[w[best] != np.uint64(END)][:vocabulary]
    rank = np.full(len(w), -1, np.int32)
    rank[best] = np.arange(len(best))
    ends = int(c[w == np.uint64(END)].sum())
    rare = total - int(c[best].sum()) - ends
    noise = np.concatenate([c[best], [max(rare, 0), ends]]).astype(float) + 1
    return Head(w, c, rank, total, distinct, len(best), rare, max(0, distinct - len(best) - (ends > 0)), noise / noise.sum())


@dataclass
class Params:
    R: np.ndarray  # contexts: words, rarer words, the end (never one), the start
    C1: np.ndarray
    C2: np.ndarray
    Q: np.ndarray  # words
    b: np.ndarray
    S: np.ndarray  # classes
    c: np.ndarray

    def copy(self) -> Params:
        return Params(*(x.copy() for x in vars(self).values()))


def start(head: Head, seed: int = 7) -> Params:
    """At first about the words' own frequencies."""
    rng = np.random.Generator(np.random.PCG64(seed))
    eye, v = np.eye(DIM), head.outputs
    share = np.bincount(head.class_of(np.arange(v + 2)), head.noise, head.classes + 2)
    arrays = rng.normal(0, 0.3, (v + 3, DIM)), eye * 0.6, eye * 0.4, rng.normal(0, 0.03, (v, DIM)), np.log(head.noise[:v]), rng.normal(0, 0.03, (len(share), DIM)), np.log(share)
    return Params(*(x.astype(np.float32) for x in arrays))


def contexts(ids: np.ndarray, rows: np.ndarray, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, word before, word before that) of all tokens of all rows, ends included."""
    n = np.diff(rows)
    t = np.full(len(ids) + len(n), outputs + 1, np.int32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
    t[at] = ids
    begin = rows[:-1] + np.arange(len(n))
    w1 = np.empty_like(t)
    w1[0:1], w1[1:] = outputs + 2, t[:-1]
    w1[begin] = outputs + 2
    w2 = np.empty_like(t)
    w2[0:1], w2[1:] = outputs + 2, w1[:-1]
    w2[begin] = outputs + 2
    return t, w1, w2


def _rows(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once, with the sum of its rows of g."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[cut], np.add.reduceat(g[order], cut, axis=0)


class Noise:
    """Draws by share, and the log of the expected number of each in a draw of NOISE."""

    def __init__(self, share: np.ndarray):
        share = share / share.sum()
        self.cum, self.log = np.cumsum(share), np.log(NOISE * share).astype(np.float32)

    def draw(self, rng) -> np.ndarray:
        return np.searchsorted(self.cum, rng.random(NOISE) * self.cum[-1]).clip(max=len(self.cum) - 1)


class Trainer:
    def __init__(self, params: Params, head: Head, seed: int = 11):
        self.p, self.head = params.copy(), head
        self.sq = Params(*(np.full_like(x, 1e-4) for x in vars(params).values()))
        v = head.outputs
        self.words = Noise(head.noise[:v]) if v else None
        self.classes = Noise(np.bincount(head.class_of(np.arange(v + 2)), head.noise, head.classes + 2))
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.seen, self.classed, self.all = np.zeros(v + 3, np.int64), np.zeros(head.classes + 2, np.int64), 0

    def _contrast(self, r, t, Q, b, noise: Noise):
        """Gradients for r, and for the rows of Q and b by target and noise."""
        ns = noise.draw(self.rng)
        qt, qn = Q[t], Q[ns]
        pos = np.einsum("ij,ij->i", r, qt) + b[t] - noise.log[t]
        neg = r @ qn.T + (b[ns] - noise.log[ns])
        with np.errstate(over="ignore"):  # infinity gives the right limit
            gp = -1 / (1 + np.exp(pos))
            np.exp(neg, out=neg)
        neg += 1
        gn = 1 - 1 / neg
        at = np.concatenate([t, ns])
        g = np.concatenate([np.column_stack([gp[:, None] * r, gp]), np.column_stack([gn.T @ r, gn.sum(0)])])
        return gp[:, None] * qt + gn @ qn, *_rows(at, g)

    def _move(self, name: str, g, at=slice(None)) -> None:
        x, s = getattr(self.p, name), getattr(self.sq, name)
        s[at] += g * g
        x[at] -= RATE * g / np.sqrt(s[at])

    def step(self, t, w1, w2) -> None:
        p, v, n = self.p, self.head.outputs, len(t)
        r1, r2 = p.R[w1], p.R[w2]
        r = r1 @ p.C1 + r2 @ p.C2
        k = self.head.class_of(t)
        dr, at, g = self._contrast(r, k, p.S, p.c, self.classes)
        moves = [("S", g[:, :-1], at), ("c", g[:, -1], at)]
        word = np.flatnonzero(t < v)
        if len(word):
            dw, at, g = self._contrast(r[word], t[word], p.Q, p.b, self.words)
            dr[word] += dw
            moves += [("Q", g[:, :-1], at), ("b", g[:, -1], at)]
        at, g = _rows(np.concatenate([w1, w2]), np.concatenate([dr @ p.C1.T, dr @ p.C2.T]))
        moves += [("R", g, at), ("C1", r1.T @ dr, slice(None)), ("C2", r2.T @ dr, slice(None))]
        for name, g, at in moves:
            self._move(name, g / n, at)
        for x in (t, w1):
            self.seen += np.bincount(x, minlength=v + 3)
        self.classed += np.bincount(k, minlength=len(self.classed))
        self.all += n

    def learn(self, t, w1, w2) -> None:
        turn = self.rng.permutation(len(t))
        for i in range(0, len(t), BATCH):
            k = turn[i : i + BATCH]
            self.step(t[k], w1[k], w2[k])

    def rows(self) -> pa.RecordBatch:
        """i, weight and values times weight: the words seen (R, Q, b), the classes seen (-, S, c), then C1 and C2."""
        p, v = self.p, self.head.outputs
        words, classes = np.flatnonzero(self.seen), np.flatnonzero(self.classed)
        own = np.minimum(words, max(v - 1, 0))
        q = np.where((words < v)[:, None], np.column_stack([p.Q, p.b])[own], 0) if v else np.zeros((len(words), DIM + 1))
        i = np.concatenate([words, v + 3 + classes, v + 3 + len(p.S) + np.arange(DIM)])
        w = np.concatenate([self.seen[words], self.classed[classes], np.full(DIM, self.all)]).astype(float)
        x = np.concatenate([np.column_stack([p.R[words], q]), np.column_stack([np.zeros((len(classes), DIM)), p.S[classes], p.c[classes]]), np.column_stack([p.C1, p.C2, np.zeros(DIM)])]) * w[:, None]
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w), *(pa.array(np.ascontiguousarray(c, np.float32)) for c in x.T)], names=["i", "w", *COLUMNS])


COLUMNS = [f"x{k}" for k in range(2 * DIM + 1)]


def merged(init: Params, rows: pa.Table) -> Params:
    """The rows' averages; what no shard has seen stays as at the start."""
    out, n, m = init.copy(), len(init.R), len(init.S)
    i = rows["i"].to_numpy()
    x = np.column_stack([rows[c].to_numpy() for c in COLUMNS])
    a, at = i < n, i[i < n]
    out.R[at] = x[a, :DIM]
    at = at[at < len(out.Q)]
    out.Q[at], out.b[at] = x[i < len(out.Q), DIM:-1], x[i < len(out.Q), -1]
    a = (i >= n) & (i < n + m)
    out.S[i[a] - n], out.c[i[a] - n] = x[a, DIM:-1], x[a, -1]
    a = i >= n + m
    out.C1[i[a] - n - m], out.C2[i[a] - n - m] = x[a, :DIM], x[a, DIM:-1]
    return out


def train(docs: DataFrame, head: Head) -> Params:
    """The shards' parameters, averaged."""
    spark = docs.sparkSession
    init = start(head)
    shared = spark.sparkContext.broadcast((head, init))  # bounded by HEAD
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(size // SHARD) + 1

    def run(batches):
        head, init = shared.value
        trainer, now = None, None
        for batch, data, off in blocks(batches):
            shard = batch.column("shard").to_numpy()
            h, rows, _, _ = words(data, off, SPACED)
            ids = head.numbers(*head.find(h))
            cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if shard[i] != now:
                    if trainer is not None:
                        yield trainer.rows()
                    trainer, now = Trainer(init, head), shard[i]
                trainer.learn(*contexts(ids[rows[i] : rows[j]], rows[i : j + 1] - rows[i], head.outputs))
        if trainer is not None:
            yield trainer.rows()

    turn = F.xxhash64("doc_id", "text")
    dealt = docs.select("text", F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn")).repartitionById(shards, "shard").sortWithinPartitions("shard", "turn").select("text", "shard")
    got = dealt.mapInArrow(run, f"i int, w double, {', '.join(f'{c} float' for c in COLUMNS)}").groupBy("i").agg(F.sum("w").alias("w"), *(F.sum(c).alias(c) for c in COLUMNS))
    got = got.select("i", *((F.col(c) / F.col("w")).cast("float").alias(c) for c in COLUMNS)).toArrow()  # a row a word and class of the model
    return merged(init, got) if len(got) else init


def _log_share(r: np.ndarray, outputs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log share of own among the outputs of each row of r, in slices that stay in the cache."""
    got = np.empty(len(r))
    for i in range(0, len(r), 4096):
        part = slice(i, i + 4096)
        s = r[part] @ outputs
        with np.errstate(over="ignore"):
            z = np.exp(s).sum(1)
        if not (np.isfinite(z).all() and z.min() > 1e-30):
            top = s.max(1, keepdims=True)
            s -= top
            z = np.exp(s).sum(1)
        got[part] = s[np.arange(len(s)), own[part]] - np.log(z)
    return got


class Model:
    """Normalised log10 probabilities."""

    def __init__(self, params: Params, head: Head):
        self.head = head
        one = lambda x, last: np.column_stack([x, np.full(len(x), last, np.float32)])
        self.first, self.second = one(params.R @ params.C1, 1), one(params.R @ params.C2, 0)
        self.classes, self.words = np.column_stack([params.S, params.c]).T, np.column_stack([params.Q, params.b]).T

    def log10(self, t, w1, w2) -> np.ndarray:
        """Of the class, and for the model's words of the word in its class."""
        side, out = self.head.side, np.empty(len(t))
        for i in range(0, len(t), 1 << 17):
            part = slice(i, i + (1 << 17))
            r, own, k = self.first[w1[part]] + self.second[w2[part]], t[part], self.head.class_of(t[part])
            got = _log_share(r, self.classes, k)
            order = np.argsort(k, kind="stable")
            cut = np.searchsorted(k[order], np.arange(self.head.classes + 1))
            for c in np.flatnonzero(np.diff(cut)):
                at = order[cut[c] : cut[c + 1]]
                got[at] += _log_share(r[at], self.words[:, c * side : (c + 1) * side], own[at] - c * side)
            out[part] = got
        return out / np.log(10)


LOCAL = "rid long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>"


def score(docs: DataFrame, head: Head, params: Params | None, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs (doc_id and text); without params the
    score is null."""
    shared = docs.sparkSession.sparkContext.broadcast((head, params))  # bounded by HEAD
    d = head.total + 0.1 * (head.distinct + 1)
    rare_d = head.rare_total + 0.1 * (head.rare_distinct + 1)

    def run(batches):
        from pyspark import TaskContext

        head, params = shared.value
        model, rid = Model(params, head) if params else None, TaskContext.get().partitionId() << 33
        gain = np.log10((head.counts + 0.1) / d)
        rare_gain = np.log10((head.counts + 0.1) / rare_d)
        at, hit = head.find(np.array([END], np.uint64))
        end_known, end_gain = bool(hit[0]), float(gain[at[0]]) if hit[0] else np.log10(0.1 / d)
        for batch, data, off in blocks(batches):
            h, rows, _, _ = words(data, off, SPACED)
            at, hit = head.find(h)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            m = batch.num_rows
            known = np.bincount(doc[hit], minlength=m) + end_known
            base = np.bincount(doc[hit], gain[at[hit]] if len(gain) else None, m) + end_gain
            whole = np.full(m, np.nan)
            if model:
                t, w1, w2 = contexts(head.numbers(at, hit), rows, head.outputs)
                whole = np.bincount(np.repeat(np.arange(m), np.diff(rows) + 1), model.log10(t, w1, w2), m)
            near = np.flatnonzero(hit)
            near = near[head.rank[at[near]] < 0]
            whole += np.bincount(doc[near], rare_gain[at[near]] if len(gain) else None, m)
            far = np.flatnonzero(~hit)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, rows).astype(np.int32)), pa.array(h[far].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + m)), batch.column("doc_id"), pa.array((np.diff(rows) + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(whole), lists], names=["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])
            rid += m

    local, _ = materialize(docs.mapInArrow(run, LOCAL), "scores")
    far = local.select("rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    far = far.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), (c > 0).cast("long").alias("n_known"), F.log10((c + 0.1) / d).alias("base"), F.log10((c + 0.1) / rare_d).alias("score"))
    both = local.drop("rare").union(far).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    return both.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score" if params else F.lit(None).cast("double").alias("score"))


def language_model(docs: DataFrame, fold: int = 10, fit: bool = True) -> DataFrame:
    """Learn from the texts whose crc32(doc_id) mod `fold` isn't 0 and score all; without `fit` only by the counts."""
    texts = text_of(docs)
    held = F.coalesce(bucket(F.col("doc_id"), fold) == 0, F.lit(False))
    learn = texts.where(bucket(F.col("doc_id"), fold) != 0)
    counts, _ = materialize(count_words(learn), "counts")
    head = head_of(counts)
    params = train(learn, head) if fit else None
    out = score(texts, head, params, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(head.total).cast("long").alias("train_tokens"), "base_score", "score")
