"""Secret scans with trigram indexes.

Each rule is a regular expression. From its syntax tree a Boolean trigram query is derived (a string that
matches must hold these trigrams); every run of documents is a segment with an inverted index from trigram
to the documents that hold it; the query's postings are united and intersected, and only the candidates are
searched with the expression. A rule without mandatory trigrams is searched in every document (a rule that
is one character class with a minimum length is done by run lengths over the whole segment).

Defined results: null text counts as empty; empty text has no spans; repeated rows are each scanned; a very
long text is scanned whole; rows keep their doc_id even if it is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sc
import re._parser as sp
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import blocks, text_of


@dataclass(frozen=True)
class Rule:
    """least: the fewest bytes of group `group` in a match; shorter matches are dropped after the search."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$&*+=-]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

# --- trigram queries: None (anything), ("all", [...]), ("any", [...]) or a trigram (bytes) ---

_MOST = 64  # exact sets larger than this are turned into queries


def _and(a, b):
    if a is None or b is None or a == b:
        return b if a is None else a
    return ("all", [*(a[1] if isinstance(a, tuple) and a[0] == "all" else [a]), *(b[1] if isinstance(b, tuple) and b[0] == "all" else [b])])


def _or(qs):
    qs = list({repr(q): q for q in qs}.values())
    if not qs or any(q is None for q in qs):
        return None
    return qs[0] if len(qs) == 1 else ("any", qs)


def _strings(exact: set[bytes]):
    """What holds for a text that contains one of these strings."""
    def one(s: bytes):
        q = None
        for i in range(len(s) - 2):
            q = _and(q, s[i : i + 3])
        return q
    return _or(one(s) for s in exact)


def _chars(node) -> set[bytes] | None:
    """The bytes that one item can match, if they are few."""
    op, arg = node
    if op is sc.LITERAL:
        return {bytes([arg])} if arg < 128 else None
    if op is sc.IN:
        out: set[bytes] = set()
        for kind, x in arg:
            if kind is sc.LITERAL and x < 128:
                out.add(bytes([x]))
            elif kind is sc.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                out |= {bytes([c]) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _analyse(seq) -> tuple[set[bytes] | None, object]:
    """(all strings that seq can match, if few; a query that holds for every text in which seq matches)."""
    exact: set[bytes] | None = {b""}
    query = None

    def close():
        nonlocal exact, query
        if exact is not None:
            query = _and(query, _strings(exact))
        exact = {b""}

    known = True
    for op, arg in seq:
        if (few := _chars((op, arg))) is not None:
            part, q = few, None
        elif op is sc.SUBPATTERN:
            part, q = _analyse(arg[3])
        elif op is sc.BRANCH:
            got = [_analyse(x) for x in arg[1]]
            part = set().union(*(x[0] for x in got)) if all(x[0] is not None for x in got) else None
            q = None if part is not None else _or(_and(x[1], _strings(x[0]) if x[0] is not None else None) for x in got)
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, body = arg
            part, q = _analyse(body)
            if part is not None and low == 0 and high == 1:
                part |= {b""}
            elif part is not None and low == high and len(part) ** low <= _MOST:
                whole = {b""}
                for _ in range(low):
                    whole = {a + b for a in whole for b in part}
                part = whole
            else:
                q = _and(q, _strings(part) if part is not None else None) if low else None
                part = None
        else:
            part, q = None, None
        query = _and(query, q)
        if part is None:
            close()
            known = False
            continue
        if len(exact) * len(part) > _MOST:
            # keep two bytes on, so that trigrams across the cut still count
            query = _and(query, _strings(exact))
            exact, known = {s[-2:] for s in exact}, False
        if len(exact) * len(part) > _MOST * _MOST:
            exact, known = {b""}, False
        exact = {a + b for a in exact for b in part}
    if known:
        return exact, query
    close()
    return None, query


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern; None if it has no mandatory trigram."""
    exact, query = _analyse(sp.parse(pattern))
    return _and(query, _strings(exact)) if exact is not None else query


def trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Inverted index of one segment: trigram -> sorted document numbers, for the wanted trigrams."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wanted: list[bytes], slots: np.ndarray):
        self.docs, self.postings = len(off) - 1, {}
        if len(data) > 2:
            code = slots[(data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]]
            at = np.flatnonzero(code)
            doc = np.searchsorted(off, at, "right") - 1
            inside = at + 3 <= off[doc + 1]
            key = np.unique(code[at[inside]].astype(np.int64) * self.docs + doc[inside])
            which, doc = key // self.docs - 1, key % self.docs
            cut = np.searchsorted(which, np.arange(len(wanted) + 1))
            self.postings = {t: doc[cut[i] : cut[i + 1]] for i, t in enumerate(wanted)}

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.docs)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            if query[0] == "all" and not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "all" else np.union1d(out, p)
        return out


def _class_run(pattern: str) -> np.ndarray | None:
    """The bytes of [class]+, if that is all the pattern is."""
    seq = list(sp.parse(pattern))
    if len(seq) != 1 or seq[0][0] is not sc.MAX_REPEAT or seq[0][1][0] != 1 or seq[0][1][1] is not sc.MAXREPEAT or len(seq[0][1][2]) != 1 or seq[0][1][2][0][0] is not sc.IN:
        return None
    out = np.zeros(256, bool)
    for kind, x in seq[0][1][2][0][1]:
        if kind is sc.LITERAL and x < 128:
            out[x] = True
        elif kind is sc.RANGE and x[1] < 128:
            out[x[0] : x[1] + 1] = True
        else:
            return None
    return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern.encode()) for r in rules]
        self.runs = [_class_run(r.pattern) if r.group == 0 and r.least else None for r in rules]
        self.queries = [None if run is not None else trigram_query(r.pattern) for r, run in zip(rules, self.runs, strict=True)]
        self.wanted = sorted(set().union(*map(trigrams, self.queries)))
        self.slots = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 255 else np.uint16)
        for i, t in enumerate(self.wanted):
            self.slots[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1

    def segment(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per document its spans (start, rule number, end) in bytes, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
        index = Index(data, off, self.wanted, self.slots)
        for k, (rule, rx, run) in enumerate(zip(self.rules, self.compiled, self.runs, strict=True)):
            if run is not None:
                self._long_runs(data, off, run, rule.least, k, found)
                continue
            for d in index.candidates(self.queries[k]):
                raw = data[off[d] : off[d + 1]].tobytes()
                found[d] += [(m.start(), k, m.end()) for m in rx.finditer(raw) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in found]

    @staticmethod
    def _long_runs(data, off, kind, least, k, found) -> None:
        if len(data) < least:
            return
        stop = np.flatnonzero(~kind[data])
        # a byte outside the class or a document's edge ends a run
        low = np.unique(np.concatenate([stop + 1, off[:-1]]))
        high = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, low)], off[np.searchsorted(off, low, "right").clip(max=len(off) - 1)])
        for s, e in zip(low[(keep := high - low >= least)], high[keep], strict=True):
            d = int(np.searchsorted(off, s, "right")) - 1
            found[d].append((int(s - off[d]), k, int(e - off[d])))


def code_points(raw: np.ndarray, at: list[int]) -> list[int]:
    """Code points before each byte offset."""
    if not at:
        return []
    lead = np.cumsum((raw[: max(at)] & 0xC0) != 0x80)
    return [int(lead[x - 1]) if x else 0 for x in at]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans per document: counts and digest of the base rules, and every rule's kind:start:end."""

    def run(batches):
        scanner, order = Scanner(rules), {r.name: i for i, r in enumerate(rules)}
        for batch, data, off in blocks(batches):
            counts = np.zeros((batch.num_rows, 3), np.int64)
            digests, texts = [], []
            for d, found in enumerate(scanner.segment(data, off)):
                points = code_points(data[off[d] : off[d + 1]], [x for s, _, e in found for x in (s, e)])
                named = sorted((points[2 * i], order[rules[k].name], points[2 * i + 1], k) for i, (_, k, _) in enumerate(found))
                for _, _, _, k in named:
                    if rules[k].base:
                        counts[d, ("assign", "access", "hex").index(rules[k].name)] += 1
                digests.append(hashlib.sha256(",".join(f"{rules[k].name}:{s}:{e}" for s, _, e, k in named if rules[k].base).encode()).hexdigest())
                texts.append(",".join(f"{rules[k].name}:{s}:{e}" for s, _, e, k in named))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return text_of(docs).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents' columns with every secret span (overlapping ones merged) replaced by `mark`.

    n_chars follows the new text; documents without secrets, and null texts, are unchanged.
    """

    def run(batches):
        scanner = Scanner(rules)
        for batch, data, off in blocks(batches):
            texts, lengths = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for d, found in enumerate(scanner.segment(data, off)):
                if found:
                    raw, out, at = data[off[d] : off[d + 1]].tobytes(), [], 0
                    merged: list[list[int]] = []
                    for s, _, e in found:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        out += [raw[at:s], mark.encode()]
                        at = e
                    texts[d] = b"".join([*out, raw[at:]]).decode()
                    lengths[d] = len(texts[d])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column("text").type) if n == "text" else pa.array(lengths, pa.int64()) if n == "n_chars" else batch.column(n) for n in names], names=names)

    docs = docs.select("doc_id", "text", "lang", "source", docs["n_chars"].cast("long").alias("n_chars"))
    return docs.mapInArrow(run, docs.schema)
