"""Tokens, accents, snippets and BM25 arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Latin letters with accents and what they fold to
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED + ACCENTED.upper().replace("Ÿ", ""), PLAIN + PLAIN[:-1].upper())


def idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((docs - df + 0.5) / (df + 0.5)))


def bm25_part(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    """A phrase's share of the score; larger is better."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def power(score: Column) -> Column:
    """0 to 100."""
    return (1 - F.exp(-0.1 * F.greatest(F.lit(0.0), score))) * 100


def truncated(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def snippet(text: Column, words: list[str], width: int) -> Column:
    """The run of `width` words with most different query words (the first such), matches marked.

    Runs begin at a matching word, or so that they end with the text; words are separated by white space and
    matched by their tokens.
    """
    wanted = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")

    def marked(parts: Column, hits: Column, at: Column) -> Column:
        shown = F.transform(F.slice(F.arrays_zip(parts.alias("p"), hits.alias("h")), at, width), lambda z: F.when(F.size(z["h"]) > 0, F.concat(F.lit("<mark>"), z["p"], F.lit("</mark>"))).otherwise(z["p"]))
        return F.concat(F.when(at > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(at + width <= F.size(parts), "...").otherwise(""))

    def best(parts: Column, hits: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(parts) - width + 1)
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.size(F.get(hits, i - 1)) > 0)
        scored = F.transform(starts, lambda i: F.struct(F.size(F.array_distinct(F.flatten(F.slice(hits, i, width)))).alias("n"), (-F.least(i, last)).alias("s")))
        return F.coalesce(-F.array_max(scored)["s"], F.lit(1))

    return _let(F.split(F.trim(text), r"\s+"), lambda parts: _let(F.transform(parts, lambda p: F.array_intersect(tokens(p), wanted)), lambda hits: _let(best(parts, hits), lambda at: marked(parts, hits, at))))


def query_phrases(query: str) -> list[list[str]]:
    """Words of a query, each a phrase of one or more adjacent tokens; all must match."""
    import re

    found = ([t for t in re.split(r"[\W_]+", w.lower()) if t] for w in query.split())
    return [p for p in found if p]
