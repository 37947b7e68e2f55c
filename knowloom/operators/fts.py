"""Full-text search: folded terms, prefix matching, BM25."""

from __future__ import annotations

import functools
import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.session import materialise

COLUMNS = ("subject", "sender", "recipients", "body")
K1, B = 1.2, 0.75
#: Least inverse document frequency; a term in half of all rows or more gets it.
LEAST_IDF = 1e-6


def _fold_table() -> tuple[str, str]:
    """Letters with diacritics and their base letters, from the Unicode decompositions."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def terms(text: Column) -> Column:
    """Lower-case terms without diacritics, cut at everything but letters and digits."""
    plain = F.lower(F.translate(F.regexp_replace(text, r"\p{M}", ""), _FROM, _TO))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold_term(token: str) -> list[str]:
    """Terms of a query token; several form a phrase whose last term is a prefix."""
    plain = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[\W_]+", plain) if t]


#: Positions of one column lie below this, so no phrase runs over from one column to the next.
_COLUMN_SPAN = 1 << 24


def postings(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, message_id, tf, positions) and (message_id, length) of all indexed columns.

    Messages with null columns index the others; one without text has length 0.
    """

    def placed_terms(n: int, c: str) -> Column:
        return F.transform(F.coalesce(terms(F.col(c)), F.array().cast("array<string>")), lambda t, i: F.struct(t.alias("term"), (i + n * _COLUMN_SPAN).alias("at")))

    own = [placed_terms(n, c) for n, c in enumerate(COLUMNS)]
    t = messages.select(F.col("id").alias("message_id"), F.flatten(F.array(*own)).alias("terms"))
    lengths = t.select("message_id", F.size("terms").alias("length"))
    placed = t.select("message_id", F.explode("terms").alias("t")).select("message_id", "t.*")
    return placed.groupBy("term", "message_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions")), lengths


def upsert_postings(old: tuple[DataFrame, DataFrame], changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index with the changed messages indexed anew."""
    new = postings(changed)
    return tuple(o.join(changed.select(F.col("id").alias("message_id")), "message_id", "left_anti").unionByName(n) for o, n in zip(old, new))


def _phrase_count(column: Column, phrase: list[str]) -> Column:
    """Occurrences in a term array of the phrase, its last term as a prefix."""
    k = len(phrase)
    last = phrase[-1]
    if k == 1:
        return F.size(F.filter(column, lambda t: t.startswith(last)))
    at = F.when(F.size(column) >= k, F.sequence(F.lit(0), F.size(column) - k)).otherwise(F.array().cast("array<int>"))

    def fits(i: Column) -> Column:
        ok = F.get(column, i + (k - 1)).startswith(last)
        for j, word in enumerate(phrase[:-1]):
            ok = ok & (F.get(column, i + j) == word)
        return ok

    return F.size(F.filter(at, fits))


def _phrases(tokens: list[str]) -> list[list[str]] | None:
    """Phrases of the tokens; None where the query syntax does not take a token, or for none."""
    if not tokens or any(re.search(r"[@.]", t) for t in tokens):
        return None
    return [p for p in map(fold_term, tokens) if p] or None


def _ranked(counted: DataFrame, n: int, average: float, phrases: int) -> DataFrame:
    """Rank of the messages that hold every phrase, from (message_id, length, tf0, tf1, ...) of those that hold any."""
    counted = materialise(counted)
    df = counted.agg(*(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(phrases))).first()
    rank, match = F.lit(0.0), F.lit(True)
    for i in range(phrases):
        d = df[f"df{i}"] or 0
        idf = math.log((n - d + 0.5) / (d + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        tf = F.col(f"tf{i}").cast("double")
        rank = rank - F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
        match = match & (F.col(f"tf{i}") > 0)
    return counted.filter(match).select("message_id", rank.alias("rank"))


def bm25(messages: DataFrame, tokens: list[str]) -> DataFrame | None:
    """(message_id, rank) of the messages that match every token as a prefix; smaller ranks are better.

    For a table without an index: one scan counts matches beside each row and
    needs no shuffle.  None for no tokens, and where a token holds ``@`` or a dot,
    which the query syntax does not take.  Messages are taken once per id.
    """
    phrases = _phrases(tokens)
    if phrases is None:
        return None
    rows = messages.select(F.col("id").alias("message_id"), *(F.coalesce(terms(F.col(c)), F.array().cast("array<string>")).alias(c) for c in COLUMNS))
    counts = [sum((_phrase_count(F.col(c), p) for c in COLUMNS), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)]
    scored = materialise(rows.select("message_id", sum((F.size(c) for c in COLUMNS), F.lit(0)).alias("length"), *counts))
    n = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    return _ranked(scored, n["n"], n["avg"], len(phrases))


def _earlier(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def bm25_of_index(index: tuple[DataFrame, DataFrame], tokens: list[str]) -> DataFrame | None:
    """The same from an index of ``postings``: only the terms that the tokens begin are read, by their prefixes."""
    phrases = _phrases(tokens)
    if phrases is None:
        return None
    terms_of, lengths = index
    holds = lambda p, j: F.col("term").startswith(p[j]) if j == len(p) - 1 else F.col("term") == p[j]
    wanted = [holds(p, j) for p in phrases for j in range(len(p))]
    some = terms_of.filter(functools.reduce(lambda a, b: a | b, wanted))
    counts = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            counts.append(F.coalesce(F.sum(F.when(holds(p, 0), F.col("tf"))), F.lit(0)).alias(f"tf{i}"))
        else:
            at = [F.flatten(F.collect_list(F.when(holds(p, j), F.col("positions")))) for j in range(len(p))]
            shifted = functools.reduce(F.array_intersect, [_earlier(x, j) for j, x in enumerate(at)])
            counts.append(F.size(shifted).alias(f"tf{i}"))
    n = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    return _ranked(some.groupBy("message_id").agg(*counts).join(lengths, "message_id"), n["n"], n["avg"], len(phrases))


def boosts(source: DataFrame | tuple[DataFrame, DataFrame], tokens: list[str], top_k: int) -> DataFrame | None:
    """(message_id, boost) of the best ``max(4 k, 20)`` matches in an index, or in messages; the boost is 1 / (rank + 0.001), negative for usual ranks."""
    ranked = bm25_of_index(source, tokens) if isinstance(source, tuple) else bm25(source, tokens)
    if ranked is None:
        return None
    best = ranked.orderBy("rank", "message_id").limit(max(4 * top_k, 20))
    return best.groupBy("message_id").agg(F.max(F.try_divide(F.lit(1.0), F.col("rank") + 0.001)).alias("boost"))
