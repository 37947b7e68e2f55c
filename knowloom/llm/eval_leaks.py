"""Evaluation passages inside a corpus, also with other numbers and names put in.

Both sides are cut into words (runs of letters and digits, lower case) and
canonicalised to templates: numbers, units and names become typed placeholders.
Windows of ``WINDOW`` template words are hashed and joined; for every joined
window the slots are compared.  Windows whose slots are all equal are verbatim;
windows whose slots map one to one to other values are re-parameterised, and a
mapping that contradicts itself is no leak.

A word is canonicalised by what the evaluation items hold: it is a name if the
items use it as one, itself if the items use it otherwise, and a name too if it
is unknown to them and written with a capital.  So a copy in any letter case
has the templates of its item, and every common run of ``WINDOW`` words is
found.  All other words match nothing, and only runs of ``WINDOW`` words that
can match are hashed, shuffled and joined.  What the items hold is known to the
workers as two bit sets of bounded size.  A set that is full takes further words
for names, on both sides alike: that costs joined windows, but loses no leak.

A window with fewer than ``FIXED_WORDS`` words that are no placeholders, as in
tables of numbers, is hashed as it is written: it has no template of its own,
and all tables of numbers would meet in one.

Defined results
---------------
* null and empty texts and texts shorter than the window: no leak;
* an item_id that occurs in several rows counts for all its texts; equal items
  under several ids are all reported;
* a document reported once per item and kind, with its longest run; repeated
  documents under other ids are reported for each id.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from knowloom.llm import bit_sets
from knowloom.session import bounded_broadcast, materialise

WINDOW = 12
#: Template words other than placeholders that a window needs to count as a re-parameterised copy.
FIXED_WORDS = 7
#: Words whose template a worker remembers.
REMEMBERED = 500_000

WORD = re.compile(r"[^\W_]+")
# Unit words that become the unit placeholder.
UNITS = frozenset("mg g kg ug µg ml l dl mmol nmol iu km m cm mm inch inches percent hours hour minutes minute days day weeks week months month years year rupees euros dollars pounds usd eur gbp inr".split())
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01p"

_WINDOW_SCHEMA = "id bigint, pos int, key bigint, words array<string>"


def _word_hash(low: str) -> int:
    return xxhash.xxh3_64_intdigest(low)


def _uses(batches):
    """Map function: every distinct word of a batch of texts by hash, and whether it is written as a name or otherwise."""
    for pdf in batches:
        names, plain = set(), set()
        for t in pdf["text"]:
            at_start = True
            for m in re.finditer(r"[^\W_]+|[.?!:]", t or ""):
                w = m[0]
                if not w[0].isalnum():
                    at_start = True
                    continue
                (names if w[0].isupper() and not at_start and not w.isupper() else plain).add(w.lower())
                at_start = False
        every = list(names | plain)
        yield pd.DataFrame({"h": np.array([_word_hash(w) for w in every], np.uint64).view(np.int64), "plain": [w in plain for w in every]})


def vocabulary(items: DataFrame):
    """Bit sets of the words that the items use as names only, and of their others."""
    uses = materialise(items.select("text").mapInPandas(_uses, "h long, plain boolean").groupBy("h").agg(F.max("plain").alias("plain")))
    n = uses.count()
    return tuple(bit_sets.bit_set(uses.filter(F.col("plain") == kind).select("h"), n) for kind in (False, True))


def _canonical(word: str, names: np.ndarray, plain: np.ndarray) -> str | None:
    """Template word, or None for a word that no item can hold."""
    low = word.lower()
    if not low.isalpha() and any(c.isdigit() for c in low):
        return NUMBER
    if low in UNITS:
        return UNIT
    h = _word_hash(low)
    if bit_sets.holds(names, h):
        return NAME
    if bit_sets.holds(plain, h):
        return low
    return NAME if word[0].isupper() else None


def _key(template: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(template)) - (1 << 63)


def _windows(known):
    """Map function: (id, text) to the windows that can match."""

    def run(batches):
        names, plain = known.value
        memo: dict[str, str | None] = {}

        def template_of(word: str) -> str | None:
            if word not in memo:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                memo[word] = _canonical(word, names, plain)
            return memo[word]

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                if not text:
                    continue
                words = WORD.findall(text)
                n = len(words)
                if n < WINDOW:
                    continue
                template = [template_of(w) for w in words]
                low = None
                start = 0
                while start < n:
                    while start < n and template[start] is None:
                        start += 1
                    end = start
                    while end < n and template[end] is not None:
                        end += 1
                    if end - start >= WINDOW:
                        low = low or [w.lower() for w in words]
                        fixed = [t not in (NUMBER, UNIT, NAME) for t in template[start:end]]
                        many = sum(fixed[: WINDOW - 1])
                        for i in range(start, end - WINDOW + 1):
                            many += fixed[i - start + WINDOW - 1]
                            window = low[i : i + WINDOW]
                            rows.append((doc, i, _key(template[i : i + WINDOW] if many >= FIXED_WORDS else window), window))
                            many -= fixed[i - start]
                    start = end
            if rows:
                yield pd.DataFrame(rows, columns=["id", "pos", "key", "words"])

    return run


def slot_kind(doc_words, item_words) -> str | None:
    """``verbatim``, ``reparameterised`` or None for two windows with one template."""
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    changed = 0
    for d, i in zip(doc_words, item_words):
        changed += d != i
        if forth.setdefault(i, d) != d or back.setdefault(d, i) != i:
            return None
    return "reparameterised" if changed else "verbatim"


@F.pandas_udf(T.StringType())
def _slot_kind(doc: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([slot_kind(list(a), list(b)) for a, b in zip(doc, item)], dtype=object)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, run_words): every document with the items found in it, with the longest run of words."""
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(vocabulary(items))
    item_windows = items.select(F.col("item_id").alias("id"), "text").mapInPandas(_windows(known), _WINDOW_SCHEMA)
    item_windows = materialise(item_windows.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "key", F.col("words").alias("item_words")).distinct())
    doc_windows = documents.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull()).mapInPandas(_windows(known), _WINDOW_SCHEMA)
    met = doc_windows.join(bounded_broadcast(item_windows), "key").withColumn("kind", _slot_kind("words", "item_words")).filter(F.col("kind").isNotNull())
    met = met.select(F.col("id").alias("doc_id"), "item_id", "kind", "pos", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "item_id", "kind", "shift").orderBy("pos"))
    runs = met.withColumn("island", island).groupBy("doc_id", "item_id", "kind", "shift", "island").agg((F.count(F.lit(1)) + WINDOW - 1).cast("int").alias("run_words"))
    return runs.groupBy("doc_id", "item_id", "kind").agg(F.max("run_words").alias("run_words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with at least ``WINDOW`` consecutive words of the item verbatim in the document."""
    return leaks(documents, items).filter(F.col("kind") == "verbatim").select("doc_id", "item_id").distinct()
