"""Items above a size limit, cut at natural boundaries with overlap.

Every boundary of a text (ends of paragraphs, lines, sentences and words; inside
words longer than a quarter of the limit every safe character) is joined to its
farthest legal successor: the farthest boundary such that the piece, begun up to
``overlap`` characters before the cut, stays within the limit.  A paragraph end
is preferred to a sentence or line end, and that to a word end, if it lies in
the second half of the piece.  All greedy cuts then follow by pointer doubling:
the set of cuts is united with its image under the successor table, and the
table is squared, so a text of n pieces takes log2(n) vectorised rounds.

New chunk_index values run on over each content in the order of the old ones.
They are prefix sums: totals of blocks of old indexes first, then inside each
block, so a content that holds a large part of the table is spread over tasks.

Defined results
---------------
* texts up to the limit, empty texts and null texts come out as one piece;
* the pieces without their overlaps, joined, are the text; no piece is longer
  than the limit (code points);
* no cut inside CR LF, before a combining mark, a variation selector or a joiner;
* a row repeated with the same content_id, page and chunk_index counts once;
  rows with equal keys and unlike texts are kept, ordered by sha256;
* null page or chunk_index sorts first.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from knowloom.session import materialise

LIMIT = 1000
OVERLAP = 100
#: Old chunk indexes per block of the two-step prefix sum.
BLOCK = 512

CUTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPACE = re.compile(r"\s+")
_STOPS = frozenset(".!?…।॥。！？;")
_CLOSERS = frozenset("\"'”’)]»")


def _joins_back(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M" or ch in "\u200d\u200c\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff"


def boundaries(text: str, long_word: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted boundary positions, 0 and the end included, and their levels (3 paragraph to 0 character)."""
    pos, level = [0], [3]
    n = len(text)

    def inside(a: int, b: int) -> None:
        for i in range(a + 1, b):
            if not _joins_back(text[i]) and text[i - 1] != "\u200d" and not (text[i - 1] == "\r" and text[i] == "\n"):
                pos.append(i)
                level.append(0)

    last = 0
    for m in _SPACE.finditer(text):
        a, b = m.span()
        if b - last > long_word:
            inside(last, b)
        if b < n and not _joins_back(text[b]):
            lines = m[0].count("\n")
            k = a - 1
            while k > last and text[k] in _CLOSERS:
                k -= 1
            pos.append(b)
            level.append(3 if lines > 1 else 2 if lines or (k >= 0 and text[k] in _STOPS) else 1)
            last = b
    if n - last > long_word:
        inside(last, n)
    pos.append(n)
    level.append(3)
    return np.array(pos), np.array(level)


def successors(pos: np.ndarray, level: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin of the piece that follows each cut, and the index of its farthest legal end."""
    begin = np.where(pos > 0, pos[np.searchsorted(pos, np.maximum(pos - overlap, 0))], 0)
    reach = begin + limit
    nxt = np.searchsorted(pos, reach, side="right") - 1
    done = np.zeros(len(pos), bool)
    for least in (3, 2):
        idx = np.nonzero(level >= least)[0]
        c = idx[np.maximum(np.searchsorted(pos[idx], reach, side="right") - 1, 0)]
        good = ~done & (pos[c] > pos) & (pos[c] >= begin + limit // 2) & (pos[nxt] != pos[-1])
        nxt = np.where(good, c, nxt)
        done |= good
    nxt[-1] = len(pos) - 1
    return begin, nxt


def cuts_of(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    if not text or len(text) <= limit:
        return [(0, len(text or ""))]
    pos, level = boundaries(text, max(1, min(limit // 4, (limit - overlap) // 2)))
    begin, nxt = successors(pos, level, limit, overlap)
    # A cluster of marks longer than the limit has no boundary: it may be cut anywhere.
    stuck = nxt <= np.arange(len(pos))
    stuck[-1] = False
    if stuck.any():
        extra = np.concatenate([np.arange(pos[i] + 1, pos[i + 1]) for i in np.nonzero(stuck)[0]])
        pos, level = np.concatenate([pos, extra]), np.concatenate([level, np.zeros(len(extra), int)])
        order = np.argsort(pos)
        pos, level = pos[order], level[order]
        begin, nxt = successors(pos, level, limit, overlap)
    cut = np.zeros(len(pos), bool)
    cut[0] = True
    table, size = nxt, 0
    while size < (now := int(cut.sum())):
        size = now
        cut[table[np.nonzero(cut)[0]]] = True
        table = table[table]
    at = np.nonzero(cut)[0]
    return [(int(begin[a]), int(pos[b])) for a, b in zip(at[:-1], at[1:])]


def _cuts(limit: int, overlap: int):
    @F.pandas_udf(CUTS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in cuts_of(t, limit, overlap)] if t is not None else None for t in texts], dtype=object)

    return run


def _keyed(texts: DataFrame) -> DataFrame:
    """Rows with ``key``, equal for repeated rows, and the hash of the text."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    parts = [x for c in ("content_id", "page", "chunk_index") for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return texts.select("content_id", "page", "chunk_index", "text").withColumn("old_sha", sha).withColumn("key", F.xxhash64(*parts, "old_sha"))


def planned(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, content_id, page, chunk_index, old_sha, cuts, pieces): the cuts of every row, without the texts, each row once."""
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must lie between 0 and half the limit")
    t = F.col("text")
    # Only long texts travel to Python.
    long_cuts = _cuts(limit, overlap)(F.when(F.length(t) > limit, t))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(F.length(t), F.lit(0)).alias("end")))
    rows = _keyed(texts).withColumn("cuts", F.coalesce(long_cuts, whole)).withColumn("pieces", F.size("cuts")).drop("text")
    return materialise(rows.dropDuplicates(["key"]))


def split_items(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all rows: content_id, page, chunk_index (new), old_chunk_index, piece, pieces, text, token_count, sha256.

    Cuts are found and numbered without the texts; these are shuffled once, to
    meet their cuts.
    """
    rows = planned(texts, limit, overlap).withColumn("block", F.floor(F.col("chunk_index") / BLOCK))
    totals = rows.groupBy("content_id", "block").agg(F.sum("pieces").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("content_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("content_id").alias("o_content"), F.col("block").alias("o_block"), before.alias("block_offset"))
    joined = rows.join(offsets, rows.content_id.eqNullSafe(offsets.o_content) & rows.block.eqNullSafe(offsets.o_block))
    order = W.partitionBy("content_id", "block").orderBy("chunk_index", "page", "old_sha")
    own = F.coalesce(F.sum("pieces").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = joined.select("key", "content_id", "page", F.col("chunk_index").alias("old_chunk_index"), "pieces", "cuts", (F.col("block_offset") + own).alias("first"))
    once = _keyed(texts).select("key", "text").dropDuplicates(["key"])
    out = placed.join(once, "key").select("content_id", "page", "old_chunk_index", "pieces", "first", "text", F.posexplode("cuts").alias("piece", "cut"))
    piece = F.substring(F.col("text"), F.col("cut.start") + 1, F.col("cut.end") - F.col("cut.start"))
    out = out.withColumn("text", piece)
    words = F.filter(F.split(F.trim(F.col("text")), r"\s+"), lambda x: x != "")
    return out.select(
        "content_id",
        "page",
        (F.col("first") + F.col("piece")).cast("int").alias("chunk_index"),
        "old_chunk_index",
        "piece",
        "pieces",
        "text",
        F.size(words).alias("token_count"),
        F.sha2("text", 256).alias("sha256"),
    )


def found(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Keys of the rows that had to be cut."""
    return planned(texts, limit).filter(F.col("pieces") > 1).select("content_id", "page", "chunk_index").distinct()
