"""Hybrid search: cosine, full text, participants and keywords in one ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions import ids
from knowloom.functions.embed import HashedEmbedder, dot
from knowloom.functions.text import STOPWORDS, flat_values, hits, message_id_of, participants
from knowloom.operators.fts import boosts

# Weights of the ranking.
FTS_WEIGHT, FTS_MISS = 0.25, -0.6
PARTICIPANT_HIT, PARTICIPANT_MISS = 0.2, -0.8
STRONG_WEIGHT, ANY_WEIGHT, KEYWORD_MISS = 0.15, 0.05, -0.5
WEAK_WEIGHT, WEAK_MISS = 0.1, -0.5


def words_of(query: str) -> tuple[list[str], list[str]]:
    """(all words, words that are not stopwords) of a query."""
    found = [t.strip("._") for t in re.findall(r"[\w@.]+", query.lower())]
    words = [t for t in found if len(t) > 2]
    return words, [t for t in words if t not in STOPWORDS]


def search(
    texts: DataFrame,
    vectors: DataFrame,
    messages: DataFrame | tuple[DataFrame, DataFrame],
    query: str,
    top_k: int = 5,
    embedder: HashedEmbedder | None = None,
    model: str | None = None,
) -> DataFrame:
    """The ``top_k`` best chunks with score and cosine, best first.

    Scores follow the fixed weights; the boost of full-text matches is usually
    negative, and a smaller loss than not matching at all.  Vectors of another
    length than the query's count as dissimilar (cosine 0).  Ties are broken by
    content and chunk.  ``messages`` is their full-text index (``fts.postings``), or
    the messages themselves where there is none.  The query vector and words are
    literals of the plan, so one scan of the vectors joined to their texts ends in
    a bounded top-k.
    """
    e = embedder or HashedEmbedder()
    words, strong = words_of(query)
    q = F.array(*(F.lit(float(x)) for x in e.embed_query(query)))
    v = vectors if model is None else vectors.filter(F.col("model") == model)
    v = v.select("content_id", "chunk_index", "vector", "metadata").filter(F.col("vector").isNotNull())
    rows = v.join(texts.select("content_id", "chunk_index", "page", "text"), ["content_id", "chunk_index"])
    meta = F.col("metadata")
    rows = rows.withColumn("raw_score", F.coalesce(dot(F.col("vector"), q), F.lit(0.0))).withColumn("message_id", message_id_of(meta)).drop("vector")
    score = F.col("raw_score")
    found = boosts(messages, strong or words, top_k)
    # At most max(4 k, 20) rows.
    best = found.collect() if found is not None else []
    if best:
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(best, found.schema)), "message_id", "left")
        score = score + F.when(F.col("boost").isNotNull(), F.col("boost") * FTS_WEIGHT).otherwise(FTS_MISS)
    array = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    hay = F.lower(F.concat_ws(" \n", "text", F.get_json_object(meta, "$.subject"), flat_values(meta)))
    any_hits, strong_hits = hits(array(words), hay), hits(array(strong), hay)
    if strong:
        score = score + F.when(hits(array(strong), participants(meta)) > 0, PARTICIPANT_HIT).otherwise(PARTICIPANT_MISS)
        score = score + F.when(strong_hits > 0, strong_hits * STRONG_WEIGHT + any_hits * ANY_WEIGHT).otherwise(KEYWORD_MISS)
    elif words:
        score = score + F.when(any_hits > 0, any_hits * WEAK_WEIGHT).otherwise(WEAK_MISS)
    return (
        rows.select(
            ids.citation_id(F.col("content_id"), F.col("chunk_index")).alias("citation_id"),
            "content_id", "chunk_index", "page", "text", "message_id",
            F.get_json_object(meta, "$.filename").alias("filename"),
            F.get_json_object(meta, "$.subject").alias("subject"),
            F.get_json_object(meta, "$.source").alias("source"),
            score.alias("score"),
            "raw_score",
        )
        .orderBy(F.desc("score"), F.desc("raw_score"), "content_id", "chunk_index")
        .limit(max(top_k, 0))
    )


def nearest(vectors: DataFrame, vector_column: str, query: list[float], top_k: int, tie: str) -> DataFrame:
    """The ``top_k`` rows by cosine with a query vector; zero and null vectors take no part."""
    from knowloom.functions.embed import norm

    q = F.array(*(F.lit(float(x)) for x in query))
    n = norm(F.col(vector_column))
    scored = vectors.withColumn("similarity", F.try_divide(dot(F.col(vector_column), q), n * norm(q))).filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), tie).limit(top_k)
