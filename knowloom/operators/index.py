"""From registered content to chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowloom.functions import ids
from knowloom.functions.embed import Embedder, HashedEmbedder
from knowloom.functions.text import basename, chunks, filename_of, sha256, word_count
from knowloom.operators.merge import replace_by_key

#: Order of the kinds of content in a limited run.
PRIORITY = {"message": 0, "attachment": 1, "local_file": 2}
#: Chunks of a content per block of the two-step numbering.
BLOCK_PAGES = 256


def pending(registry: DataFrame, texts: DataFrame, messages: DataFrame, attachments: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Contents without chunks, as one table with their bytes or text.

    A limit takes messages first, then attachments, then files, each oldest
    first; no limit, zero and a negative one mean all.
    """
    todo = registry.join(texts.select("content_id").distinct(), "content_id", "left_anti")
    m = messages.select(F.col("id").alias("message_id"), "body", F.col("subject").alias("m_subject"))
    meta = F.col("metadata")
    mail = todo.filter("content_type = 'message'").join(m, "message_id").select(
        "content_id", "message_id", F.lit(None).cast("string").alias("attachment_id"), "content_type", F.coalesce("mime_type", F.lit("text/plain")).alias("mime_type"),
        F.coalesce(F.get_json_object(meta, "$.subject"), F.concat(F.lit("message-"), F.col("message_id"))).alias("filename"),
        F.col("body").alias("text"), F.lit(None).cast("binary").alias("data"), "metadata", "created_at",
    )
    a = attachments.select("message_id", F.col("id").alias("attachment_id"), F.col("filename").alias("a_name"), F.col("mime_type").alias("a_mime"), "data")
    att = todo.filter("content_type = 'attachment'").join(a, ["message_id", "attachment_id"]).select(
        "content_id", "message_id", "attachment_id", "content_type", F.coalesce("mime_type", "a_mime").alias("mime_type"),
        filename_of(F.col("a_name"), meta).alias("filename"), F.lit(None).cast("string").alias("text"), "data", "metadata", "created_at",
    )
    f = files.select("content_id", "path")
    loc = todo.filter("content_type = 'local_file'").join(f, "content_id").select(
        "content_id", "message_id", "attachment_id", "content_type", "mime_type",
        F.coalesce(F.get_json_object(meta, "$.filename"), basename(F.col("path"))).alias("filename"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("data"), "metadata", "created_at",
    )
    out = mail.unionByName(att).unionByName(loc)
    if not limit or limit < 0:
        return out
    order = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("content_type")]
    return out.orderBy(order, "created_at", "content_id").limit(limit)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages (content_id, page, text), numbered through each content; blank pages give none.

    The numbers are prefix sums over blocks of pages first and inside a block
    then, so the chunks of one huge content are numbered by many tasks.
    """
    p = pages.withColumn("parts", chunks(F.col("text"))).withColumn("n", F.size("parts")).filter("n > 0").drop("text")
    p = p.withColumn("block", F.floor(F.col("page") / BLOCK_PAGES))
    totals = p.groupBy("content_id", "block").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("content_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("content_id", "block", before.alias("offset"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("content_id", "block").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = p.join(totals, ["content_id", "block"]).withColumn("first", F.col("offset") + own)
    out = placed.select("content_id", "page", "first", F.posexplode("parts").alias("i", "text"))
    return out.select("content_id", "page", (F.col("first") + F.col("i")).cast("int").alias("chunk_index"), "text", word_count(F.col("text")).alias("token_count"), sha256(F.col("text")).alias("sha256"))


def embed_chunks(texts: DataFrame, records: DataFrame, created_at: Column, embedder: Embedder | None = None) -> DataFrame:
    """Embedding rows of chunks, with the provenance of their content as JSON.

    Embedding is bound by computing, not by bytes, so the rows are spread over
    a fixed number of tasks that is not reduced by their small size.
    """
    e = embedder or HashedEmbedder()
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(tasks, "content_id", "chunk_index")
    info = records.select("content_id", "message_id", "attachment_id", "filename", "mime_type", "content_type", F.col("metadata").alias("content_meta"))
    joined = texts.join(info, "content_id", "left")
    meta = F.to_json(
        F.struct(
            "page", "filename", "mime_type", F.col("content_type").alias("source"), "message_id", "attachment_id",
            F.get_json_object("content_meta", "$.path").alias("path"), F.from_json("content_meta", "map<string,string>").alias("content_metadata"),
        )
    )
    model = F.lit(e.model_name)
    return joined.select(
        ids.embedding_id(F.col("content_id"), F.col("chunk_index"), model).alias("embedding_id"),
        "content_id", "chunk_index", model.alias("model"), F.lit(e.dimensions).alias("dimensions"), e.embed(F.col("text")).alias("vector"), created_at.alias("created_at"), meta.alias("metadata"),
    )


def replace_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks, or vectors, of every re-indexed content replaced together."""
    return replace_by_key(old, new, ["content_id"])
