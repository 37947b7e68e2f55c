"""The registered queries of the core; ``plans.oracles`` holds the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.functions import embed, text, values
from knowloom.operators import extract, facts, fts, graph, index, lookups, merge, retrieve, task_queue, timestamps, units
from knowloom.plans.oracles import ORACLES
from knowloom.session import materialise, table
from knowloom.sources import files

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2025-01-01 00:00:00"
#: Extractor of the stored facts that the fact queries ask for.
EXTRACTOR = "llm:small-local"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Problems of the training data that belong to the core ---------------------


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found({t: table(spark, d, t) for t in timestamps.DATED_TABLES})


@query
def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every dated record with its date in the normal form."""
    return timestamps.normalise_tables({t: table(spark, d, t) for t in timestamps.DATED_TABLES})


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(*(table(spark, d, t) for t in ("lab_results", "financial_records", "unit_factors")))


@query
def p7_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every lab value and amount in the common unit."""
    return units.convert_all(*(table(spark, d, t) for t in ("lab_results", "financial_records", "unit_factors")))


# Chunks and vectors ---------------------------------------------------------


@query
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents with hash and word count."""
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("content_id"), F.lit(1).alias("page"), "text")
    return index.chunk_pages(pages)


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and words by language."""
    docs = table(spark, d, "documents").select("lang", F.explode(text.chunks(F.col("text"))).alias("chunk"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum(text.word_count(F.col("chunk"))).alias("words"))


@query
def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Chunk numbers that run on over the pages of a content, blank pages skipped."""
    t = table(spark, d, "attachment_texts").select("content_id", F.col("chunk_index").alias("page"), "text").distinct()
    return index.chunk_pages(t).select("content_id", "page", "chunk_index", "token_count")


@query
def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Hashed word counts of every document."""
    w = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return w.groupBy("doc_id", embed.bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of every stored vector and of its unit vector."""
    v = table(spark, d, "chunk_embeddings").filter(F.col("vector").isNotNull())
    return v.select("embedding_id", F.round(embed.norm(F.col("vector")), 3).alias("norm"), F.round(embed.norm(embed.unit(F.col("vector"))), 3).alias("unit_norm"))


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most similar to the first one."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return retrieve.nearest(e, "embedding", q, 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


# Registry, selection, merges -------------------------------------------------


@query
def registry_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Documents registered by content: the first id of each hash."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("file:"), text.sha256(F.coalesce("text", F.lit("")))).alias("content_id"), "doc_id")
    return merge.first_wins(rows.limit(0), rows, ["content_id"], "doc_id")


@query
def message_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Messages saved in two batches, the later one overwriting."""
    m = table(spark, d, "messages").select("id", "subject", "received_at")
    first = m.withColumn("version", F.lit(1))
    second = m.filter(F.col("received_at") >= "2021-01-01").withColumn("version", F.lit(2))
    return merge.last_wins(first, second, ["id"], "version").select("id", "version")


@query
def replace_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the first pages of all contents were indexed anew."""
    t = table(spark, d, "attachment_texts").select("content_id", "page", "chunk_index").distinct()
    new = t.filter("chunk_index >= 5").withColumn("run", F.lit(2))
    return merge.replace_by_key(t.withColumn("run", F.lit(1)), new, ["content_id"])


@query
def pending_content(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose content has no vectors."""
    m = table(spark, d, "messages").select(F.concat(F.lit("message:"), "id").alias("content_id")).distinct()
    return m.join(table(spark, d, "chunk_embeddings").select("content_id"), "content_id", "left_anti")


def _registry(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Registry, messages, attachments and files as the stored tables imply them."""
    m = table(spark, d, "messages").select("id", "subject", "body", "received_at").dropDuplicates(["id"])
    none = F.lit(None).cast("string")
    mail = m.select(F.concat(F.lit("message:"), "id").alias("content_id"), F.col("id").alias("message_id"), none.alias("attachment_id"), F.lit("message").alias("content_type"), F.lit("text/plain").alias("mime_type"), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.to_json(F.struct("subject")).alias("metadata"))
    c = table(spark, d, "attachment_texts").select("content_id").distinct().withColumn("parts", F.split("content_id", ":"))
    att = c.filter("content_id like 'attachment:%'").select("content_id", F.col("parts")[1].alias("message_id"), F.col("parts")[2].alias("attachment_id"), F.lit("attachment").alias("content_type"), F.lit("application/pdf").alias("mime_type"), F.lit("2019-01-01 00:00:00").alias("created_at"), F.lit("{}").alias("metadata"))
    loc = c.filter("content_id like 'file:%'").select("content_id", none.alias("message_id"), none.alias("attachment_id"), F.lit("local_file").alias("content_type"), F.lit("text/plain").alias("mime_type"), F.lit("2019-01-01 00:00:00").alias("created_at"), F.lit("{}").alias("metadata"))
    blobs = att.select(F.col("attachment_id").alias("id"), "message_id", F.concat("attachment_id", F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mime_type"), F.lit(None).cast("binary").alias("data"))
    paths = loc.select("content_id", F.concat(F.lit("/files/"), "content_id").alias("path"))
    return mail.unionByName(att).unionByName(loc), m, blobs, paths


@query
def pending_union_limit(spark: SparkSession, d: str) -> DataFrame:
    """The next 3,000 contents to index: messages, then attachments, then files, oldest first."""
    registry, m, blobs, paths = _registry(spark, d)
    none = table(spark, d, "chunk_embeddings").select("content_id")
    return index.pending(registry, none, m, blobs, paths, 3000).select("content_id", "content_type", "filename")


@query
def segments_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of registered contents that the pattern extractor has left no e-mail address of, with file name and subject."""
    registry, m, blobs, _ = _registry(spark, d)
    t = table(spark, d, "attachment_texts").select("content_id", "page", "chunk_index", "text").distinct()
    mentions = _pattern_mentions(spark, d, ("EMAIL",))
    return graph.segments(t, registry, blobs, m, mentions, "pattern:default").select("content_id", "page", "chunk_index", "message_id", "filename", "subject")


# Search ----------------------------------------------------------------------


@query
def bm25_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that match two prefixes, ranked."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    return fts.bm25(m, ["insur", "form"]).select("message_id", F.round(F.col("rank"), 6).alias("rank"))


@query
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    """Messages and occurrences of every indexed term."""
    p, _ = fts.postings(table(spark, d, "messages").dropDuplicates(["id"]))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("messages"), F.sum("tf").alias("occurrences"))


@query
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Search words of every subject, strong ones marked by their number."""
    m = table(spark, d, "messages").filter("subject is not null").select("id", "subject").distinct()
    t = text.query_tokens(F.col("subject"))
    return m.select("id", F.array_join(t, " ").alias("words"), F.size(text.strong_tokens(t)).alias("strong"))


@query
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many of four words occur in every document."""
    words = F.array(*map(F.lit, ("payment", "report", "ledger", "the")))
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", text.hits(words, F.lower("text")).alias("hits"))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best passages of all messages for a question."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    pages = m.select(F.concat(F.lit("message:"), "id").alias("content_id"), F.lit(1).alias("page"), F.col("body").alias("text"))
    texts = index.chunk_pages(pages)
    info = m.select(
        F.concat(F.lit("message:"), "id").alias("content_id"), F.col("id").alias("message_id"), F.lit(None).cast("string").alias("attachment_id"), F.lit("mail").alias("filename"),
        F.lit("text/plain").alias("mime_type"), F.lit("message").alias("content_type"), F.to_json(F.struct("subject", "sender", "recipients")).alias("metadata"),
    )
    # Stored once, as an index is: search then reads each vector a single time.
    vectors = materialise(index.embed_chunks(texts, info, F.lit(NOW)))
    found = retrieve.search(texts, vectors, m, "latest premium receipt from the insurance brokers", 10)
    return found.select("citation_id", "message_id", F.round("score", 4).alias("score"), F.round("raw_score", 4).alias("raw_score"))


# Threads and facts -------------------------------------------------------------


@query
def last_messages_per_thread(spark: SparkSession, d: str) -> DataFrame:
    """The five latest messages of every thread."""
    return lookups.last_per_thread(table(spark, d, "messages").select("id", "thread_id", "received_at"), 5).select("id", "thread_id", "rank")


@query
def thread_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of the first message of the longest thread."""
    m = table(spark, d, "messages")
    top = m.filter("thread_id is not null").groupBy("thread_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).orderBy(F.desc("n"), "thread_id").first()
    _, _, blobs, _ = _registry(spark, d)
    out = lookups.message_context(m, blobs, top["id"], 7)
    return out.select("id", "thread_id", "subject", F.size("attachments").alias("attachments"))


@query
def recipients_split(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of every recipients field."""
    m = table(spark, d, "messages").select("id", "recipients").distinct()
    return m.select("id", F.explode(text.split_recipients(F.col("recipients"))).alias("recipient"))


@query
def lab_query(spark: SparkSession, d: str) -> DataFrame:
    """The latest lab results of a test."""
    df = lookups.fetch_lab_results(table(spark, d, "lab_results").distinct(), EXTRACTOR, "vitamin", None, None, 20)
    return df.select("result_id", "test_name", "date_parsed", "date_raw", "filename")


@query
def financial_query(spark: SparkSession, d: str) -> DataFrame:
    """The latest invoices of some counterparties."""
    df = lookups.fetch_financial_records(table(spark, d, "financial_records").distinct(), EXTRACTOR, "interiors", "invoice", None, 20)
    return df.select("record_id", "counterparty", "record_type", "date_raw", "subject")


@query
def medical_query(spark: SparkSession, d: str) -> DataFrame:
    """The latest medications."""
    df = lookups.fetch_medical_events(table(spark, d, "medical_events").distinct(), EXTRACTOR, "medication", None, 20)
    return df.select("event_id", "event_type", "patient", "date_raw")


@query
def currency_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums by currency as read from the amount text."""
    f = table(spark, d, "financial_records").dropDuplicates(["record_id"])
    t = graph.totals(f.select(values.graph_amount(F.col("amount_text")).alias("amount"), values.graph_currency(F.col("amount_text")).alias("currency")))
    return t.select("currency", F.round("total", 2).alias("total"))


@query
def parse_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, units and currencies of every amount and measurement text."""
    f = table(spark, d, "financial_records").select(F.col("record_id").alias("id"), F.col("amount_text").alias("t"))
    m = table(spark, d, "lab_results").select(F.col("result_id").alias("id"), F.col("measurement_text").alias("t"))
    t = F.col("t")
    return f.unionByName(m).distinct().select("id", values.first_number(t).alias("number"), values.graph_amount(t).alias("amount"), values.currency_of_fact(t).alias("fact_currency"), values.graph_currency(t).alias("graph_currency"), text.last_word(t).alias("last_word"))


@query
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Raw dates by the fixed patterns of the fact builders."""
    m = table(spark, d, "lab_results").select("result_id", "date_raw").distinct()
    return m.select("result_id", values.iso_date(F.col("date_raw"), values.LAB_DATE_PATTERNS).alias("lab_date"), values.iso_date(F.col("date_raw")).alias("plain_date"))


@query
def flat_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Leaf values of every message's metadata."""
    m = table(spark, d, "messages").filter("metadata is not null").select("id", "metadata").distinct()
    return m.select("id", text.flat_values(F.col("metadata")).alias("leaves"))


@query
def json_prop_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events by a property inside their JSON."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.filter("k >= 5").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


# Extraction, graph and facts --------------------------------------------------


def _pattern_mentions(spark: SparkSession, d: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Stored mentions of the pattern extractor over all attachment texts."""
    t = table(spark, d, "attachment_texts").filter("text is not null").select("content_id", "page", "chunk_index", "text").distinct()
    e = extract.PatternExtractor({k: v for k, v in extract.PATTERNS.items() if labels is None or k in labels})
    segs = t.select("content_id", "page", "chunk_index", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("attachment_id"))
    return graph.mention_rows(extract.extract_mentions(t, e), segs, e.name, F.lit(NOW))


@query
def email_mentions(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses by chunk."""
    m = _pattern_mentions(spark, d, ("EMAIL",))
    return m.groupBy("content_id", "chunk_index", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity nodes of all labels."""
    e = graph.entities(_pattern_mentions(spark, d))
    return e.select("entity_id", "label", "canonical", F.array_join("aliases", "|").alias("aliases"))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of all labels in contents, as edges whose ends both exist."""
    m = _pattern_mentions(spark, d)
    nodes = m.select("entity_id").unionByName(m.select(F.col("content_id").alias("entity_id"))).distinct()
    e = graph.export_edges(graph.edges(m), nodes)
    return e.groupBy("source_id", "target_id", "relation_type").agg(F.count(F.lit(1)).alias("mentions"))


@query
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counterparty nodes with their spellings."""
    f = table(spark, d, "financial_records").filter("counterparty is not null").select(F.lit("VENDOR").alias("label"), F.col("counterparty").alias("text"), "created_at")
    e = graph.entities(f.withColumn("entity_id", F.concat(F.lit("VENDOR:"), F.trim(F.lower("text")))))
    return e.select("entity_id", F.array_join("aliases", "|").alias("aliases"), "created_at", "updated_at")


def _order_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as mentions inside their order: returned ones are amounts, others dates."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, d, "lineitem").groupBy(*keys).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_shipdate").alias("l_shipdate"))
    start = (F.col("l_partkey") % 1000).cast("int")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("mention_id"), F.lit("pattern:orders").alias("extractor"), F.col("l_orderkey").cast("string").alias("content_id"), F.lit(0).alias("chunk_index"),
        F.concat_ws(":", F.lit("E"), "l_partkey").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "MONEY").otherwise("DATE").alias("label"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"),
        start.alias("start_char"), (start + 5).alias("end_char"), F.lit("{}").alias("metadata"),
    )


@query
def nearest_mention(spark: SparkSession, d: str) -> DataFrame:
    """Each amount with the nearest date of its order."""
    m = materialise(_order_mentions(spark, d))
    t = facts.nearest(m.filter("label = 'MONEY'"), m.filter("label = 'DATE'"), "day")
    return t.select("mention_id", F.col("day.mention_id").alias("nearest_id"), F.col("day.text").alias("day"))


@query
def first_mention(spark: SparkSession, d: str) -> DataFrame:
    """Each amount with the first date of its order."""
    m = materialise(_order_mentions(spark, d))
    t = facts.first_in_chunk(m.filter("label = 'MONEY'"), m.filter("label = 'DATE'"), "day")
    return t.select("mention_id", F.col("day.text").alias("day"))


@query
def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """Financial records built from the order mentions."""
    r = facts.financial_records(materialise(_order_mentions(spark, d)), "pattern:orders", F.lit(NOW))
    return r.select("record_id", "record_type", "amount_value", "date_raw", "date_parsed", "content_id")


@query
def lab_facts(spark: SparkSession, d: str) -> DataFrame:
    """Lab results built from the mentions in all attachment texts."""
    return facts.lab_results(materialise(_pattern_mentions(spark, d)), "pattern:default", F.lit(NOW)).drop("metadata")


@query
def payments_by_counterparty(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in the orders of one customer, summed by currency over the graph."""
    c = table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("entity_id"), F.lit("ORGANIZATION").alias("label"), F.to_json(F.struct(F.lower("c_name").alias("canonical"))).alias("properties"))
    o = table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("entity_id"), F.lit("Content").alias("label"), F.to_json(F.struct(F.col("o_orderstatus").alias("subject"))).alias("properties"))
    li = table(spark, d, "lineitem").withColumn("m", F.concat_ws(":", F.lit("M"), "l_orderkey", "l_linenumber"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    money = li.select(F.col("m").alias("entity_id"), F.lit("MONEY").alias("label"), F.to_json(F.struct(F.concat(F.lit("inr "), cents).alias("canonical"))).alias("properties"))
    e1 = table(spark, d, "orders").select(F.concat(F.lit("C:"), "o_custkey").alias("source_id"), F.concat(F.lit("order:"), "o_orderkey").alias("target_id"))
    e2 = li.select(F.col("m").alias("source_id"), F.concat(F.lit("order:"), "l_orderkey").alias("target_id"))
    e = e1.unionByName(e2).withColumn("relation_type", F.lit("MENTIONED_IN"))
    name = table(spark, d, "customer").orderBy("c_custkey").first()["c_name"]
    return graph.totals(graph.payments(c.unionByName(o).unionByName(money), e, name)).select("currency", F.round("total", 2).alias("total"))


@query
def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    """Entities that remain when one family of extractors is removed."""
    lab = table(spark, d, "lab_results").select("extractor", F.col("test_entity_id").alias("entity_id"), "measurement_entity_id")
    mentions = lab.select("extractor", "entity_id")
    relations = lab.select(F.col("entity_id").alias("source_id"), F.col("measurement_entity_id").alias("target_id"), F.to_json(F.struct("extractor")).alias("properties"))
    nodes = lab.select("entity_id").unionByName(lab.select(F.col("measurement_entity_id").alias("entity_id"))).distinct()
    return graph.remove_extractor(mentions, nodes, relations)[1]


@query
def label_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Part types as graph labels."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", F.lit("!")).alias("raw"))
    return p.select("p_partkey", text.graph_name(F.col("raw"), "Entity").alias("label"))


@query
def span_search(spark: SparkSession, d: str) -> DataFrame:
    """Where the name of a test stands in its measurement's chunk text."""
    docs = table(spark, d, "documents").filter("text is not null")
    s = text.span_of(F.col("text"), F.lit("Report"), F.lit(0), F.lit(6))
    return docs.select("doc_id", s["start"].alias("span_start"), s["end"].alias("span_end"))


@query
def export_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of all attachments for an export into one folder."""
    f = table(spark, d, "lab_results").filter("attachment_id is not null").select(F.col("attachment_id").alias("id"), "message_id", F.get_json_object("metadata", "$.filename").alias("filename")).filter("filename is not null").distinct()
    one = f.groupBy("id", "message_id").agg(F.min("filename").alias("filename"))
    return files.export_names(one).select("id", "message_id", "export_name")


# Queue -------------------------------------------------------------------------


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as a queue: their kinds are states, their times due times."""
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "purchase", "in_progress").when(F.col("event_type") == "signup", "completed").otherwise("failed")
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("task_id"), F.col("event_type").alias("task_type"), status.alias("status"), F.col("props").alias("payload"), (F.col("user_id") % 6).cast("int").alias("attempts"),
        ts.alias("available_at"), ts.alias("locked_at"), F.lit(None).cast("string").alias("last_error"), ts.alias("created_at"), ts.alias("updated_at"),
    )


def _midway(q: DataFrame):
    mid = q.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).first()
    return F.lit(mid["a"] + (mid["b"] - mid["a"]) / 2).cast("timestamp")


@query
def queue_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Tasks due at the middle of the queue's time, or with a lease that ran out."""
    q = _queue(spark, d)
    return task_queue.eligible(q, _midway(q)).select("task_id", "status")


@query
def queue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """States after two kinds of tasks were enqueued again, twice."""
    q = _queue(spark, d)
    again = q.filter(F.col("task_type").isin("signup", "view")).select("task_id", "task_type", "payload", "available_at")
    return task_queue.enqueue(q, again.unionByName(again), F.lit(NOW).cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.sum("attempts").alias("attempts"))


@query
def queue_fail_policy(spark: SparkSession, d: str) -> DataFrame:
    """The state of one task after a failed attempt."""
    q = _queue(spark, d)
    first = q.filter("status = 'in_progress'").agg(F.min("task_id")).first()[0]
    out = task_queue.fail(q, first, "x" * 2000, F.lit(NOW).cast("timestamp"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.sum("attempts").alias("attempts"), F.max(F.length("last_error")).alias("error_chars"))


@query
def queue_recover(spark: SparkSession, d: str) -> DataFrame:
    """States after stale leases were recovered."""
    q = _queue(spark, d)
    return task_queue.recover(q, _midway(q)).groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.count("locked_at").alias("locked"))


@query
def agent_tools(spark: SparkSession, d: str) -> DataFrame:
    """The results of three tools, called through the executor."""
    from knowloom.agent import base, tools

    tables = {"lab_results": table(spark, d, "lab_results").distinct(), "medical_events": table(spark, d, "medical_events").distinct(), "messages": table(spark, d, "messages"), "attachments": _registry(spark, d)[2]}
    ex = base.Executor(tools.registry(), base.Context(tables, EXTRACTOR))
    some = tables["messages"].agg(F.min("id")).first()[0]
    calls = [("lab_results", {"test": "urea", "limit": 5}), ("medical_events", {"event_type": "procedure", "limit": 5}), ("fetch_message_context", {"message_id": some}), ("no_such_tool", {})]
    rows = []
    for name, params in calls:
        r = ex.execute(name, params)
        rows.append((name, r.success, sum(len(v) for v in (r.data or {}).values() if isinstance(v, list))))
    return spark.createDataFrame(rows, T.StructType([T.StructField("tool", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("n_rows", T.IntegerType())]))
