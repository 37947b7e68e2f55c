"""Filtered fact queries, message context and thread windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowloom.functions.text import split_recipients


def _contains(column: Column, text: str) -> Column:
    """Case-insensitive substring test in which ``%`` and ``_`` of the text stay wildcards."""
    return F.lower(column).like(f"%{text.lower()}%")


def _top(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Latest first by parsed, else raw date as text, then by creation; a negative limit, or none, gives all rows."""
    order = [F.coalesce("date_parsed", "date_raw").desc_nulls_last(), F.desc_nulls_last("created_at"), F.asc(key)]
    named = df.withColumn("subject", F.get_json_object("metadata", "$.subject")).withColumn("filename", F.get_json_object("metadata", "$.filename"))
    return named.orderBy(*order) if limit is None or limit < 0 else named.orderBy(*order).limit(limit)


def fetch_lab_results(lab: DataFrame, extractor: str, test: str | None = None, patient: str | None = None, subject: str | None = None, limit: int | None = 20) -> DataFrame:
    df = lab.filter(F.col("extractor") == extractor)
    for text, column in ((test, F.col("test_name")), (patient, F.col("patient")), (subject, F.get_json_object("metadata", "$.subject"))):
        if text:
            df = df.filter(_contains(column, text))
    return _top(df, "result_id", limit)


def fetch_financial_records(fin: DataFrame, extractor: str, counterparty: str | None = None, record_type: str | None = None, reference: str | None = None, limit: int | None = 20) -> DataFrame:
    df = fin.filter(F.col("extractor") == extractor)
    if counterparty:
        df = df.filter(_contains(F.col("counterparty"), counterparty))
    if record_type:
        df = df.filter(F.lower("record_type") == record_type.lower())
    if reference:
        df = df.filter(_contains(F.col("reference"), reference))
    return _top(df, "record_id", limit)


def fetch_medical_events(med: DataFrame, extractor: str, event_type: str | None = None, patient: str | None = None, limit: int | None = 20) -> DataFrame:
    df = med.filter(F.col("extractor") == extractor)
    if event_type:
        df = df.filter(F.lower("event_type") == event_type.lower())
    if patient:
        df = df.filter(_contains(F.col("patient"), patient))
    return _top(df, "event_id", limit)


def last_per_thread(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest messages of every thread, each id once.

    A thread may hold a large part of all messages: the rank is limited inside
    every task before the shuffle (window group limit).
    """
    m = messages.filter(F.col("thread_id").isNotNull()).dropDuplicates(["id"])
    w = W.partitionBy("thread_id").orderBy(F.desc_nulls_last("received_at"), F.desc("id"))
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def message_context(messages: DataFrame, attachments: DataFrame, message_id: str, thread_window: int = 5, include_body: bool = True) -> DataFrame:
    """The latest messages of a message's thread, oldest first, with their attachments.

    The window holds the latest messages of the thread, so an old message may be
    outside its own window.  Without a thread, or for a window of 0, it is the
    message alone; an unknown id gives no rows.
    """
    one = messages.filter(F.col("id") == message_id).dropDuplicates(["id"])
    row = one.select("thread_id").first()
    if row is None:
        window = one
    elif row["thread_id"] is None or thread_window <= 0:
        window = one
    else:
        thread = messages.filter(F.col("thread_id") == row["thread_id"]).dropDuplicates(["id"])
        window = thread.orderBy(F.desc_nulls_last("received_at"), F.desc("id")).limit(thread_window)
    a = attachments.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("id", "filename", "mime_type"))).alias("attachments"))
    cols = ["id", "thread_id", "subject", "sender", split_recipients(F.col("recipients")).alias("recipients"), "snippet", *(["body"] if include_body else []), "received_at", "metadata"]
    empty = F.array().cast("array<struct<id:string,filename:string,mime_type:string>>")
    out = window.select(*cols).join(a, F.col("id") == a.message_id, "left").drop("message_id")
    return out.withColumn("attachments", F.coalesce("attachments", empty)).orderBy(F.asc_nulls_first("received_at"), "id")
