"""Mail sources: provider payloads to messages, and messages to stored tables."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.functions import ids
from knowloom.functions.text import sha256
from knowloom.operators.merge import with_defaults

_BODY = T.StructType([T.StructField("data", T.StringType()), T.StructField("attachmentId", T.StringType()), T.StructField("size", T.LongType())])
_HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
_PART = T.StructType([T.StructField("filename", T.StringType()), T.StructField("mimeType", T.StringType()), T.StructField("body", _BODY), T.StructField("headers", _HEADERS)])
#: Schema of one message as the mail provider's interface gives it.
PROVIDER_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("internalDate", T.StringType()),
        T.StructField("labelIds", T.ArrayType(T.StringType())),
        T.StructField("payload", T.StructType([T.StructField("headers", _HEADERS), T.StructField("body", _BODY), T.StructField("parts", T.ArrayType(_PART))])),
    ]
)


class MessageClient(Protocol):
    """A provider's paged listing and lookup."""

    def list_page(self, query: str, page_size: int, page_token: str | None) -> tuple[list[str], str | None]: ...

    def get(self, message_id: str) -> dict: ...

    def attachment(self, message_id: str, attachment_id: str) -> str:
        """Base64url data of an attachment, which a message names only."""
        ...


def with_attachment_data(client: MessageClient, payload: dict) -> dict:
    """A payload in which every named attachment has its data."""
    inner = payload.get("payload") or {}
    parts = []
    for part in inner.get("parts") or []:
        body = part.get("body") or {}
        if part.get("filename") and body.get("attachmentId") and not body.get("data"):
            part = part | {"body": body | {"data": client.attachment(payload["id"], body["attachmentId"])}}
        parts.append(part)
    return payload | {"payload": inner | {"parts": parts}} if parts else payload


def load_attachments(stored: DataFrame, make_client: Callable[[], MessageClient]) -> DataFrame:
    """Stored attachments with the bytes that are still missing, fetched by the executors; one client for each task."""

    def run(batches):
        client = None
        for pdf in batches:
            data = pdf["data"].tolist()
            for i, (message, own) in enumerate(zip(pdf["message_id"], pdf["id"])):
                if data[i] is None:
                    client = client or make_client()
                    text = client.attachment(message, own) or ""
                    data[i] = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
            yield pdf.assign(data=data)

    return stored.mapInPandas(run, stored.schema)


def search(client: MessageClient, query: str, limit: int | None = None, page_size: int = 100) -> Iterator[dict]:
    """Payloads of matching messages, fetched page by page as they are asked for.

    No limit, or a negative one, means all.
    """
    if not 1 <= page_size <= 500:
        raise ValueError("page_size must lie between 1 and 500")
    token, given = None, 0
    unlimited = limit is None or limit < 0
    while unlimited or given < limit:
        found, token = client.list_page(query, page_size, token)
        for one in found:
            if not unlimited and given >= limit:
                return
            yield with_attachment_data(client, client.get(one))
            given += 1
        if not token:
            return


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Provider payloads stored as JSON lines."""
    return spark.read.schema(PROVIDER_MESSAGE).json(path)


def payload_frame(spark: SparkSession, payloads: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame(list(payloads), PROVIDER_MESSAGE)


def base64url(data: Column) -> Column:
    """Bytes of base64url text, with or without padding."""
    plain = F.translate(data, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def _header(name: str) -> Column:
    """Value of a header in any case; of repeated ones the last, empty without any."""
    own = F.filter(F.coalesce("payload.headers", F.array().cast(_HEADERS)), lambda h: F.lower(h["name"]) == name)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["value"], F.lit(""))


def decode_messages(payloads: DataFrame) -> DataFrame:
    """Provider payloads as inbound messages.

    Header names match in any case, of repeated headers the last counts;
    recipients are cut at every comma; the body is that of the payload, else of
    the first top-level ``text/plain`` part; without a date it is the epoch.
    """
    text_part = F.filter("payload.parts", lambda x: (x["mimeType"] == "text/plain") & x["body"]["data"].isNotNull())
    own = F.nullif(F.col("payload.body.data"), F.lit(""))
    data = F.coalesce(own, F.try_element_at(text_part, F.lit(1))["body"]["data"])
    parts = F.filter(F.coalesce("payload.parts", F.array()), lambda x: (F.length(x["filename"]) > 0) & (F.length(x["body"]["attachmentId"]) > 0))
    size = lambda x: F.create_map(F.lit("size"), x["body"]["size"].cast("string"))
    attachments = F.transform(
        parts,
        lambda x: F.struct(
            x["body"]["attachmentId"].alias("id"), x["filename"].alias("filename"), F.coalesce(x["mimeType"], F.lit("application/octet-stream")).alias("mime_type"), base64url(x["body"]["data"]).alias("data"), size(x).alias("metadata")
        ),
    )
    to = F.filter(F.transform(F.split(_header("to"), ","), lambda r: F.trim(r)), lambda r: r != "")
    return payloads.select(
        "id",
        _header("subject").alias("subject"),
        _header("from").alias("sender"),
        to.alias("recipients"),
        F.coalesce("snippet", F.lit("")).alias("snippet"),
        F.coalesce(F.decode(base64url(data), "UTF-8"), F.lit("")).alias("body"),
        F.timestamp_millis(F.coalesce(F.col("internalDate").try_cast("long"), F.lit(0))).alias("received_at"),
        F.col("threadId").alias("thread_id"),
        F.create_map(F.lit("source"), F.lit("mail"), F.lit("labels"), F.to_json(F.coalesce("labelIds", F.array().cast("array<string>")))).alias("metadata"),
        attachments.alias("attachments"),
    )


def stored_messages(inbound: DataFrame) -> DataFrame:
    return inbound.select("id", "subject", "sender", F.array_join("recipients", ",").alias("recipients"), "snippet", "body", "received_at", "thread_id", F.to_json("metadata").alias("metadata"))


def stored_attachments(inbound: DataFrame) -> DataFrame:
    a = inbound.select(F.col("id").alias("message_id"), F.explode("attachments").alias("a"))
    return a.select("a.id", "message_id", "a.filename", "a.mime_type", "a.data", F.to_json("a.metadata").alias("metadata"))


def registry_rows(inbound: DataFrame, created_at: Column) -> DataFrame:
    """Registry rows of message bodies and attachments; an empty body has no hash."""
    empty = F.create_map().cast("map<string,string>")
    own = F.map_concat(F.create_map(F.lit("subject"), F.col("subject"), F.lit("sender"), F.col("sender"), F.lit("recipients"), F.array_join("recipients", ",")), F.coalesce("metadata", empty))
    own = F.map_filter(own, lambda k, v: v.isNotNull())
    bodies = inbound.select(
        ids.message_content_id(F.col("id")).alias("content_id"),
        F.col("id").alias("message_id"),
        F.lit(None).cast("string").alias("attachment_id"),
        F.lit("message").alias("content_type"),
        F.lit("text/plain").alias("mime_type"),
        sha256(F.nullif(F.col("body"), F.lit(""))).alias("sha256"),
        created_at.alias("created_at"),
        F.to_json(own).alias("metadata"),
    )
    a = inbound.select("id", "subject", "sender", "recipients", "thread_id", F.explode("attachments").alias("a"))
    defaults = F.create_map(
        F.lit("filename"), F.col("a.filename"), F.lit("message_subject"), F.col("subject"), F.lit("message_sender"), F.col("sender"),
        F.lit("message_recipients"), F.array_join("recipients", ","), F.lit("thread_id"), F.col("thread_id"),
    )
    files = a.select(
        ids.attachment_content_id(F.col("id"), F.col("a.id")).alias("content_id"),
        F.col("id").alias("message_id"),
        F.col("a.id").alias("attachment_id"),
        F.lit("attachment").alias("content_type"),
        F.col("a.mime_type").alias("mime_type"),
        sha256(F.col("a.data")).alias("sha256"),
        created_at.alias("created_at"),
        F.to_json(with_defaults(F.col("a.metadata"), defaults)).alias("metadata"),
    )
    return bodies.unionByName(files)
