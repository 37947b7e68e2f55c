"""Schemas of the stored tables, written out so that nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """A struct from ``name type`` pairs; plain names are strings."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "ts": T.TimestampType(), "binary": T.BinaryType(), "vector": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "map": T.MapType(T.StringType(), T.StringType())}
    fields = []
    for part in ddl.split(","):
        name, *kind = part.split()
        fields.append(T.StructField(name, kinds[kind[0]] if kind else T.StringType()))
    return T.StructType(fields)


ATTACHMENT = _struct("id, filename, mime_type, data binary, metadata map")
INBOUND_MESSAGE = T.StructType(
    [*_struct("id, subject, sender, recipients strings, snippet, body, received_at ts, thread_id, metadata map").fields, T.StructField("attachments", T.ArrayType(ATTACHMENT))]
)

MESSAGES = _struct("id, subject, sender, recipients, snippet, body, received_at ts, thread_id, metadata")
ATTACHMENTS = _struct("id, message_id, filename, mime_type, data binary, metadata")
CONTENT_REGISTRY = _struct("content_id, message_id, attachment_id, content_type, mime_type, sha256, created_at, metadata")
ATTACHMENT_TEXTS = _struct("content_id, page int, chunk_index int, text, token_count int, sha256")
EMBEDDINGS = _struct("embedding_id, content_id, chunk_index int, model, dimensions int, vector vector, created_at, metadata")
GRAPH_ENTITIES = _struct("entity_id, label, properties")
GRAPH_RELATIONS = _struct("relation_id, source_id, target_id, relation_type, properties")
ENTITY_MENTIONS = _struct("mention_id, extractor, content_id, chunk_index int, entity_id, label, text, start_char int, end_char int, confidence double, metadata, created_at")
LOCAL_FILES = _struct("content_id, path, size long, modified_at, metadata")
TASK_QUEUE = _struct("task_id, task_type, status, payload, attempts int, available_at ts, locked_at ts, last_error, created_at ts, updated_at ts")
POSTINGS = _struct("term, message_id, tf long, positions ints")
MESSAGE_LENGTHS = _struct("message_id, length int")
LAB_RESULTS = _struct(
    "result_id, extractor, test_entity_id, measurement_entity_id, reference_entity_id, test_name, measurement_text, measurement_value double, measurement_units, reference_range, "
    "date_raw, date_parsed, patient, message_id, attachment_id, content_id, chunk_index int, metadata, created_at"
)
FINANCIAL_RECORDS = _struct(
    "record_id, extractor, record_type, amount_value double, amount_text, currency, counterparty, reference, date_raw, date_parsed, message_id, attachment_id, content_id, chunk_index int, metadata, created_at"
)
MEDICAL_EVENTS = _struct(
    "event_id, extractor, event_type, description, attributes, patient, clinician, facility, date_raw, date_parsed, message_id, attachment_id, content_id, chunk_index int, metadata, created_at"
)

#: Every stored table with its key.
TABLES = {
    "messages": (MESSAGES, ["id"]),
    "attachments": (ATTACHMENTS, ["id", "message_id"]),
    "content_registry": (CONTENT_REGISTRY, ["content_id"]),
    "attachment_texts": (ATTACHMENT_TEXTS, ["content_id", "page", "chunk_index"]),
    "embeddings": (EMBEDDINGS, ["embedding_id"]),
    "graph_entities": (GRAPH_ENTITIES, ["entity_id"]),
    "graph_relations": (GRAPH_RELATIONS, ["relation_id"]),
    "entity_mentions": (ENTITY_MENTIONS, ["mention_id"]),
    "local_files": (LOCAL_FILES, ["content_id"]),
    "task_queue": (TASK_QUEUE, ["task_id"]),
    "postings": (POSTINGS, ["term", "message_id"]),
    "message_lengths": (MESSAGE_LENGTHS, ["message_id"]),
    "lab_results": (LAB_RESULTS, ["result_id"]),
    "financial_records": (FINANCIAL_RECORDS, ["record_id"]),
    "medical_events": (MEDICAL_EVENTS, ["event_id"]),
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][0])
