"""Deterministic ids, which make every stage repeatable."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha1_of(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def message_content_id(message_id: Column) -> Column:
    return F.concat(F.lit("message:"), message_id)


def attachment_content_id(message_id: Column, attachment_id: Column) -> Column:
    return F.concat_ws(":", F.lit("attachment"), message_id, attachment_id)


def file_content_id(data: Column) -> Column:
    return F.concat(F.lit("file:"), F.sha2(data, 256))


def citation_id(content_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", content_id, chunk_index.cast("string"))


def embedding_id(content_id: Column, chunk_index: Column, model: Column) -> Column:
    return F.concat_ws(":", content_id, chunk_index.cast("string"), model)


def normal_mention(text: Column) -> Column:
    """Canonical name of a mention: lower case, trimmed."""
    return F.trim(F.lower(text))


def entity_id(label: Column, text: Column) -> Column:
    return F.concat_ws(":", label, F.substring(F.sha1(F.concat_ws(":", label, normal_mention(text))), 1, 16))


def mention_id(content_id: Column, chunk_index: Column, start: Column, end: Column, entity: Column, extractor: Column) -> Column:
    return _sha1_of(content_id, chunk_index, start, end, entity, extractor)


def relation_id(mention: Column) -> Column:
    return F.concat(F.lit("mention:"), mention)


def fact_id(content_id: Column, chunk_index: Column, *entities: Column) -> Column:
    """Id of a lab result, financial record or medical event; a missing entity counts as empty."""
    return _sha1_of(content_id, chunk_index, *entities)


def task_id(task_type: str, payload: dict) -> str:
    """Id of a task, equal for equal payloads in any key order."""
    return hashlib.sha1(f"{task_type}:{json.dumps(payload, sort_keys=True)}".encode()).hexdigest()
