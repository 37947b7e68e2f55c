"""The stages from stored content to facts, over a store; run by hand, by the worker, or for one content."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.operators import extract, facts, graph, index
from knowloom.session import materialise
from knowloom.sources import files, mail
from knowloom.storage import DataStore, count_batches
from knowloom.streaming.worker import Handler, Worker, follow_ups

FACTS = {"lab_results": facts.lab_results, "financial_records": facts.financial_records, "medical_events": facts.medical_events}


def now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def save_messages(store: DataStore, inbound: DataFrame) -> dict[str, int]:
    """Messages, their attachments and their registry rows; returns how many of each."""
    inbound = materialise(inbound)
    attachments = mail.stored_attachments(inbound)
    store.upsert_messages(mail.stored_messages(inbound))
    store.upsert("attachments", attachments)
    store.upsert("content_registry", mail.registry_rows(inbound, now()))
    return {"messages": inbound.count(), "attachments": attachments.count()}


def index_tasks(inbound: DataFrame) -> list[tuple[str, dict]]:
    """Tasks that index the contents of one batch of messages."""
    ids = mail.registry_rows(inbound, F.lit(None).cast("string")).select("content_id").toLocalIterator()
    return [("semantic_index", {"content_id": r["content_id"]}) for r in ids]


def ingest(store: DataStore, payloads: Iterable[dict], batch_size: int | None = 200, worker: Worker | None = None) -> dict[str, int]:
    """Provider payloads saved batch by batch, each enqueued for indexing if there is a worker; returns the counters.

    No batch size, or one below 1, makes a single batch.
    """
    rest = iter(payloads)

    def batches():
        while batch := list(itertools.islice(rest, batch_size if batch_size and batch_size > 0 else None)):
            inbound = mail.decode_messages(mail.payload_frame(store.spark, batch))
            saved = save_messages(store, inbound)
            tasks = index_tasks(inbound) if worker else []
            if worker:
                worker.enqueue(tasks)
            yield saved | {"tasks": len(tasks), "batches": 1}

    return {"messages": 0, "attachments": 0, "tasks": 0, "batches": 0} | count_batches(batches())


def index_contents(store: DataStore, todo: DataFrame) -> None:
    """Chunks and vectors of contents (as ``index.pending`` gives them), in place of earlier ones."""
    todo = materialise(todo)
    local = todo.filter("content_type = 'local_file'").join(store.read("local_files").select("content_id", "path"), "content_id")
    contents = todo.filter("data is not null").select("content_id", "mime_type", "filename", "data").unionByName(files.load(local).select("content_id", "mime_type", "filename", "data"))
    pages = files.page_texts(contents).unionByName(todo.filter("text is not null").select("content_id", F.lit(1).alias("page"), "text"))
    texts = materialise(index.chunk_pages(pages))
    vectors = materialise(index.embed_chunks(texts, todo, now()))
    store.write("attachment_texts", index.replace_content(store.read("attachment_texts"), texts))
    store.write("embeddings", index.replace_content(store.read("embeddings"), vectors))


def index_pending(store: DataStore, limit: int | None = None) -> int:
    """Index what has no chunks yet; returns the number of contents taken."""
    todo = materialise(index.pending(store.read("content_registry"), store.read("attachment_texts"), store.read("messages"), store.read("attachments"), store.read("local_files"), limit))
    index_contents(store, todo)
    return todo.count()


def index_one(store: DataStore, content_id: str) -> bool:
    """Index one content anew; false if it is not registered or has no bytes or text."""
    one = store.read("content_registry").filter(F.col("content_id") == content_id)
    nothing = store.read("attachment_texts").limit(0)
    todo = materialise(index.pending(one, nothing, store.read("messages"), store.read("attachments"), store.read("local_files")))
    if todo.isEmpty():
        return False
    index_contents(store, todo)
    return True


def extract_entities(store: DataStore, extractor: extract.Extractor, content_id: str | None = None, limit: int | None = None) -> dict[str, int]:
    """Mentions, nodes and edges of the chunks the extractor has not read; returns the counters."""
    segs = materialise(graph.segments(store.read("attachment_texts"), store.read("content_registry"), store.read("attachments"), store.read("messages"), store.read("entity_mentions"), extractor.name, content_id, limit))
    found = materialise(extract.extract_mentions(segs, extractor))
    m, n, r, read = (materialise(d) for d in graph.build(segs, found, extractor.name, now(), store.read("entity_mentions"), store.read("graph_entities"), store.read("graph_relations")))
    for name, df in (("entity_mentions", m), ("graph_entities", n), ("graph_relations", r)):
        store.write(name, df)
    return {"segments": read.count(), "mentions": m.count(), "nodes": n.count(), "edges": r.count()}


def build_facts(store: DataStore, table: str, extractor: str, content_id: str | None = None) -> int:
    """Facts of one table built anew from the mentions of an extractor; returns the number of new rows."""
    new = materialise(FACTS[table](store.read("entity_mentions"), extractor, now(), content_id))
    store.write(table, facts.replace_chunks(store.read(table), new))
    return new.count()


def handlers(store: DataStore, extractor: extract.Extractor, fact_extractors: dict[str, str] | None = None) -> dict[str, Handler]:
    """The worker's handlers: indexing leads to extraction, extraction to the three kinds of facts.

    Laboratory facts are built from the extractor that has just run, the others
    from those named for them.
    """
    named = {"lab_results": extractor.name} | (fact_extractors or {})

    def content_of(payload: dict) -> str:
        if not payload.get("content_id"):
            raise ValueError("the task names no content_id")
        return payload["content_id"]

    def on_index(payload: dict):
        return follow_ups("semantic_index", payload, named) if index_one(store, content_of(payload)) else []

    def on_extract(payload: dict):
        read = extract_entities(store, extractor, content_of(payload))["segments"]
        return follow_ups("entity_extract", payload, named) if read else []

    def on_facts(table: str) -> Handler:
        def run(payload: dict):
            build_facts(store, table, payload.get("extractor") or named.get(table, extractor.name), payload.get("content_id"))
            return []

        return run

    return {"semantic_index": on_index, "entity_extract": on_extract} | {t: on_facts(t) for t in FACTS}
