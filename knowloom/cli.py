"""Command line: ``python -m knowloom.cli COMMAND --store FOLDER ...``; tables are Parquet folders of the store."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from datetime import datetime, timezone

from pyspark.sql import functions as F

from knowloom import logs
from knowloom.agent import base, orchestrator, tools
from knowloom.config import load_settings
from knowloom.functions.text import shorten
from knowloom.operators import extract, graph, lookups, retrieve
from knowloom.operators.task_queue import open_backend
from knowloom.session import build_session
from knowloom.sources import files, mail
from knowloom.storage import Store
from knowloom.streaming import stages
from knowloom.streaming.worker import Worker


def _worker(store: Store, a, handlers=None) -> Worker:
    clock = lambda: datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return Worker(store.spark, open_backend(store.spark, a.queue or f"{store.path}/task_queue"), handlers or {}, clock, getattr(a, "lease", 1))


def _made(name: str):
    """The object that ``package.module:maker`` makes."""
    module, maker = name.split(":")
    return getattr(importlib.import_module(module), maker)()


def _payloads(store: Store, a):
    """Payloads of a provider's client, or of stored JSON lines."""
    if a.client:
        return mail.search(_made(a.client), a.query, a.limit, a.page_size)
    stored = mail.read_payloads(store.spark, a.path)
    if a.limit is not None and a.limit >= 0:
        stored = stored.orderBy("internalDate", "id").limit(a.limit)
    return (r.asDict(True) for r in stored.toLocalIterator())


def fetch_mail(store: Store, a) -> None:
    """Mail of a provider, or stored payloads, into messages, attachments, registry and queue."""
    print(json.dumps(stages.ingest(store, _payloads(store, a), a.batch_size, _worker(store, a))))


def add_files(store: Store, a) -> None:
    """Files of a folder into registry and queue, those already known left out."""
    found = files.scan(store.spark, a.path, tuple(a.extensions), a.recursive)
    rows, local = files.registrations(found, store.read("content_registry"), stages.now())
    local = local.persist()
    ids = [r["content_id"] for r in local.select("content_id").toLocalIterator()]
    store.upsert("content_registry", rows)
    store.upsert("local_files", local)
    _worker(store, a).enqueue([("semantic_index", {"content_id": i}) for i in ids])
    print(json.dumps({"files": len(ids)}))


def run_index(store: Store, a) -> None:
    """Chunks and vectors of all contents without them."""
    print(json.dumps({"processed": stages.index_pending(store, a.limit)}))


def _extractor(a) -> extract.Extractor:
    call = extract.HttpModel(a.model, a.endpoint, a.timeout) if a.backend == "llm" else None
    return extract.build(a.backend, a.model, call)


def run_extraction(store: Store, a) -> None:
    """Mentions and graph of all chunks not read yet."""
    print(json.dumps(stages.extract_entities(store, _extractor(a), a.content_id, a.limit)))


def run_worker(store: Store, a) -> None:
    """Work on the queue: index, extract, build facts."""
    e = _extractor(a)
    named = {"lab_results": a.lab_extractor or e.name, "financial_records": a.financial_extractor or e.name, "medical_events": a.medical_extractor or e.name}
    every = stages.handlers(store, e, named)
    wanted = {k: h for k, h in every.items() if not a.task_types or k in a.task_types}
    w = _worker(store, a, wanted)
    print(json.dumps({"tasks": w.run(once=a.run_once, wait=lambda: time.sleep(a.poll_interval))}))


def build_facts(store: Store, a) -> None:
    """Facts of one table from the mentions of an extractor."""
    print(json.dumps({"rows": stages.build_facts(store, a.table, a.extractor, a.content_id)}))


def ask(store: Store, a) -> None:
    """A model's answer about the payments of a counterparty."""
    found = graph.payments(store.read("graph_entities"), store.read("graph_relations"), a.counterparty, a.limit).persist()
    mentions = [r.asDict() for r in found.limit(tools.MOST).collect()]
    totals = {r["currency"]: r["total"] for r in graph.totals(found).collect()}
    model = _made(a.chat) if a.chat else extract.HttpModel(a.model, a.endpoint, a.timeout)
    print(orchestrator.finance_summary(model, a.question, mentions, totals).strip())
    for m in mentions:
        print(json.dumps(m, ensure_ascii=False))


def agent(store: Store, a) -> None:
    """Questions answered by a model that calls the tools."""
    names = ("messages", "attachments", "attachment_texts", "embeddings", "lab_results", "financial_records", "medical_events", "graph_entities", "graph_relations")
    context = base.Context({n: store.read(n) for n in names} | {"message_index": store.index()}, a.extractor)
    model = _made(a.chat) if a.chat else extract.HttpModel(a.model, a.endpoint, a.timeout)
    loop = orchestrator.Orchestrator(model, base.Executor(tools.registry(), context), a.max_loops)
    history: list[tuple[str, str]] = []
    question = a.question or (input("> ") if a.interactive else "")
    while question:
        answer = loop.run(question, history)
        history.append((question, answer.text))
        print(answer.text)
        for c in answer.calls:
            print(json.dumps({"tool": c.tool, "params": c.params, "result": c.result.to_dict()}, default=str, ensure_ascii=False)[:400])
        question = input("> ") if a.interactive else ""


def query_facts(store: Store, a) -> None:
    t = store.read(a.table)
    if a.table == "lab_results":
        df = lookups.fetch_lab_results(t, a.extractor, a.test, a.patient, a.subject, a.limit)
    elif a.table == "financial_records":
        df = lookups.fetch_financial_records(t, a.extractor, a.counterparty, a.record_type, a.reference, a.limit)
    else:
        df = lookups.fetch_medical_events(t, a.extractor, a.event_type, a.patient, a.limit)
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(True), default=str, ensure_ascii=False))


def run_search(store: Store, a) -> None:
    df = retrieve.search(store.read("attachment_texts"), store.read("embeddings"), store.index(), a.query, a.top_k)
    for r in df.withColumn("text", shorten(F.col("text"), 400)).toLocalIterator():
        print(json.dumps(r.asDict(True), default=str, ensure_ascii=False))


def export_graph(store: Store, a) -> None:
    n, e = graph.export(store.read("graph_entities"), store.read("graph_relations"), a.path, clear=a.clear_existing)
    print(json.dumps({"nodes": n, "edges": e}))


def show_payments(store: Store, a) -> None:
    found = graph.payments(store.read("graph_entities"), store.read("graph_relations"), a.counterparty, a.limit).cache()
    for r in found.toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False))
    print(json.dumps({r["currency"]: r["total"] for r in graph.totals(found).collect()}))


def extract_files(store: Store, a) -> None:
    t = store.read("attachments")
    if bool(a.filename) == bool(a.message_id):
        raise SystemExit("give either --filename or --message-id")
    t = t.filter(F.col("filename") == a.filename) if a.filename else t.filter(F.col("message_id") == a.message_id)
    files.export(t, a.path)


def cleanup(store: Store, a) -> None:
    m, n, r = (d.cache() for d in graph.remove_extractor(store.read("entity_mentions"), store.read("graph_entities"), store.read("graph_relations"), a.prefix))
    m.count(), n.count(), r.count()
    for name, df in (("entity_mentions", m), ("graph_entities", n), ("graph_relations", r)):
        store.write(name, df)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knowloom")
    p.add_argument("--store", default=None, help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *options: tuple[str, dict]) -> None:
        s = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        s.set_defaults(run=run)
        for flag, kw in options:
            s.add_argument(flag, **kw)

    n = lambda flag, default=None: (flag, {"type": int, "default": default})
    t = lambda flag, default=None: (flag, {"default": default})
    fact = ("table", {"choices": list(stages.FACTS)})
    queue = t("--queue")
    model = (("--backend", {"default": "pattern", "choices": ["pattern", "spacy", "llm"]}), t("--model", "default"), t("--endpoint", "http://localhost:11434/api/generate"), ("--timeout", {"type": float, "default": 180.0}))
    add("fetch-mail", fetch_mail, ("path", {"nargs": "?"}), t("--client"), t("--query", ""), n("--limit"), n("--page-size", 100), n("--batch-size", 200), queue)
    add("add-files", add_files, ("path", {}), ("--extensions", {"nargs": "+", "default": list(files.DEFAULT_EXTENSIONS)}), ("--recursive", {"action": "store_true"}), queue)
    add("index", run_index, n("--limit"))
    add("extract", run_extraction, *model, t("--content-id"), n("--limit"))
    add(
        "worker", run_worker, *model, queue, ("--run-once", {"action": "store_true"}), ("--poll-interval", {"type": float, "default": 5.0}), n("--lease", 1),
        ("--task-types", {"nargs": "*"}), t("--lab-extractor"), t("--financial-extractor"), t("--medical-extractor"),
    )
    add("ask", ask, ("counterparty", {}), ("question", {}), *model[1:], t("--chat"), n("--limit"))
    add("agent", agent, ("question", {"nargs": "?"}), *model[1:], t("--chat"), t("--extractor", "pattern:default"), ("--interactive", {"action": "store_true"}), n("--max-loops", 3))
    add("build-facts", build_facts, fact, t("--extractor", "pattern:default"), t("--content-id"))
    add("query-facts", query_facts, fact, t("--extractor", "pattern:default"), *(t(f"--{x}") for x in ("test", "patient", "subject", "counterparty", "record-type", "reference", "event-type")), n("--limit", 10))
    add("search", run_search, ("query", {}), n("--top-k", 5))
    add("export-graph", export_graph, ("path", {}), ("--clear-existing", {"action": "store_true"}))
    add("payments", show_payments, ("counterparty", {}), n("--limit"))
    add("extract-attachment", extract_files, ("path", {}), t("--filename"), t("--message-id"))
    add("cleanup", cleanup, t("--prefix", "spacy:"))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    s = load_settings(a.store)
    logs.configure(s.log_level, s.structured_logging)
    a.run(Store(build_session(), s.database), a)


if __name__ == "__main__":
    main()
