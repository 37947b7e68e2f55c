"""The five tools: each one DataFrame query, collected with a limit."""

from __future__ import annotations

from knowloom.agent.base import Context, Parameter, Result, Tool
from knowloom.operators import graph, lookups, retrieve

DEFAULT_EXTRACTOR = "llm:mistral"
#: Rows a tool hands to the model at most.
MOST = 200


def _rows(df, limit: int | None) -> list[dict]:
    return [r.asDict(True) for r in df.limit(min(limit if limit and limit > 0 else MOST, MOST)).collect()]


def _extractor(ctx: Context, given: str | None) -> str:
    return given or ctx.extractor or DEFAULT_EXTRACTOR


def finance_payments(ctx: Context, counterparty: str | None = None, limit: int | None = 20, **_) -> Result:
    if not counterparty:
        return Result.failed("counterparty is required")
    if "graph_entities" not in ctx.tables or "graph_relations" not in ctx.tables:
        return Result.failed("no graph is configured")
    found = graph.payments(ctx.tables["graph_entities"], ctx.tables["graph_relations"], counterparty, limit)
    mentions = _rows(found, limit)
    totals: dict[str, float] = {}
    for m in mentions:
        if m["amount"] is not None:
            key = m["currency"] or "UNKNOWN"
            totals[key] = totals.get(key, 0.0) + m["amount"]
    return Result.ok({"counterparty": counterparty, "mentions": mentions, "totals": totals})


def lab_results(ctx: Context, patient: str | None = None, test: str | None = None, limit: int = 20, extractor: str | None = None, **_) -> Result:
    df = lookups.fetch_lab_results(ctx.tables["lab_results"], _extractor(ctx, extractor), test, patient, None, limit)
    return Result.ok({"results": _rows(df, limit)})


def medical_events(ctx: Context, patient: str | None = None, event_type: str | None = None, limit: int = 20, extractor: str | None = None, **_) -> Result:
    df = lookups.fetch_medical_events(ctx.tables["medical_events"], _extractor(ctx, extractor), event_type, patient, limit)
    return Result.ok({"events": _rows(df, limit)})


def semantic_search(ctx: Context, query: str | None = None, top_k: int = 5, **_) -> Result:
    if not query:
        return Result.failed("query is required")
    t = ctx.tables
    df = retrieve.search(t["attachment_texts"], t["embeddings"], t.get("message_index", t["messages"]), query, top_k, ctx.embedder)
    return Result.ok({"results": _rows(df, top_k)})


def fetch_message_context(ctx: Context, message_id: str | None = None, thread_window: int = 5, include_body: bool = True, **_) -> Result:
    if not message_id:
        return Result.failed("message_id is required")
    t = ctx.tables
    if t["messages"].filter(t["messages"].id == message_id).isEmpty():
        return Result.failed(f"message {message_id} not found")
    return Result.ok({"messages": _rows(lookups.message_context(t["messages"], t["attachments"], message_id, thread_window, include_body), None)})


def registry() -> dict[str, Tool]:
    """All tools by name."""
    p = Parameter
    tools = (
        Tool("finance_payments", "Payments that mention a counterparty, with totals by currency.", (p("counterparty", "name of the counterparty", True), p("limit", "most rows")), finance_payments),
        Tool("lab_results", "Laboratory results by patient and test.", (p("patient", "part of the name"), p("test", "part of the test's name"), p("limit", "most rows"), p("extractor", "extractor to read from")), lab_results),
        Tool("medical_events", "Medical events by patient and kind.", (p("patient", "part of the name"), p("event_type", "kind of event"), p("limit", "most rows"), p("extractor", "extractor to read from")), medical_events),
        Tool("semantic_search", "Passages that fit a question.", (p("query", "the question", True), p("top_k", "passages wanted")), semantic_search),
        Tool("fetch_message_context", "A message with the latest messages of its thread.", (p("message_id", "id of the message", True), p("thread_window", "messages wanted"), p("include_body", "with bodies?")), fetch_message_context),
    )
    return {t.name: t for t in tools}
