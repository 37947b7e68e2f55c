"""From mail to facts over a store, by the command line and the worker."""

import json
import random

import pytest
from pyspark.sql import functions as F

from knowloom import cli
from knowloom.agent import base, orchestrator
from knowloom.operators import extract, facts, fts, graph
from knowloom.sources import mail
from knowloom.storage import Store

BODY = "U2VlIElOVi0xMjM0IG9mIDIwMjMtMDgtMTYsIHRvdGFsIElOUiA1LDAwMC4gVFNIIHdhcyA0LjUgbW1vbC9MLg"
RECEIVED = [{"name": "Received", "value": f"from host {i}"} for i in range(3)]


class Client:
    """A provider with two messages on two pages."""

    def __init__(self):
        self.asked = []

    def list_page(self, query, size, token):
        return (["1"], "more") if token is None else (["2"], None)

    def get(self, one):
        headers = [*RECEIVED, {"name": "subject", "value": "old"}, {"name": "Subject", "value": f"Bill {one}"}, {"name": "From", "value": "ann@x.example"}, {"name": "To", "value": "bo@y.example, , cy@z.example"}]
        parts = [{"mimeType": "text/plain", "filename": "", "body": {"data": BODY}}, {"mimeType": "text/plain", "filename": "note.txt", "body": {"attachmentId": f"a{one}", "size": 9}}]
        return {"id": one, "threadId": "t", "payload": {"headers": headers, "parts": parts}}

    def attachment(self, message, one):
        self.asked.append(one)
        return "UmVjZWlwdCBSQy05OTk5"


def test_repeated_headers_and_attachment_bytes(spark):
    client = Client()
    m = mail.decode_messages(mail.payload_frame(spark, mail.search(client, "q"))).orderBy("id").collect()
    assert [r.subject for r in m] == ["Bill 1", "Bill 2"] and m[0].recipients == ["bo@y.example", "cy@z.example"]
    assert bytes(m[0].attachments[0].data) == b"Receipt RC-9999" and client.asked == ["a1", "a2"]
    assert m[0].received_at.timestamp() == 0 and m[0].attachments[0].metadata == {"size": "9"}
    bare = spark.createDataFrame([("a7", "7", "f", "t", None, None)], "id string, message_id string, filename string, mime_type string, data binary, metadata string")
    assert bytes(mail.load_attachments(bare, Client).first().data) == b"Receipt RC-9999"


def test_commands_from_mail_to_answer(spark, tmp_path, capsys, monkeypatch):
    store = str(tmp_path / "store")
    run = lambda *a: cli.main(["--store", store, *a])
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    monkeypatch.setattr(cli.logs, "configure", lambda *a: None)
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "lab.md").write_text("TSH 4.5 mmol/L on 2023-08-16")
    run("fetch-mail", "--client", "tests.test_pipeline:Client", "--query", "q", "--batch-size", "1")
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"messages": 2, "attachments": 2, "tasks": 4, "batches": 2}
    run("add-files", str(tmp_path / "files"))
    run("worker", "--run-once", "--lease", "20")
    # 5 contents indexed, 5 read, 15 builds of facts.
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"tasks": 25}
    s = Store(spark, store)
    assert s.read("task_queue").count() == 0 and s.read("attachment_texts").count() == 5
    assert s.read("lab_results").filter("test_name = 'TSH'").count() == 3
    assert {r.reference for r in s.read("financial_records").collect()} == {"INV-1234"}
    run("search", "bill receipt", "--top-k", "2")
    assert len(capsys.readouterr().out.splitlines()) == 2
    run("export-graph", str(tmp_path / "out"))
    run("export-graph", str(tmp_path / "out"), "--clear-existing")
    assert spark.read.parquet(str(tmp_path / "out" / "nodes")).count() == s.read("graph_entities").count()
    capsys.readouterr()
    run("ask", "nobody", "how much?", "--chat", "tests.test_pipeline:Parrot")
    run("agent", "which tests?", "--chat", "tests.test_pipeline:Parrot")
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "said" and out[1] == "said"


class Parrot:
    def chat(self, prompt):
        return "said" if "Payments found" in prompt else '{"action": "final", "answer": "said"}'


def test_payments_read_the_currency_of_both_names(spark):
    p = lambda canonical, *aliases, **k: json.dumps({"canonical": canonical, "aliases": list(aliases), **k})
    nodes = spark.createDataFrame([("o", "ORGANIZATION", p("builder")), ("c", "Content", json.dumps({"content_type": "message", "message_id": "1"})), ("m", "MONEY", p("total in usd", "1500"))], "entity_id string, label string, properties string")
    rel = spark.createDataFrame([("o", "c"), ("m", "c")], "source_id string, target_id string").withColumn("relation_type", F.lit("MENTIONED_IN"))
    r = graph.payments(nodes, rel, "Builder").first()
    assert (r.amount, r.amount_text, r.currency, r.content_type, r.message_id) == (1500.0, "1500", "USD", "message", "1")


def test_export_merges_until_cleared(spark, tmp_path):
    nodes = lambda *ids: spark.createDataFrame([(i, "L", "{}") for i in ids], "entity_id string, label string, properties string")
    rel = spark.createDataFrame([("r", "a", "b", "T", "{}"), ("s", "a", "zz", "T", "{}")], "relation_id string, source_id string, target_id string, relation_type string, properties string")
    path = str(tmp_path / "g")
    assert graph.export(nodes("a", "b"), rel, path) == (2, 2)
    graph.export(nodes("b", "c"), rel.filter("false"), path)
    assert spark.read.parquet(f"{path}/nodes").count() == 3 and spark.read.parquet(f"{path}/edges").count() == 1
    graph.export(nodes("b", "c"), rel.filter("false"), path, clear=True)
    assert spark.read.parquet(f"{path}/nodes").count() == 2 and spark.read.parquet(f"{path}/edges").count() == 0


@pytest.mark.parametrize("tokens", [["insur"], ["villa_15"], ["caf", "insur"], ["nothing"], ["a@b"], []])
def test_the_index_ranks_like_the_scan(spark, tokens):
    rows = [("1", "Insurance for Villa 157", "café", "b", "villa and 15 insurances"), ("2", None, None, None, "Villa 15 insure insured CAFÉ"), ("3", "villa", "15", None, None), ("4", None, None, None, None), ("5", "x", "y", "z", "other words here")]
    m = spark.createDataFrame(rows, "id string, subject string, sender string, recipients string, body string")
    scan, index = fts.bm25(m, tokens), fts.bm25_of_index(fts.postings(m), tokens)
    show = lambda df: df if df is None else {(r.message_id, round(r["rank"], 9)) for r in df.collect()}
    assert show(scan) == show(index)


def test_nearest_against_all_pairs(spark):
    rng = random.Random(4)
    mention = lambda i: (f"m{i}", "x", "c" + str(rng.randrange(3)), rng.randrange(2), "E", rng.choice(("A", "B", "T")), f"t{i}", (s := rng.randrange(60)), s + rng.randrange(1, 9), "{}")
    rows = [mention(i) for i in range(120)]
    df = spark.createDataFrame(rows, "mention_id string, extractor string, content_id string, chunk_index int, entity_id string, label string, text string, start_char int, end_char int, metadata string")
    got = facts.nearest_of(df.filter("label = 'T'"), {"a": df.filter("label = 'A'"), "b": df.filter("label = 'B'")})
    for r in got.collect():
        for kind in "ab":
            options = [o for o in rows if o[5] == kind.upper() and o[2:4] == (r.content_id, r.chunk_index)]
            want = min(options, key=lambda o: (min(abs(r.start_char - o[8]), abs(o[7] - r.end_char)), o[7], o[0]), default=None)
            assert (r[kind].mention_id if r[kind] else None) == (want[0] if want else None)


def test_planner_ends_on_an_unknown_action_and_keeps_the_window():
    seen = []
    search = base.Tool("semantic_search", "", (), lambda ctx, **p: base.Result.ok({"results": [{"message_id": "m"}, {"message_id": "m"}]}))
    context = base.Tool("fetch_message_context", "", (), lambda ctx, **p: seen.append(p) or base.Result.ok({"messages": []}))

    class Script:
        replies = ['{"action": "call_tool", "tool": "semantic_search", "params": {"query": "q", "thread_window": 9}}', '{"action": "ponder"}']

        def chat(self, prompt):
            return self.replies.pop(0)

    tools = {"semantic_search": search, "fetch_message_context": context}
    a = orchestrator.Orchestrator(Script(), base.Executor(tools, base.Context())).run("q?")
    assert a.text == orchestrator.NO_ANSWER and seen == [{"message_id": "m", "thread_window": 9, "include_body": True}]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('Sure: {"action": "final", "answer": "x {y}"} bye', {"action": "final", "answer": "x {y}"}),
        ('{"a": 1} then {"action": "call_tool", "tool": "t"}', {"action": "call_tool", "tool": "t"}),
        ("[1]", None), ("", None), ("Tool: x", None), ("Action: ponder", {"action": "ponder"}),
        ("Action: Call_Tool\nNext tool: lab_results\nParams: {\"test\": \"tsh\"}", {"action": "call_tool", "tool": "lab_results", "params": {"test": "tsh"}}),
        ("Action: call_tool\nI would use semantic_search here", {"action": "call_tool", "tool": "semantic_search", "params": {}}),
        ("Action: final\nAnswer: it is: 4", {"action": "final", "answer": "it is: 4"}),
    ],
)
def test_replies(reply, want):
    assert orchestrator.parse_reply(reply) == want


def test_model_extraction_takes_other_names_and_batches(spark):
    prompts = []

    def call(prompt):
        prompts.append(prompt)
        return {"response": '[{"span": " urea ", "type": "LAB_TEST"}, {"text": "5"}, {"text": ""}, 7]'}

    e = extract.ModelExtractor(call, "m", "List them.")
    assert [(m.text, m.label) for m in e.extract(" urea 5 ")] == [("urea", "LAB_TEST"), ("5", "ENTITY")]
    assert prompts == ["List them.\n\nText:\nurea 5"]
    assert [len(x) for x in e.extract_all(["urea 5", "none", "urea"])] == [2, 0, 1]
    df = spark.createDataFrame([("c", 0, " urea 5 "), ("c", 1, None), ("c", 2, " ")], "content_id string, chunk_index int, text string")
    assert extract.extract_mentions(df, extract.PatternExtractor()).count() == 1


def test_a_stream_of_payloads_fills_the_store(spark, tmp_path):
    from knowloom.streaming import stages
    from knowloom.streaming.worker import ingest_stream, queue_state_stream

    store, client = Store(spark, str(tmp_path / "store")), Client()
    (tmp_path / "in").mkdir()
    for i in ("1", "2"):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(mail.with_attachment_data(client, client.get(i))))
    stream = spark.readStream.schema(mail.PROVIDER_MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    save = lambda df, batch: stages.save_messages(store, mail.decode_messages(df))
    ingest_stream(stream, save, str(tmp_path / "state")).awaitTermination(120)
    assert store.read("messages").count() == 2 and store.read("attachments").count() == 2 and store.read("content_registry").count() == 4
    # A batch that comes again changes nothing.
    before = {tuple(r) for r in store.read("messages").collect()}
    save(spark.read.schema(mail.PROVIDER_MESSAGE).json(str(tmp_path / "in")), 9)
    assert {tuple(r) for r in store.read("messages").collect()} == before
    assert fts.bm25_of_index(store.index(), ["bill"]).count() == 2
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "e.json").write_text("\n".join(json.dumps({"task_id": t, "status": s, "ts": f"2025-01-01T00:0{i}:00Z"}) for i, (t, s) in enumerate([("a", "pending"), ("b", "pending"), ("a", "completed")])))
    events = spark.readStream.schema("task_id string, status string, ts timestamp").json(str(tmp_path / "events"))
    q = queue_state_stream(events).writeStream.outputMode("complete").format("memory").queryName("queue_state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.task_id, r.status) for r in spark.table("queue_state").collect()} == {("a", "completed"), ("b", "pending")}
