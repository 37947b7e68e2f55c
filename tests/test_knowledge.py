import json

import pytest
from pyspark.sql import functions as F

from knowloom.agent import base, orchestrator, tools
from knowloom.operators import extract, facts, fts, graph, index, lookups, merge, retrieve
from knowloom.operators import task_queue as tq
from knowloom.schemas import ENTITY_MENTIONS, empty
from knowloom.sources import files, mail
from knowloom.streaming.worker import Worker, follow_ups



def now():
    """The time of all tests, as a column once a session exists."""
    return F.lit("2025-01-01T00:00:00+00:00")


MAILS = [
    ("msg-adarsh", "Villa 15 handover", "Adarsh Builder <sales@adarshbuilder.test>", "owner@example.test", "The builder shared the last update on villa handover with Adarsh team"),
    ("msg-bank", "Home loan statement", "service@bank.test", "owner@example.test", "Your home loan account number ends in 1234 and the bank statement is attached"),
    ("msg-generic", "Reminder", "reminder@example.test", "owner@example.test", "This is a reminder about the weekly meeting"),
]


def corpus(spark):
    m = spark.createDataFrame(MAILS, "id string, subject string, sender string, recipients string, body string")
    texts = spark.createDataFrame([(i, 1, 0, b) for i, _, _, _, b in MAILS], "content_id string, page int, chunk_index int, text string")
    meta = {i: json.dumps({"message_id": i, "subject": s, "sender": x, "recipients": r, "source": "message"}) for i, s, x, r, _ in MAILS}
    vec = texts.withColumn("metadata", F.create_map(*(F.lit(x) for kv in meta.items() for x in kv))[F.col("content_id")])
    from knowloom.functions.embed import HashedEmbedder

    return m, texts, vec.select("content_id", "chunk_index", F.lit("m").alias("model"), HashedEmbedder().embed(F.col("text")).alias("vector"), "metadata")


def test_search_order(spark):
    m, texts, vec = corpus(spark)
    top = lambda q: [r.content_id for r in retrieve.search(texts, vec, m, q, 3).collect()]
    assert top("last conversation with Adarsh builder")[0] == "msg-adarsh"
    assert top("home loan account number")[0] == "msg-bank"
    got = retrieve.search(texts, vec, m, "bank home loan", 3).collect()
    assert got[0].content_id == "msg-bank" and got[0].score > got[1].score
    assert retrieve.search(texts, vec.withColumn("metadata", F.lit("{'bad'")), m, "home", 1).first().filename is None


def test_full_text(spark):
    m = corpus(spark)[0]
    assert {r.message_id for r in fts.bm25(m, ["builder"]).collect()} == {"msg-adarsh"}
    assert fts.bm25(m, ["villa_15"]).count() == 1 and fts.bm25(m, ["villa_16"]).count() == 0
    assert fts.bm25(m, ["a@b"]) is None and fts.bm25(m, []) is None
    assert fts.fold_term("Café") == ["cafe"]


def mentions(spark, rows):
    data = [(f"m{i}", "x", "c", 0, f"{lab}:{t}", lab, t, a, b, 1.0, json.dumps({"attributes": at} if at else {}), "t") for i, (t, lab, a, b, at) in enumerate(rows)]
    return spark.createDataFrame(data, ENTITY_MENTIONS)


def test_lab_fact(spark):
    m = mentions(spark, [("HbA1c", "LAB_TEST", 0, 5, None), ("5.6%", "MEASUREMENT", 20, 24, {"value": "5.6", "units": "%"}), ("4.0-5.7", "REFERENCE_RANGE", 30, 37, None), ("2023-08-16", "DATE", 40, 50, None), ("Akshat", "PATIENT", 55, 61, None)])
    r = facts.lab_results(m, "x", now()).collect()
    assert len(r) == 1 and (r[0].test_name, r[0].measurement_value, r[0].measurement_units, r[0].patient, r[0].date_parsed, r[0].reference_range) == ("HbA1c", 5.6, "%", "Akshat", "2023-08-16", "4.0-5.7")
    assert facts.lab_results(m.filter("false"), "x", now()).count() == 0


def test_financial_fact(spark):
    m = mentions(spark, [("Invoice", "INVOICE", 0, 7, None), ("INR 1500", "MONEY", 20, 28, {"currency": "INR", "amount": 1500}), ("2023-08-01", "DATE", 40, 50, None), ("Dezignare", "ORGANIZATION", 60, 69, None), ("INV-42", "INVOICE_REFERENCE", 70, 76, None)])
    r = facts.financial_records(m, "x", now()).first()
    assert (r.record_type, r.amount_value, r.currency, r.counterparty, r.reference, r.date_parsed) == ("INVOICE", 1500.0, "INR", "Dezignare", "INV-42", "2023-08-01")


def test_medical_fact(spark):
    m = mentions(spark, [("Metformin", "MEDICATION", 0, 9, None), ("500 mg daily", "DOSAGE", 15, 27, None), ("Akshat", "PATIENT", 35, 41, None), ("Dr. Singh", "CLINICIAN", 45, 54, None), ("City Hospital", "FACILITY", 60, 73, None), ("2023-08-20", "DATE", 80, 90, None)])
    r = facts.medical_events(m, "x", now()).first()
    assert (r.event_type, r.description, r.patient, r.clinician, r.facility, json.loads(r.attributes)["dosage"]) == ("MEDICATION", "Metformin", "Akshat", "Dr. Singh", "City Hospital", "500 mg daily")


def test_nearest_takes_the_earlier_on_ties(spark):
    m = mentions(spark, [("1", "MEASUREMENT", 50, 60, None), ("a", "LAB_TEST", 30, 40, None), ("b", "LAB_TEST", 70, 80, None)])
    t = facts.nearest(m.filter("label = 'MEASUREMENT'"), m.filter("label = 'LAB_TEST'"), "o").first()
    assert t.o.text == "a"


def test_graph_build_is_repeatable(spark):
    segs = spark.createDataFrame([("c1", 1, 0, " HbA1c 5.6 % for a@b.test ", "m", None, "message", "f", "s")], "content_id string, page int, chunk_index int, text string, message_id string, attachment_id string, content_type string, filename string, subject string")
    e = extract.PatternExtractor()
    found = extract.extract_mentions(segs, e)
    state = (empty(spark, "entity_mentions"), empty(spark, "graph_entities"), empty(spark, "graph_relations"))
    first = graph.build(segs, found, e.name, now(), *state)
    again = graph.build(segs, found, e.name, now(), *first[:3])
    assert [df.count() for df in first[:3]] == [df.count() for df in again[:3]] == [3, 4, 3]
    assert graph.export_edges(again[2], again[1]).count() == 3
    m, n, _ = graph.remove_extractor(*again[:3], prefix="pattern:")
    assert m.count() == 0 and n.count() == 0


def test_payments(spark):
    p = lambda c, *a: json.dumps({"canonical": c, "aliases": list(a)})
    nodes = spark.createDataFrame([("o", "ORGANIZATION", p("builder")), ("c", "Content", "{}"), ("m1", "MONEY", p("rs. 1 lakh")), ("m2", "MONEY", p("some money", "INR 200000"))], "entity_id string, label string, properties string")
    rel = spark.createDataFrame([("o", "c"), ("m1", "c"), ("m2", "c"), ("m2", "c")], "source_id string, target_id string").withColumn("relation_type", F.lit("MENTIONED_IN"))
    got = graph.payments(nodes, rel, "Builder")
    assert {r.currency: r.total for r in graph.totals(got).collect()} == {"INR": 300000.0}


def test_merges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in merge.last_wins(old, new, ["k"], "v").collect()} == {("a", 1), ("b", 3), ("c", 2)}
    assert {tuple(r) for r in merge.first_wins(old, new, ["k"], "v").collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert merge.last_wins(old, new.filter("false"), ["k"]).count() == 2


def test_chunk_numbers_run_on(spark):
    pages = spark.createDataFrame([("c", 1, "x" * 1500), ("c", 2, "  "), ("c", 300, "y"), ("d", 1, None)], "content_id string, page int, text string")
    assert [(r.page, r.chunk_index) for r in index.chunk_pages(pages).orderBy("chunk_index").collect()] == [(1, 0), (1, 1), (300, 2)]


def test_mail_decode(spark):
    body = "SGVsbG8gd29ybGQ"
    payload = {"id": "1", "threadId": "t", "snippet": "s", "internalDate": "1692144000000", "payload": {"headers": [{"name": "SUBJECT", "value": "Hi"}, {"name": "To", "value": "a@x, ,b@y"}], "parts": [{"mimeType": "text/plain", "filename": "", "body": {"data": body}}, {"filename": "f.txt", "mimeType": "text/plain", "body": {"attachmentId": "att", "data": body}}]}}
    m = mail.decode_messages(mail.payload_frame(spark, [payload])).cache()
    r = m.first()
    assert (r.subject, r.body, r.recipients, r.attachments[0].filename) == ("Hi", "Hello world", ["a@x", "b@y"], "f.txt")
    reg = mail.registry_rows(m, now()).collect()
    assert sorted(x.content_id for x in reg) == ["attachment:1:att", "message:1"]

    class Client:
        def list_page(self, q, n, token):
            return ["1", "2"], "next" if token is None else None

        def get(self, i):
            return {"id": i}

    assert len(list(mail.search(Client(), "q", limit=3))) == 3 and len(list(mail.search(Client(), "q", limit=-1))) == 4
    with pytest.raises(ValueError):
        next(mail.search(Client(), "q", page_size=501))


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("héllo".encode("latin-1"))
    (tmp_path / "b.md").write_text("same")
    (tmp_path / "c.md").write_text("same")
    (tmp_path / "d.png").write_bytes(b"x")
    rows, local = files.registrations(files.scan(spark, str(tmp_path)), empty(spark, "content_registry"), now())
    assert rows.count() == 2 and local.count() == 2
    c = spark.createDataFrame([("1", "text/plain", "a.txt", bytearray("héllo".encode("latin-1"))), ("2", "image/png", "x.png", bytearray(b"1")), ("3", "application/pdf", "x.pdf", bytearray(b"1"))], "content_id string, mime_type string, filename string, data binary")
    files.register_pdf_reader(lambda data: ["", "two"])
    try:
        assert {(r.content_id, r.page, r.text) for r in files.page_texts(c).collect()} == {("1", 1, "héllo"), ("3", 1, ""), ("3", 2, "two")}
    finally:
        files._PDF_READER.clear()
    a = spark.createDataFrame([("1", "m", "f.txt", bytearray(b"a")), ("2", "m", "f.txt", bytearray(b"b"))], "id string, message_id string, filename string, data binary")
    files.export(a, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f.txt", "f_1.txt"]


def test_message_context(spark):
    m = spark.createDataFrame([(f"m{i}", "t", "s", "x", "a, b", "", "b", f"2023-08-0{i + 1} 00:00:00", None) for i in range(4)] + [("lone", None, "s", "x", None, "", "b", None, None)], "id string, thread_id string, subject string, sender string, recipients string, snippet string, body string, received_at string, metadata string")
    m = m.withColumn("received_at", F.col("received_at").cast("timestamp"))
    a = spark.createDataFrame([("a1", "m3", "f", "t")], "id string, message_id string, filename string, mime_type string")
    assert [r.id for r in lookups.message_context(m, a, "m0", 2).collect()] == ["m2", "m3"]
    assert [r.id for r in lookups.message_context(m, a, "m0", 0).collect()] == ["m0"]
    assert [r.id for r in lookups.message_context(m, a, "lone").collect()] == ["lone"]
    assert lookups.message_context(m, a, "none").count() == 0


def test_queue_life(spark, tmp_path):
    backend = tq.TableBackend(spark, str(tmp_path / "q"))
    seen = []
    times = iter(f"2025-01-01 00:{i:02d}:00" for i in range(60))

    def handler(payload):
        seen.append(payload["content_id"])
        if len(seen) == 1:
            raise RuntimeError("x" * 3000)
        return []

    w = Worker(spark, backend, {"semantic_index": handler}, lambda: next(times))
    w.enqueue([("semantic_index", {"content_id": "c"})] * 2)
    assert backend.load().count() == 1
    assert w.run() == 1
    row = backend.load().first()
    assert (row.status, row.attempts, len(row.last_error)) == ("pending", 1, 1024)
    for _ in range(6):
        next(times)
    assert w.run() == 1 and backend.load().count() == 0
    q = spark.createDataFrame([("1", "t", "in_progress", "{}", 4)], "task_id string, task_type string, status string, payload string, attempts int")
    full = q.select("*", *(F.lit(None).cast("timestamp").alias(c) for c in ("available_at", "locked_at", "created_at", "updated_at")), F.lit(None).cast("string").alias("last_error"))
    assert tq.fail(full, "1", "e", F.lit("2025-01-01").cast("timestamp")).first().status == "failed"
    assert [k for k, _ in follow_ups("entity_extract", {"content_id": "c"}, {})] == ["lab_results", "financial_records", "medical_events"]
    with pytest.raises(ValueError):
        tq.open_backend(spark, "redis://x")


def test_model_extractor_payloads():
    text = "HbA1c was 5.6 percent"
    for reply in ({"response": '[{"text": "hba1c", "label": "LAB_TEST"}]'}, {"output": '```json\n{"entities": [{"text": "HbA1c", "label": "LAB_TEST", "start": 3, "end": 5}]}\n```'}, {"choices": [{"message": {"content": '{"text": "HbA1c", "label": "LAB_TEST"}'}}]}):
        m = extract.ModelExtractor(lambda p, r=reply: r, "m").extract(text)
        assert [(x.label, x.start, x.end) for x in m] == [("LAB_TEST", 0, 5)]
    assert extract.ModelExtractor(lambda p: {"response": "no json"}, "m").extract(text) == []


class Script:
    def __init__(self, *replies):
        self.replies = list(replies)

    def chat(self, prompt):
        return self.replies.pop(0)


def run(tool_map, *replies):
    return orchestrator.Orchestrator(Script(*replies), base.Executor(tool_map, base.Context())).run("q?")


def test_planner_loop():
    echo = base.Tool("echo", "", (), lambda ctx, **p: base.Result.ok({"results": [p]}))
    a = run({"echo": echo}, "Action: call_tool\nTool: echo\nParams: {\"x\": 1}", '{"action": "final", "answer": "done"}')
    assert a.text == "done" and a.calls[0].params == {"x": 1}
    assert "nope" in run({}, '{"action": "call_tool", "tool": "nope"}').text
    assert run({}, "gibberish").text == orchestrator.NO_ANSWER
    assert orchestrator.parse_reply("Action: call_tool\nNote: use semantic_search next")["tool"] == "semantic_search"
    none = base.Tool("lab_results", "", (), lambda ctx, **p: base.Result.ok({"results": []}))
    search = base.Tool("semantic_search", "", (), lambda ctx, **p: base.Result.ok({"results": [{"message_id": "m"}]}))
    a = run({"lab_results": none, "semantic_search": search}, '{"action": "call_tool", "tool": "lab_results"}', '{"action": "final", "answer": "x"}')
    assert [c.tool for c in a.calls] == ["lab_results", "semantic_search"]


def test_tool_guards(spark):
    ex = base.Executor(tools.registry(), base.Context({"messages": empty(spark, "messages")}))
    for name in ("finance_payments", "semantic_search", "fetch_message_context", "no_tool"):
        assert not ex.execute(name, {}).success
    assert ex.execute("fetch_message_context", {"message_id": "x"}).error.endswith("not found")
