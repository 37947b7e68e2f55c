"""Registered queries of the write path: mail, files, facts, queue and tools; each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions import embed, text, values
from knowloom.operators import extract, facts, fts, graph, index, lookups, merge, task_queue
from knowloom.schemas import empty
from knowloom.session import materialise, table
from knowloom.sources import files, mail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2025-01-01 00:00:00"
_ONE = "(SELECT DISTINCT ON (id) * FROM messages)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Mail ----------------------------------------------------------------------


def _base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The messages as a provider gives them: repeated and mixed-case headers, encoded body, one attachment each."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    header = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("string").alias("value"))
    headers = F.array(header("Received", F.lit("one")), header("Received", F.lit("two")), header("SUBJECT", F.lit("an older one")), header("Subject", F.coalesce("subject", F.lit(""))), header("From", F.col("sender")), header("to", F.col("recipients")))
    size = F.length("id").cast("long")
    part = lambda name, data, attachment: F.struct(F.lit(name).alias("filename"), F.lit("text/x-note" if name else "text/plain").alias("mimeType"), F.struct(data.alias("data"), attachment.cast("string").alias("attachmentId"), size.alias("size")).alias("body"), F.lit(None).cast(mail._HEADERS).alias("headers"))
    parts = F.array(part("", _base64url(F.col("body")), F.lit(None)), part("scan.txt", _base64url(F.concat(F.lit("Receipt "), "id")), F.concat(F.lit("att-"), "id")))
    return m.select("id", F.col("thread_id").alias("threadId"), "snippet", F.unix_millis("received_at").cast("string").alias("internalDate"), F.lit(None).cast("array<string>").alias("labelIds"), F.struct(F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"), F.lit(None).cast(mail._BODY).alias("body"), parts.alias("parts")).alias("payload"))


@query(f"""SELECT id, coalesce(subject, '') AS subject, coalesce(sender, '') AS sender, array_to_string(list_filter(list_transform(string_split(coalesce(recipients, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS recipients,
coalesce(snippet, '') AS snippet, coalesce(body, '') AS body, coalesce(epoch_ms(received_at), 0) AS received_ms, thread_id FROM {_ONE}""")
def mail_decode(spark: SparkSession, d: str) -> DataFrame:
    """Provider payloads as stored messages."""
    m = mail.stored_messages(mail.decode_messages(_payloads(spark, d)))
    return m.select("id", "subject", "sender", "recipients", "snippet", "body", F.unix_millis("received_at").alias("received_ms"), "thread_id")


@query(f"SELECT 'att-' || id AS id, id AS message_id, CASE WHEN received_at >= TIMESTAMPTZ '2021-01-01 00:00:00+00' THEN 'renamed.txt' ELSE 'scan.txt' END AS filename, 'text/x-note' AS mime_type, 'Receipt ' || id AS text, length(id)::VARCHAR AS size FROM {_ONE}")
def mail_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of the payloads, those of later mail saved a second time under another name."""
    inbound = mail.decode_messages(_payloads(spark, d))
    again = mail.stored_attachments(inbound.filter("received_at >= '2021-01-01'")).withColumn("filename", F.lit("renamed.txt"))
    saved = merge.last_wins(mail.stored_attachments(inbound), again, ["id", "message_id"])
    return saved.select("id", "message_id", "filename", "mime_type", F.decode("data", "UTF-8").alias("text"), F.get_json_object("metadata", "$.size").alias("size"))


@query(f"""SELECT 'message:' || id AS content_id, 'message' AS content_type, sha256(nullif(body, '')) AS sha256, NULL::VARCHAR AS filename, coalesce(subject, '') AS subject FROM {_ONE}
UNION ALL SELECT 'attachment:' || id || ':att-' || id, 'attachment', sha256('Receipt ' || id), 'scan.txt', coalesce(subject, '') FROM {_ONE}""")
def mail_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows of bodies and attachments with hash and provenance."""
    r = mail.registry_rows(mail.decode_messages(_payloads(spark, d)), F.lit(NOW))
    named = lambda *paths: F.coalesce(*(F.get_json_object("metadata", p) for p in paths))
    return r.select("content_id", "content_type", "sha256", named("$.filename").alias("filename"), named("$.message_subject", "$.subject").alias("subject"))


@query(f"""WITH o AS (SELECT id FROM {_ONE} WHERE subject IS NOT NULL), n AS (SELECT id FROM {_ONE} WHERE received_at >= TIMESTAMPTZ '2021-01-01 00:00:00+00' OR subject IS NULL)
SELECT 'message:' || coalesce(o.id, n.id) AS content_id, CASE WHEN n.id IS NOT NULL THEN 'new' ELSE 'old' END AS sha256, CASE WHEN o.id IS NOT NULL THEN '2020' ELSE '2021' END AS created_at FROM o FULL JOIN n ON o.id = n.id""")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Registry after contents were saved again: hash renewed, time of creation kept."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    rows = lambda df, sha, at: df.select(F.concat(F.lit("message:"), "id").alias("content_id"), F.lit(sha).alias("sha256"), F.lit(at).alias("created_at"))
    return merge.merge_registry(rows(m.filter("subject is not null"), "old", "2020"), rows(m.filter("received_at >= '2021-01-01' or subject is null"), "new", "2021"))


# Files ----------------------------------------------------------------------


def _as_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select(F.concat(F.lit("/notes/"), F.col("doc_id").cast("string"), F.lit(".MD")).alias("path"), F.lit(NOW).cast("timestamp").alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"), "lang")


@query("""WITH f AS (SELECT sha256(text) AS h, '/notes/' || doc_id || '.MD' AS path, lang FROM documents WHERE text IS NOT NULL), k AS (SELECT h FROM f WHERE lang = 'en')
SELECT 'file:' || h AS content_id, min(path) AS path, 'text/markdown' AS mime_type, split_part(min(path), '/', 3) AS filename FROM f WHERE h NOT IN (SELECT h FROM k) GROUP BY h""")
def file_registration(spark: SparkSession, d: str) -> DataFrame:
    """Files registered by content, the English ones being known before."""
    f = _as_files(spark, d)
    known = f.filter("lang = 'en'").select(F.concat(F.lit("file:"), F.sha2("content", 256)).alias("content_id"), F.sha2("content", 256).alias("sha256")).distinct()
    rows, local = files.registrations(f.drop("lang"), known, F.lit(NOW))
    return rows.join(local.select("content_id", "path"), "content_id").select("content_id", "path", "mime_type", F.get_json_object("metadata", "$.filename").alias("filename"))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def files_known(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of files that a registry of the English ones holds."""
    f = _as_files(spark, d).select(F.sha2("content", 256).alias("sha256"), "lang")
    return files.registered(f.select("sha256").distinct(), f.filter("lang = 'en'").select("sha256").distinct())


#: Texts of Latin-1 characters that are no UTF-8 when written in Latin-1.
_LATIN = r"^[\x{0000}-\x{00FF}]*$"
_LOOKS_UTF8 = r"[\x{00C2}-\x{00F4}][\x{0080}-\x{00BF}]"


@query("SELECT doc_id::VARCHAR AS content_id, 1::INT AS page, text FROM documents WHERE text IS NOT NULL AND lang IS DISTINCT FROM 'fr'")
def text_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of contents: UTF-8 and Latin-1 bytes, text by type or by name, none for images."""
    t = table(spark, d, "documents").filter("text is not null")
    lang = F.coalesce("lang", F.lit(""))
    latin = (lang == "de") & F.col("text").rlike(_LATIN) & ~F.col("text").rlike(_LOOKS_UTF8)
    mime = F.when(lang == "fr", "image/png").when(lang == "es", "application/octet-stream").otherwise("text/plain")
    name = F.when(lang == "es", "note.MD").otherwise("scan.bin")
    return files.page_texts(t.select(F.col("doc_id").cast("string").alias("content_id"), mime.alias("mime_type"), name.alias("filename"), F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("data")))


# Facts -----------------------------------------------------------------------

_LAB = {1: "MEASUREMENT", 2: "LAB_TEST", 3: "REFERENCE_RANGE", 4: "DATE", 5: "PERSON", 6: "MEASUREMENT", 7: "patient"}
_MONEY = {1: "MONEY", 2: "INVOICE", 3: "VENDOR", 4: "DUE_DATE", 5: "ORDER_NUMBER", 6: "total", 7: "RECEIPT"}
_EVENTS = {1: "MEDICATION", 2: "PATIENT", 3: "DOCTOR", 4: "HOSPITAL", 5: "APPOINTMENT", 6: "DOSAGE", 7: "diagnosis"}
#: Attributes of returned and of other closed line items: strings, and numbers that do not count as text.
_STRINGS = '{"value": "7.5 g/L", "units": "g/L", "amount": "EUR 9.5", "currency": "EUR", "range": "1-2", "dosage": "own"}'
_NUMBERS = '{"value": 7.5, "units": 5, "amount": 7, "currency": 3, "range": 4}'


def _mentions(spark: SparkSession, d: str, roles: dict[int, str], dated: int) -> DataFrame:
    """Line items as mentions inside their order, their line numbers being roles."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, d, "lineitem").groupBy(*keys).agg(F.min("l_returnflag").alias("flag"), F.min("l_shipdate").alias("day"), F.min("l_quantity").alias("q"))
    role = F.create_map(*(x for k, v in roles.items() for x in (F.lit(k), F.lit(v))))[F.col("l_linenumber").cast("int")]
    start = (F.col("l_partkey") % 1000).cast("int")
    words = F.when(F.col("l_linenumber") == dated, F.date_format("day", "yyyy-MM-dd")).otherwise(F.concat_ws(" ", F.col("q").cast("int").cast("string"), F.lit("mg/dL")))
    attributes = F.when(F.col("flag") == "R", _STRINGS).when(F.col("flag") == "A", _NUMBERS).otherwise("{}")
    meta = F.concat(F.lit('{"attributes": '), attributes, F.lit(', "message_id": "m'), F.col("l_orderkey").cast("string"), F.lit('"}'))
    return materialise(
        li.select(
            F.concat_ws(":", *keys).alias("mention_id"), F.lit("pattern:orders").alias("extractor"), F.col("l_orderkey").cast("string").alias("content_id"), F.lit(0).alias("chunk_index"), F.concat_ws(":", F.lit("E"), "l_partkey").alias("entity_id"),
            role.alias("label"), words.alias("text"), start.alias("start_char"), (start + 5).alias("end_char"), meta.alias("metadata"),
        )
    )


def _mentions_sql(roles: dict[int, str], dated: int) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v.upper()}'" for k, v in roles.items())
    return f"""m AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS mention_id, l_orderkey::VARCHAR AS content_id, 'E:' || l_partkey AS entity_id, CASE l_linenumber {cases} END AS label,
CASE WHEN l_linenumber = {dated} THEN strftime(day, '%Y-%m-%d') ELSE q::INT || ' mg/dL' END AS text, (l_partkey % 1000)::INT AS s, (l_partkey % 1000)::INT + 5 AS e, flag
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS flag, min(l_shipdate) AS day, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4))"""


def _near_sql(name: str, *labels: str) -> str:
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"""LEFT JOIN (SELECT t.mention_id, arg_min(struct_pack(entity_id := o.entity_id, label := o.label, text := o.text, flag := o.flag), (least(abs(t.s - o.e), abs(o.s - t.e)), o.s, o.mention_id)) AS {name}
  FROM m t JOIN m o ON o.content_id = t.content_id AND o.label IN ({listed}) GROUP BY 1) USING (mention_id)"""


_LAST = "QUALIFY row_number() OVER (PARTITION BY {id} ORDER BY s DESC, mention_id DESC) = 1"
_NUMBER = r"TRY_CAST(replace(nullif(regexp_extract({0}, '-?\d+(?:[.,]\d+)?'), ''), ',', '') AS DOUBLE)"
_VALUE = "CASE WHEN m.flag = 'R' THEN '7.5 g/L' ELSE m.text END"
_PERSON = "LEFT JOIN (SELECT content_id, arg_min(text, (s, mention_id)) AS who FROM m WHERE label IN ('PATIENT', 'PERSON', 'NAME') GROUP BY 1) USING (content_id)"
_AMOUNT = "CASE WHEN m.flag = 'R' THEN 'EUR 9.5' ELSE m.text END"


@query(f"""WITH {_mentions_sql(_LAB, 4)}
SELECT sha1(content_id || ':0:' || m.entity_id || ':' || coalesce(test.entity_id, '')) AS result_id, test.text AS test_name, {_VALUE} AS measurement_text, {_NUMBER.format(_VALUE)} AS measurement_value,
CASE m.flag WHEN 'R' THEN 'g/L' WHEN 'A' THEN '5' ELSE 'mg/dL' END AS measurement_units, CASE WHEN rng.flag = 'R' THEN '1-2' ELSE rng.text END AS reference_range, day.text AS date_raw, day.text AS date_parsed, who AS patient, 'm' || content_id AS message_id
FROM m {_near_sql("test", "LAB_TEST")} {_near_sql("rng", "REFERENCE_RANGE")} {_near_sql("day", "DATE")} {_PERSON} WHERE m.label = 'MEASUREMENT' {_LAST.format(id="content_id, m.entity_id, coalesce(test.entity_id, '')")}""")
def lab_facts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Laboratory results built from mentions with and without attributes."""
    r = facts.lab_results(_mentions(spark, d, _LAB, 4), "pattern:orders", F.lit(NOW))
    return r.select("result_id", "test_name", "measurement_text", "measurement_value", "measurement_units", "reference_range", "date_raw", "date_parsed", "patient", "message_id")


@query(f"""WITH {_mentions_sql(_MONEY, 4)}
SELECT sha1(content_id || ':0:' || m.entity_id || ':' || coalesce(rec.entity_id, '')) AS record_id, coalesce(rec.label, 'PAYMENT') AS record_type, {_AMOUNT} AS amount_text, {_NUMBER.format(_AMOUNT)} AS amount_value,
CASE WHEN m.flag = 'R' THEN 'EUR' END AS currency, party.text AS counterparty, ref.text AS reference, day.text AS date_parsed
FROM m {_near_sql("rec", "INVOICE", "PAYMENT", "BILL", "RECEIPT")} {_near_sql("party", "ORGANIZATION", "PERSON", "VENDOR", "CUSTOMER")} {_near_sql("day", "DATE", "PAYMENT_DATE", "DUE_DATE")} {_near_sql("ref", "REFERENCE", "INVOICE_REFERENCE", "INVOICE_NUMBER", "ORDER_NUMBER")}
WHERE m.label IN ('MONEY', 'AMOUNT', 'TOTAL') {_LAST.format(id="content_id, m.entity_id, coalesce(rec.entity_id, '')")}""")
def financial_facts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Financial records with record, party, date and reference."""
    r = facts.financial_records(_mentions(spark, d, _MONEY, 4), "pattern:orders", F.lit(NOW))
    return r.select("record_id", "record_type", "amount_text", "amount_value", "currency", "counterparty", "reference", "date_parsed")


@query(f"""WITH {_mentions_sql(_EVENTS, 5)}
SELECT sha1(content_id || ':0:' || m.entity_id) AS event_id, m.label AS event_type, m.text AS description, CASE WHEN m.flag = 'R' THEN 'own' ELSE dose.text END AS dosage, who.text AS patient, doctor.text AS clinician, place.text AS facility, day.text AS date_raw
FROM m {_near_sql("who", "PATIENT", "PERSON", "NAME")} {_near_sql("doctor", "CLINICIAN", "DOCTOR", "PHYSICIAN")} {_near_sql("place", "FACILITY", "ORGANIZATION", "HOSPITAL")} {_near_sql("day", "DATE", "APPOINTMENT", "SCHEDULE")} {_near_sql("dose", "DOSAGE", "FREQUENCY")}
WHERE m.label IN ('DIAGNOSIS', 'MEDICATION', 'PRESCRIPTION', 'PROCEDURE', 'TREATMENT', 'TEST') {_LAST.format(id="content_id, m.entity_id")}""")
def medical_facts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Medical events with patient, clinician, facility, date and dosage."""
    r = facts.medical_events(_mentions(spark, d, _EVENTS, 5), "pattern:orders", F.lit(NOW))
    return r.select("event_id", "event_type", "description", F.get_json_object("attributes", "$.dosage").alias("dosage"), "patient", "clinician", "facility", "date_raw")


@query("""WITH o AS (SELECT result_id, content_id, chunk_index FROM lab_results), n AS (SELECT DISTINCT content_id, chunk_index FROM lab_results WHERE extractor ILIKE 'spacy:%')
SELECT content_id, chunk_index, CASE WHEN n.content_id IS NULL THEN result_id ELSE 'new' END AS result_id FROM o LEFT JOIN n USING (content_id, chunk_index) WHERE n.content_id IS NULL UNION ALL SELECT content_id, chunk_index, 'new' FROM n""")
def facts_replaced_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Stored results after the chunks one family of extractors has read gave new ones."""
    old = table(spark, d, "lab_results").select("content_id", "chunk_index", "result_id", "extractor")
    new = old.filter(F.col("extractor").ilike("spacy:%")).select("content_id", "chunk_index", F.lit("new").alias("result_id")).distinct()
    return facts.replace_chunks(old.drop("extractor"), new)


# Search and graph ---------------------------------------------------------------

_FOLD = r"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_TERMS = f"list_concat(list_concat({_FOLD.format('subject')}, {_FOLD.format('sender')}), list_concat({_FOLD.format('recipients')}, {_FOLD.format('body')}))"


def _bm25_sql(words: list[str]) -> str:
    count = ", ".join(f"len(list_filter(ts, lambda x: starts_with(x, '{w}'))) AS a{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (a{i} > 0) AS d{i}" for i in range(len(words)))
    idf = ", ".join(f"CASE WHEN ln((docs - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((docs - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END AS i{i}" for i in range(len(words)))
    rank = " + ".join(f"i{i} * a{i} * 2.2 / (a{i} + 1.2 * (0.25 + 0.75 * n / av))" for i in range(len(words)))
    return f"""bd AS (SELECT id, {_TERMS} AS ts FROM {_ONE}), bc AS (SELECT id, len(ts) AS n, {count} FROM bd), bs AS (SELECT count(*) AS docs, avg(n) AS av, {df} FROM bc), bi AS (SELECT *, {idf} FROM bs),
ranked AS (SELECT id, -({rank}) AS rank FROM bc, bi WHERE {" AND ".join(f"a{i} > 0" for i in range(len(words)))})"""


@query(f"WITH {_bm25_sql(['insur', 'form'])} SELECT id AS message_id, round(rank, 6) AS rank FROM ranked")
def bm25_of_index(spark: SparkSession, d: str) -> DataFrame:
    """Messages that match two prefixes, ranked from the stored index."""
    index = tuple(map(materialise, fts.postings(table(spark, d, "messages").dropDuplicates(["id"]))))
    return fts.bm25_of_index(index, ["insur", "form"]).select("message_id", F.round(F.col("rank"), 6).alias("rank"))


@query(f"WITH {_bm25_sql(['insur', 'form'])} SELECT id AS message_id, round(1 / (rank + 0.001), 6) AS boost FROM ranked ORDER BY rank, id LIMIT 40")
def search_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Boosts of the 40 best matches."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    return fts.boosts(m, ["insur", "form"], 10).select("message_id", F.round("boost", 6).alias("boost"))


@query(f"""SELECT id, lower(array_to_string(list_filter([sender, recipients], lambda x: x IS NOT NULL), ' ')) AS participants, id AS message_id FROM {_ONE}""")
def search_participants(spark: SparkSession, d: str) -> DataFrame:
    """Sender, recipients and message id as search reads them from a chunk's metadata."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    meta = F.to_json(F.struct(F.lit("").alias("message_id"), F.struct("sender", "recipients", F.col("id").alias("message_id")).alias("content_metadata")))
    return m.select("id", text.participants(meta).alias("participants"), text.message_id_of(meta).alias("message_id"))


@query("SELECT p_partkey::VARCHAR AS entity_id, CASE WHEN p_size > 40 THEN 'Entity' ELSE regexp_replace(trim(p_name), '[^A-Za-z0-9_]', '_', 'g') END AS label, CASE WHEN p_size < 10 THEN 'own' ELSE p_partkey::VARCHAR END AS id FROM part")
def graph_export_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes for a graph store: labels cleaned or missing, properties with and without an id, some no JSON."""
    p = table(spark, d, "part")
    props = F.when(F.col("p_size") < 10, '{"id": "own"}').when(F.col("p_size") > 30, "{bad").otherwise('{"a": "x"}')
    n = graph.export_nodes(p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.when(F.col("p_size") <= 40, F.col("p_name")).alias("label"), props.alias("properties")))
    return n.select("entity_id", "label", F.col("properties")["id"].alias("id"))


@query("""WITH m AS (SELECT o_custkey, l_orderkey, round(l_extendedprice)::BIGINT AS v, l_returnflag AS f, o_orderstatus AS subject FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(c_custkey) FROM customer))
SELECT amount, currency, amount_text, subject, content_type, message_id FROM (SELECT DISTINCT CASE f WHEN 'R' THEN v::DOUBLE WHEN 'A' THEN v::DOUBLE END AS amount, CASE f WHEN 'R' THEN 'USD' WHEN 'A' THEN 'GBP' END AS currency,
CASE f WHEN 'R' THEN 'usd ' || v WHEN 'A' THEN v::VARCHAR ELSE 'none' END AS amount_text, subject, 'message' AS content_type, 'm' || l_orderkey AS message_id FROM m)""")
def payments_with_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Money in the orders of one customer: amounts in the canonical name, in an alias, or nowhere."""
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    c = table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("entity_id"), F.lit("ORGANIZATION").alias("label"), js(canonical=F.lower("c_name")).alias("properties"))
    o = table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("entity_id"), F.lit("Content").alias("label"), js(subject=F.col("o_orderstatus"), content_type=F.lit("message"), message_id=F.concat(F.lit("m"), "o_orderkey")).alias("properties"))
    v = F.round("l_extendedprice").cast("bigint").cast("string")
    flag = F.col("l_returnflag")
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(flag == "R", F.concat(F.lit("usd "), v)).when(flag == "A", "total in gbp").otherwise("none").alias("canonical"), F.when(flag == "A", v).alias("alias"))
    li = li.withColumn("m", F.concat_ws("|", F.lit("M"), "canonical", "alias"))
    money = li.select(F.col("m").alias("entity_id"), F.lit("MONEY").alias("label"), js(canonical=F.col("canonical"), aliases=F.array_compact(F.array("alias"))).alias("properties")).distinct()
    e = table(spark, d, "orders").select(F.concat(F.lit("C:"), "o_custkey").alias("source_id"), F.concat(F.lit("order:"), "o_orderkey").alias("target_id")).unionByName(li.select(F.col("m").alias("source_id"), F.concat(F.lit("order:"), "l_orderkey").alias("target_id")))
    name = table(spark, d, "customer").orderBy("c_custkey").first()["c_name"]
    return graph.payments(c.unionByName(o).unionByName(money), e.withColumn("relation_type", F.lit("MENTIONED_IN")), name).select("amount", "currency", "amount_text", "subject", "content_type", "message_id")


_LABELS = " UNION ALL ".join(f"SELECT '{label}' AS label, content_id, chunk_index, unnest(regexp_extract_all(text, '{pattern}')) AS w FROM t" for label, pattern in extract.PATTERNS.items())


@query(f"""WITH t AS (SELECT DISTINCT content_id, page, chunk_index, trim(text) AS text FROM attachment_texts WHERE text IS NOT NULL), m AS ({_LABELS})
SELECT 'mention' AS kind, label, count(*) AS n FROM m GROUP BY label UNION ALL SELECT 'node', label, count(DISTINCT trim(lower(w))) FROM m GROUP BY label
UNION ALL SELECT 'node', 'Content', count(DISTINCT content_id) FROM m UNION ALL SELECT 'edge', 'MENTIONED_IN', count(*) FROM m UNION ALL SELECT 'sure', 'confidence', count(*) FROM m""")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    """Mentions, nodes and edges of a graph built from all attachment texts by all patterns."""
    t = table(spark, d, "attachment_texts").filter("text is not null").select("content_id", "page", "chunk_index", "text").distinct()
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    segs = t.select("*", *none("filename", "subject", "message_id", "attachment_id", "content_type"))
    e = extract.PatternExtractor()
    found = materialise(extract.extract_mentions(segs, e))
    m, n, r, _ = graph.build(segs, found, e.name, F.lit(NOW), empty(spark, "entity_mentions"), empty(spark, "graph_entities"), empty(spark, "graph_relations"))
    count = lambda df, kind, by: df.groupBy(by.alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    parts = [count(m, "mention", F.col("label")), count(n, "node", F.col("label")), count(r, "edge", F.col("relation_type")), count(m.filter("confidence = 1.0"), "sure", F.lit("confidence"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""SELECT term, count(DISTINCT id) AS messages, count(*) AS occurrences FROM (SELECT id, unnest({_TERMS}) AS term FROM (SELECT * REPLACE (CASE WHEN received_at >= TIMESTAMPTZ '2021-01-01 00:00:00+00' THEN 'changed twice, changed' ELSE subject END AS subject) FROM {_ONE})) GROUP BY term""")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the full-text index after the subjects of later mail were changed."""
    m = table(spark, d, "messages").dropDuplicates(["id"])
    changed = m.filter("received_at >= '2021-01-01'").withColumn("subject", F.lit("changed twice, changed"))
    p, _ = fts.upsert_postings(fts.postings(m), changed)
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("messages"), F.sum("tf").alias("occurrences"))


@query("""SELECT content_id || ':' || chunk_index || ':hashed-bow-128' AS embedding_id, 'hashed-bow-128' AS model, 128::INT AS dimensions, page::VARCHAR AS page, content_id || '.pdf' AS filename, 'attachment' AS source, '/a/' || content_id AS path, 'x' AS inner_value,
regexp_matches(text, '[^\\s\\x{0085}\\x{00A0}\\x{3000}]')::INT AS length FROM (SELECT DISTINCT content_id, page, chunk_index, text FROM attachment_texts WHERE text IS NOT NULL)""")
def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all stored chunks with the provenance of their content."""
    t = table(spark, d, "attachment_texts").filter("text is not null").select("content_id", "page", "chunk_index", "text").distinct()
    none = F.lit(None).cast("string")
    info = t.select("content_id").distinct().select("content_id", none.alias("message_id"), none.alias("attachment_id"), F.concat("content_id", F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mime_type"), F.lit("attachment").alias("content_type"), F.to_json(F.struct(F.concat(F.lit("/a/"), "content_id").alias("path"), F.lit("x").alias("k"))).alias("metadata"))
    e = index.embed_chunks(t, info, F.lit(NOW))
    js = lambda p: F.get_json_object("metadata", p)
    return e.select("embedding_id", "model", "dimensions", js("$.page").alias("page"), js("$.filename").alias("filename"), js("$.source").alias("source"), js("$.path").alias("path"), js("$.content_metadata.k").alias("inner_value"), F.round(embed.norm(F.col("vector")), 3).cast("int").alias("length"))


@query("""SELECT l_orderkey || ':' || l_linenumber AS relation_id, 'P' || l_partkey AS source_id, 'S' || l_suppkey AS target_id, CASE l_returnflag WHEN 'R' THEN 'RELATED_TO' WHEN 'A' THEN '_1_st_kind' ELSE 'kept' END AS relation_type
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem) JOIN part ON p_partkey = l_partkey AND p_size <= 25 JOIN supplier ON s_suppkey = l_suppkey""")
def graph_export_edges(spark: SparkSession, d: str) -> DataFrame:
    """Line items as edges for a graph store: types cleaned or missing, edges without both ends left out."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    kind = F.when(F.col("l_returnflag") == "A", "1 st-kind!").when(F.col("l_returnflag") != "R", "kept")
    rel = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("relation_id"), F.concat(F.lit("P"), "l_partkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("target_id"), kind.alias("relation_type"), F.lit("{bad").alias("properties"))
    nodes = table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id")))
    return graph.export_edges(rel, nodes).drop("properties")


@query("""WITH o AS (SELECT DISTINCT result_id AS mention_id, extractor, content_id, chunk_index FROM lab_results), n AS (SELECT DISTINCT extractor, content_id, chunk_index FROM o WHERE extractor = 'spacy:base' AND chunk_index > 0)
SELECT extractor, content_id, chunk_index, mention_id FROM o WHERE (extractor, content_id, chunk_index) NOT IN (SELECT (extractor, content_id, chunk_index) FROM n) UNION ALL SELECT *, 'new' FROM n""")
def mentions_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Stored mentions after one extractor has read some chunks again; its chunks without new mentions keep theirs."""
    old = table(spark, d, "lab_results").select("extractor", "content_id", "chunk_index", F.col("result_id").alias("mention_id")).distinct()
    new = old.filter("extractor = 'spacy:base' and chunk_index > 0").select("extractor", "content_id", "chunk_index").distinct().withColumn("mention_id", F.lit("new"))
    return graph.store_mentions(old, new)


@query("""SELECT content_id, chunk_index FROM (SELECT DISTINCT t.content_id, t.chunk_index, r.first_at FROM attachment_texts t JOIN (SELECT content_id, min(created_at) AS first_at FROM lab_results GROUP BY 1) r USING (content_id)) ORDER BY first_at, content_id, chunk_index LIMIT 200""")
def segments_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    """The 200 chunks to read next: oldest content first, in the order of its chunks."""
    t = table(spark, d, "attachment_texts").select("content_id", "page", "chunk_index", "text").distinct()
    none = F.lit(None).cast("string")
    reg = table(spark, d, "lab_results").groupBy("content_id").agg(F.min("created_at").alias("created_at")).select("content_id", none.alias("message_id"), none.alias("attachment_id"), F.lit("attachment").alias("content_type"), F.lit("{}").alias("metadata"), "created_at")
    rest = [empty(spark, n) for n in ("attachments", "messages", "entity_mentions")]
    return graph.segments(t, reg, *rest, "pattern:default", limit=200).select("content_id", "chunk_index")


# Texts --------------------------------------------------------------------------


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(trim('```json' || chr(10) || text || chr(10) || '```'), '^```(?:json)?\s*', ''), '\s*```$', '')) AS inner_text, left(text, 400) AS shown FROM documents WHERE text IS NOT NULL""")
def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts freed of a code fence, and shortened for display."""
    t = table(spark, d, "documents").filter("text is not null")
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return t.select("doc_id", text.strip_fences(fenced).alias("inner_text"), text.shorten(F.col("text"), 400).alias("shown"))


@query("""SELECT DISTINCT result_id, CASE WHEN contains(lower(left(measurement_text, 4)), lower(measurement_units)) AND length(measurement_text) >= 4 THEN 0 WHEN p > 0 THEN p - 1 END::INT AS span_start,
CASE WHEN contains(lower(left(measurement_text, 4)), lower(measurement_units)) AND length(measurement_text) >= 4 THEN 4 WHEN p > 0 THEN p - 1 + length(measurement_units) END::INT AS span_end
FROM (SELECT *, instr(lower(measurement_text), lower(measurement_units)) AS p FROM lab_results WHERE measurement_text IS NOT NULL AND measurement_units <> '')""")
def unit_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the unit of a result stands in its text."""
    t = table(spark, d, "lab_results").filter("measurement_text is not null and measurement_units <> ''").select("result_id", "measurement_text", "measurement_units").distinct()
    s = text.span_of(F.col("measurement_text"), F.col("measurement_units"), F.lit(0), F.lit(4))
    return t.select("result_id", s["start"].alias("span_start"), s["end"].alias("span_end"))


@query(f"""SELECT DISTINCT result_id, test_name FROM (SELECT DISTINCT * FROM lab_results) WHERE extractor = 'llm:small-local' AND lower(patient) LIKE '%a%' AND lower(json_extract_string(metadata, '$.filename')) LIKE '%note%'
AND lower(json_extract_string(json_object('subject', json_extract_string(metadata, '$.filename')), '$.subject')) LIKE '%note%'""")
def lab_by_subject(spark: SparkSession, d: str) -> DataFrame:
    """All results of a patient by a property inside their metadata."""
    t = table(spark, d, "lab_results").distinct()
    named = t.withColumn("metadata", F.to_json(F.struct(F.get_json_object("metadata", "$.filename").alias("subject"))))
    return lookups.fetch_lab_results(named, "llm:small-local", None, "a", "note", None).select("result_id", "test_name")


@query(r"SELECT DISTINCT record_id, CASE WHEN v IS NOT NULL THEN amount_text WHEN w IS NOT NULL THEN currency ELSE amount_text END AS source FROM (SELECT *, regexp_extract(amount_text, '\d') <> '' OR NULL AS v, regexp_extract(currency, '\d') <> '' OR NULL AS w FROM financial_records)")
def first_readable_amount(spark: SparkSession, d: str) -> DataFrame:
    """The first of two names of an amount that holds a number."""
    t = table(spark, d, "financial_records").select("record_id", "amount_text", "currency").distinct()
    return t.select("record_id", values.amount_of_names(F.col("amount_text"), F.array_compact(F.array("currency")))["text"].alias("source"))


# Queue and tools ---------------------------------------------------------------

_QUEUE = """(SELECT event_id::VARCHAR AS task_id, event_type AS task_type, CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'purchase' THEN 'in_progress' WHEN event_type = 'signup' THEN 'completed' ELSE 'failed' END AS status, (user_id % 6)::INT AS attempts, ts FROM events)"""
_MID = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """The queue of the events, and the middle of its time."""
    from knowloom.plans import queries

    q = queries._queue(spark, d)
    return q, queries._midway(q)


@query(f"SELECT task_id, 'in_progress' AS status FROM {_QUEUE} WHERE task_type IN ('click', 'purchase') AND ((status = 'pending' AND ts <= {_MID}) OR (status = 'in_progress' AND ts <= {_MID} - INTERVAL 300 SECOND)) ORDER BY ts, task_id LIMIT 100")
def queue_lease(spark: SparkSession, d: str) -> DataFrame:
    """The hundred oldest tasks of two kinds that are due, locked."""
    q, now = _queue(spark, d)
    return task_queue.fetch_and_lock(q, now, ["click", "purchase"], most=100)[0].select("task_id", "status")


@query(f"SELECT status, count(*) AS tasks, count(*) FILTER (task_id IN (SELECT task_id FROM (SELECT task_id FROM {_QUEUE} WHERE task_type = 'view' ORDER BY task_id LIMIT 50))) AS moved FROM {_QUEUE} WHERE task_id NOT IN (SELECT task_id FROM (SELECT task_id FROM {_QUEUE} WHERE task_type = 'purchase' ORDER BY task_id LIMIT 50)) GROUP BY status")
def queue_complete_and_reschedule(spark: SparkSession, d: str) -> DataFrame:
    """States after fifty tasks were completed and fifty moved to a later time."""
    q, _ = _queue(spark, d)
    ids = lambda kind: [r["task_id"] for r in q.filter(F.col("task_type") == kind).select("task_id").orderBy("task_id").limit(50).collect()]
    later = F.lit("2030-01-01 00:00:00").cast("timestamp")
    out = task_queue.reschedule(task_queue.complete(q, ids("purchase")), ids("view"), later, F.lit(NOW).cast("timestamp"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("available_at") == later, 1)).alias("moved"))


@query(f"SELECT CASE WHEN task_type IN ('signup', 'purchase') THEN 'pending' ELSE status END AS status, count(*) AS tasks, sum(CASE WHEN task_type = 'signup' THEN 0 ELSE attempts END)::BIGINT AS attempts FROM {_QUEUE} GROUP BY 1")
def queue_reset(spark: SparkSession, d: str) -> DataFrame:
    """States after two kinds of tasks were enqueued again under the resetting policy."""
    q, _ = _queue(spark, d)
    again = q.filter(F.col("task_type").isin("signup", "purchase")).select("task_id", "task_type", "payload", "available_at")
    return task_queue.enqueue(q, again, F.lit(NOW).cast("timestamp"), "reset").groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.sum("attempts").alias("attempts"))
