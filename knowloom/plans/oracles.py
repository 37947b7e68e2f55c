"""DuckDB SQL of the core queries that SQL can express."""

from __future__ import annotations

from knowloom.operators import units
from knowloom.operators.extract import PATTERNS

_WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
_WORDS = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"


def _chunks(keys: str, source: str) -> str:
    """Chunk numbers and texts of the column ``text`` of a source."""
    return f"""SELECT {keys}, c.i AS i, substring(n, c.i * 1000 + 1, 1000) AS text
FROM (SELECT *, {_NORM} AS n FROM {source} WHERE text IS NOT NULL) t, unnest(generate_series(0, ((length(n) + 999) // 1000 - 1)::BIGINT)) AS c(i) WHERE length(n) > 0"""


_DEDUP = "(SELECT DISTINCT ON (id) * FROM messages)"
_FOLD = r"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_TERMS = "list_concat(" + ", ".join(["list_concat(" + _FOLD.format("subject"), _FOLD.format("sender") + ")", "list_concat(" + _FOLD.format("recipients"), _FOLD.format("body") + ")"]) + ")"
_AMOUNT = r"""(CASE WHEN v < 1000 THEN v * CASE WHEN contains(l, 'crore') THEN 1e7 WHEN contains(l, 'lakh') THEN 1e5 WHEN contains(l, 'lac') THEN 1e5 WHEN contains(l, 'thousand') THEN 1e3 ELSE 1.0 END ELSE v END)"""
_GRAPH_CURRENCY = "CASE WHEN contains(lower({0}), 'usd') OR contains({0}, '$') THEN 'USD' WHEN contains(lower({0}), 'inr') OR contains(lower({0}), 'rs') OR contains({0}, '₹') THEN 'INR' WHEN contains(lower({0}), 'eur') OR contains({0}, '€') THEN 'EUR' WHEN contains(lower({0}), 'gbp') OR contains({0}, '£') THEN 'GBP' END"
_READ = r"lower(replace({0}, ',', '')) AS l, TRY_CAST(nullif(regexp_extract(lower(replace({0}, ',', '')), '\d+(?:\.\d+)?'), '') AS DOUBLE) AS v"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_TEXTS = "(SELECT DISTINCT content_id, page, chunk_index, text FROM attachment_texts WHERE text IS NOT NULL)"
_MENTIONS = " UNION ALL ".join(f"SELECT '{label}' AS label, content_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM {_TEXTS}" for label, pattern in PATTERNS.items())
_QUEUE = """(SELECT event_id::VARCHAR AS task_id, event_type AS task_type,
  CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'purchase' THEN 'in_progress' WHEN event_type = 'signup' THEN 'completed' ELSE 'failed' END AS status,
  (user_id % 6)::INT AS attempts, ts, ts AS locked_at FROM events)"""
_MID = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"
_ORDER_MENTIONS = """(SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS mention_id, l_orderkey::VARCHAR AS content_id, 'E:' || l_partkey AS entity_id, CASE WHEN l_returnflag = 'R' THEN 'MONEY' ELSE 'DATE' END AS label,
  strftime(l_shipdate, '%Y-%m-%d') AS text, (l_partkey % 1000)::INT AS s, (l_partkey % 1000)::INT + 5 AS e
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS l_returnflag, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL))"""
_NEAREST = f"""SELECT t.mention_id, t.content_id, t.entity_id, t.text, t.s, arg_min(o.mention_id, (least(abs(t.s - o.e), abs(o.s - t.e)), o.s, o.mention_id)) AS nearest_id,
  arg_min(o.text, (least(abs(t.s - o.e), abs(o.s - t.e)), o.s, o.mention_id)) AS day
  FROM {_ORDER_MENTIONS} t LEFT JOIN {_ORDER_MENTIONS} o ON o.content_id = t.content_id AND o.label = 'DATE' WHERE t.label = 'MONEY' GROUP BY ALL"""
_FACT = """SELECT {cols} FROM (SELECT DISTINCT * FROM {table}) WHERE extractor = 'llm:small-local' AND {where}
ORDER BY coalesce(date_parsed, date_raw) DESC NULLS LAST, created_at DESC NULLS LAST, {key} LIMIT 20"""
_REGISTRY = f"""(
  SELECT 'message:' || id AS content_id, 'message' AS content_type, 0 AS p, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(subject, 'message-' || id) AS filename FROM {_DEDUP}
  UNION ALL SELECT DISTINCT content_id, 'attachment', 1, '2019-01-01 00:00:00', split_part(content_id, ':', 3) || '.pdf' FROM attachment_texts WHERE content_id LIKE 'attachment:%'
  UNION ALL SELECT DISTINCT content_id, 'local_file', 2, '2019-01-01 00:00:00', content_id FROM attachment_texts WHERE content_id LIKE 'file:%')"""
_LAB_GRAPH = "(SELECT DISTINCT extractor, test_entity_id AS s, measurement_entity_id AS t FROM lab_results)"
_STOP = "['the','and','for','with','from','last','latest','conversation','email','message','talk','about','tell','show','give','what','which','who','whom','where','when','how','details','status','update','recent']"

ORACLES: dict[str, str] = {
    "chunk_documents": f"SELECT doc_id AS content_id, 1::INT AS page, i::INT AS chunk_index, text, {_WORDS.format('text')}::INT AS token_count, sha256(text) AS sha256 FROM ({_chunks('doc_id::VARCHAR AS doc_id', 'documents')})",
    "chunk_stats": f"SELECT lang, count(*) AS chunks, sum({_WORDS.format('text')})::BIGINT AS words FROM ({_chunks('lang', 'documents')}) GROUP BY lang",
    "chunk_numbering": f"""SELECT content_id, page, (row_number() OVER (PARTITION BY content_id ORDER BY page, i) - 1)::INT AS chunk_index, {_WORDS.format('text')}::INT AS token_count
FROM ({_chunks('content_id, chunk_index AS page', '(SELECT DISTINCT content_id, chunk_index, text FROM attachment_texts)')})""",
    "token_buckets": f"""SELECT doc_id, (('0x' || right(sha1(w), 2))::INT % 128)::INT AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY ALL""",
    "vector_norms": """SELECT embedding_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 3) AS norm, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN 1.0 ELSE 0.0 END AS unit_norm
FROM (SELECT embedding_id, vector::DOUBLE[] AS v FROM chunk_embeddings WHERE vector IS NOT NULL)""",
    "cosine_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 10""",
    "registry_dedupe": "SELECT 'file:' || sha256(coalesce(text, '')) AS content_id, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "message_upsert": "SELECT id, max(CASE WHEN received_at >= TIMESTAMPTZ '2021-01-01 00:00:00+00' THEN 2 ELSE 1 END)::INT AS version FROM messages GROUP BY id",
    "replace_by_content": """WITH t AS (SELECT DISTINCT content_id, page, chunk_index FROM attachment_texts), n AS (SELECT * FROM t WHERE chunk_index >= 5)
SELECT content_id, page, chunk_index, 1::INT AS run FROM t WHERE content_id NOT IN (SELECT content_id FROM n) UNION ALL SELECT *, 2::INT FROM n""",
    "pending_content": "SELECT DISTINCT 'message:' || id AS content_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.content_id = 'message:' || m.id)",
    "pending_union_limit": f"""SELECT content_id, content_type, filename FROM {_REGISTRY} r WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.content_id = r.content_id)
ORDER BY p, created_at NULLS FIRST, content_id LIMIT 3000""",
    "segments_provenance": f"""SELECT t.content_id, t.page, t.chunk_index, m_id AS message_id, CASE WHEN t.content_id LIKE 'attachment:%' THEN split_part(t.content_id, ':', 3) || '.pdf' END AS filename, m.subject
FROM (SELECT *, CASE WHEN content_id LIKE 'attachment:%' THEN split_part(content_id, ':', 2) END AS m_id FROM (SELECT DISTINCT content_id, page, chunk_index, text FROM attachment_texts)
WHERE (content_id, chunk_index) NOT IN (SELECT (content_id, chunk_index) FROM attachment_texts WHERE regexp_matches(text, '{_EMAIL}'))) t LEFT JOIN {_DEDUP} m ON m.id = t.m_id""",
    "bm25_messages": f"""WITH d AS (SELECT id, {_TERMS} AS ts FROM {_DEDUP}),
c AS (SELECT id, len(ts) AS n, len(list_filter(ts, lambda x: starts_with(x, 'insur'))) AS a, len(list_filter(ts, lambda x: starts_with(x, 'form'))) AS b FROM d),
s AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
f AS (SELECT *, CASE WHEN ln((docs - da + 0.5) / (da + 0.5)) > 0 THEN ln((docs - da + 0.5) / (da + 0.5)) ELSE 1e-6 END AS ia, CASE WHEN ln((docs - db + 0.5) / (db + 0.5)) > 0 THEN ln((docs - db + 0.5) / (db + 0.5)) ELSE 1e-6 END AS ib FROM s)
SELECT id AS message_id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av))), 6) AS rank FROM c, f WHERE a > 0 AND b > 0""",
    "postings_stats": f"SELECT term, count(DISTINCT id) AS messages, count(*) AS occurrences FROM (SELECT id, unnest({_TERMS}) AS term FROM {_DEDUP}) GROUP BY term",
    "query_tokens": rf"""SELECT id, array_to_string(ws, ' ') AS words, len(list_filter(ws, lambda x: NOT list_contains({_STOP}, x)))::INT AS strong FROM (
SELECT id, list_filter(list_transform(regexp_extract_all(lower(subject), '[\p{{L}}\p{{M}}\p{{N}}_@.]+'), lambda x: trim(x, '._')), lambda x: length(x) > 2) AS ws FROM (SELECT DISTINCT id, subject FROM messages WHERE subject IS NOT NULL))""",
    "keyword_hits": "SELECT doc_id, (contains(lower(text), 'payment')::INT + contains(lower(text), 'report')::INT + contains(lower(text), 'ledger')::INT + contains(lower(text), 'the')::INT) AS hits FROM documents WHERE text IS NOT NULL",
    "last_messages_per_thread": f"SELECT id, thread_id, rank FROM (SELECT id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY received_at DESC NULLS LAST, id DESC)::INT AS rank FROM {_DEDUP} WHERE thread_id IS NOT NULL) WHERE rank <= 5",
    "thread_context": f"""WITH top AS (SELECT thread_id FROM messages WHERE thread_id IS NOT NULL GROUP BY thread_id ORDER BY count(DISTINCT id) DESC, thread_id LIMIT 1),
w AS (SELECT id, thread_id, subject FROM {_DEDUP} WHERE thread_id = (SELECT thread_id FROM top) ORDER BY received_at DESC NULLS LAST, id DESC LIMIT 7)
SELECT id, thread_id, subject, (SELECT count(*) FROM (SELECT DISTINCT content_id FROM attachment_texts WHERE content_id LIKE 'attachment:%') a WHERE split_part(a.content_id, ':', 2) = w.id)::INT AS attachments FROM w""",
    "recipients_split": "SELECT id, r AS recipient FROM (SELECT id, trim(unnest(string_split(recipients, ','))) AS r FROM (SELECT DISTINCT id, recipients FROM messages)) WHERE r <> ''",
    "lab_query": _FACT.format(cols="result_id, test_name, date_parsed, date_raw, json_extract_string(metadata, '$.filename') AS filename", table="lab_results", where="lower(test_name) LIKE '%vitamin%'", key="result_id"),
    "financial_query": _FACT.format(cols="record_id, counterparty, record_type, date_raw, json_extract_string(metadata, '$.subject') AS subject", table="financial_records", where="lower(counterparty) LIKE '%interiors%' AND lower(record_type) = 'invoice'", key="record_id"),
    "medical_query": _FACT.format(cols="event_id, event_type, patient, date_raw", table="medical_events", where="lower(event_type) = 'medication'", key="event_id"),
    "currency_totals": f"""SELECT coalesce({_GRAPH_CURRENCY.format('amount_text')}, 'UNKNOWN') AS currency, round(sum({_AMOUNT}), 2) AS total
FROM (SELECT amount_text, {_READ.format('amount_text')} FROM (SELECT DISTINCT ON (record_id) * FROM financial_records)) WHERE v IS NOT NULL GROUP BY 1""",
    "parse_values": rf"""SELECT id, TRY_CAST(replace(nullif(regexp_extract(t, '-?\d+(?:[.,]\d+)?'), ''), ',', '') AS DOUBLE) AS number, {_AMOUNT} AS amount,
CASE WHEN contains(upper(t), 'INR') THEN 'INR' WHEN contains(upper(t), 'USD') THEN 'USD' WHEN contains(upper(t), 'EUR') THEN 'EUR' WHEN contains(upper(t), 'GBP') THEN 'GBP'
 WHEN starts_with(t, '₹') THEN 'INR' WHEN starts_with(t, '$') THEN 'USD' WHEN starts_with(t, '€') THEN 'EUR' WHEN starts_with(t, '£') THEN 'GBP' END AS fact_currency,
{_GRAPH_CURRENCY.format('t')} AS graph_currency, CASE WHEN len(w) >= 2 THEN w[-1] END AS last_word
FROM (SELECT *, {_READ.format('t')}, string_split(trim(regexp_replace(t, '{_WS}', ' ', 'g')), ' ') AS w FROM (SELECT DISTINCT * FROM (SELECT record_id AS id, amount_text AS t FROM financial_records UNION ALL SELECT result_id, measurement_text FROM lab_results)))""",
    "parse_dates": r"""SELECT result_id, strftime(coalesce(p, CASE WHEN regexp_full_match(d, '\d{1,2} [A-Za-z]{3} \d{4}') THEN try_strptime(d, '%d %b %Y') END, CASE WHEN regexp_full_match(d, '\d{1,2} [A-Za-z]+ \d{4}') THEN try_strptime(d, '%d %B %Y') END), '%Y-%m-%d') AS lab_date, strftime(p, '%Y-%m-%d') AS plain_date
FROM (SELECT *, CASE WHEN regexp_full_match(d, '\d{4}-\d{1,2}-\d{1,2}') THEN try_strptime(d, '%Y-%m-%d') WHEN regexp_full_match(d, '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(d, '%d/%m/%Y') WHEN regexp_full_match(d, '\d{1,2}-\d{1,2}-\d{4}') THEN try_strptime(d, '%d-%m-%Y') END AS p
FROM (SELECT DISTINCT result_id, trim(regexp_replace(date_raw, '\s+', ' ', 'g')) AS d, date_raw FROM lab_results))""",
    "flat_metadata": r"""SELECT id, trim(regexp_replace(lower(regexp_replace(regexp_replace(metadata, '"(?:[^"\\]|\\.)*"\s*:', ' ', 'g'), '[\[\]{}",]+|\bnull\b', ' ', 'g')), '\s+', ' ', 'g')) AS leaves FROM (SELECT DISTINCT id, metadata FROM messages WHERE metadata IS NOT NULL)""",
    "json_prop_filter": "SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k >= 5 GROUP BY event_type",
    "email_mentions": f"SELECT content_id, chunk_index, m AS text, count(*) AS n FROM (SELECT content_id, chunk_index, unnest(regexp_extract_all(text, '{_EMAIL}')) AS m FROM {_TEXTS}) GROUP BY ALL",
    "graph_entities": f"""SELECT label || ':' || left(sha1(label || ':' || trim(lower(m))), 16) AS entity_id, label, min(trim(lower(m))) AS canonical, array_to_string(list_sort(list(DISTINCT m)), '|') AS aliases
FROM ({_MENTIONS}) GROUP BY 1, 2""",
    "graph_edges": f"""SELECT label || ':' || left(sha1(label || ':' || trim(lower(m))), 16) AS source_id, content_id AS target_id, 'MENTIONED_IN' AS relation_type, count(*) AS mentions FROM ({_MENTIONS}) GROUP BY ALL""",
    "alias_merge": "SELECT 'VENDOR:' || trim(lower(counterparty)) AS entity_id, array_to_string(list_sort(list(DISTINCT counterparty)), '|') AS aliases, min(created_at) AS created_at, max(created_at) AS updated_at FROM financial_records WHERE counterparty IS NOT NULL GROUP BY 1",
    "nearest_mention": f"SELECT mention_id, nearest_id, day FROM ({_NEAREST})",
    "first_mention": f"SELECT t.mention_id, arg_min(o.text, (o.s, o.mention_id)) AS day FROM {_ORDER_MENTIONS} t LEFT JOIN {_ORDER_MENTIONS} o ON o.content_id = t.content_id AND o.label = 'DATE' WHERE t.label = 'MONEY' GROUP BY t.mention_id",
    "order_facts": f"""SELECT record_id, 'PAYMENT' AS record_type, left(text, 4)::DOUBLE AS amount_value, day AS date_raw, day AS date_parsed, content_id FROM (
SELECT *, sha1(content_id || ':0:' || entity_id || ':') AS record_id, row_number() OVER (PARTITION BY content_id, entity_id ORDER BY s DESC, mention_id DESC) AS n FROM ({_NEAREST})) WHERE n = 1""",
    "payments_by_counterparty": """SELECT 'INR' AS currency, round(sum(a), 2) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber, round(l_extendedprice * 100) AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(c_custkey) FROM customer)) HAVING count(*) > 0""",
    "orphan_prune": f"""WITH g AS (SELECT * FROM {_LAB_GRAPH} WHERE NOT extractor ILIKE 'spacy:%') SELECT DISTINCT entity_id FROM (SELECT s AS entity_id FROM g UNION ALL SELECT t FROM g) WHERE entity_id IS NOT NULL""",
    "label_sanitize": "SELECT p_partkey, CASE WHEN regexp_matches(b, '^[0-9]') THEN '_' || b ELSE b END AS label FROM (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_size || ' ' || p_type || ' !'), '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM part)",
    "span_search": """SELECT doc_id, CASE WHEN contains(lower(left(text, 6)), 'report') AND length(text) >= 6 THEN 0 WHEN p > 0 THEN p - 1 END::INT AS span_start, CASE WHEN contains(lower(left(text, 6)), 'report') AND length(text) >= 6 THEN 6 WHEN p > 0 THEN p + 5 END::INT AS span_end
FROM (SELECT doc_id, text, instr(lower(text), 'report') AS p FROM documents WHERE text IS NOT NULL)""",
    "export_names": r"""SELECT id, message_id, CASE WHEN n = 0 THEN filename ELSE regexp_extract(filename, '^(.*?)(\.[^.]*)?$', 1) || '_' || n || regexp_extract(filename, '^(.*?)(\.[^.]*)?$', 2) END AS export_name
FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY message_id NULLS FIRST, id) - 1 AS n FROM (SELECT attachment_id AS id, message_id, min(json_extract_string(metadata, '$.filename')) AS filename FROM lab_results WHERE attachment_id IS NOT NULL AND json_extract_string(metadata, '$.filename') IS NOT NULL GROUP BY 1, 2))""",
    "queue_eligible": f"SELECT task_id, status FROM {_QUEUE} WHERE (status = 'pending' AND ts <= {_MID}) OR (status = 'in_progress' AND ts <= {_MID} - INTERVAL 300 SECOND)",
    "queue_dedupe": f"SELECT CASE WHEN task_type IN ('signup', 'view') AND status IN ('completed', 'failed') THEN 'pending' ELSE status END AS status, count(*) AS tasks, sum(attempts)::BIGINT AS attempts FROM {_QUEUE} GROUP BY 1",
    "queue_fail_policy": f"""WITH f AS (SELECT min(task_id) AS id FROM {_QUEUE} WHERE status = 'in_progress'), q AS (SELECT *, task_id = (SELECT id FROM f) AS hit FROM {_QUEUE})
SELECT CASE WHEN hit THEN CASE WHEN attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END ELSE status END AS status, count(*) AS tasks, sum(attempts + hit::INT)::BIGINT AS attempts, max(CASE WHEN hit THEN 1024 END)::INT AS error_chars FROM q GROUP BY 1""",
    "queue_recover": f"SELECT CASE WHEN stale THEN 'pending' ELSE status END AS status, count(*) AS tasks, count(CASE WHEN NOT stale THEN 1 END) AS locked FROM (SELECT *, status = 'in_progress' AND ts <= {_MID} - INTERVAL 300 SECOND AS stale FROM {_QUEUE}) GROUP BY 1",
    "agent_tools": """SELECT 'lab_results' AS tool, true AS success, least(5, (SELECT count(*) FROM (SELECT DISTINCT * FROM lab_results) WHERE extractor = 'llm:small-local' AND lower(test_name) LIKE '%urea%'))::INT AS n_rows
UNION ALL SELECT 'medical_events', true, least(5, (SELECT count(*) FROM (SELECT DISTINCT * FROM medical_events) WHERE extractor = 'llm:small-local' AND lower(event_type) = 'procedure'))::INT
UNION ALL SELECT 'fetch_message_context', true, (SELECT CASE WHEN thread_id IS NULL THEN 1 ELSE least(5, (SELECT count(DISTINCT id) FROM messages o WHERE o.thread_id = m.thread_id)) END FROM messages m ORDER BY id LIMIT 1)::INT
UNION ALL SELECT 'no_such_tool', false, 0::INT""",
}


def _hybrid(query: str, strong: list[str], words: list[str], top_k: int) -> str:
    """Hybrid search over the chunks of all messages: cosine of hashed words, boosts, participants and keywords."""
    count = ", ".join(f"len(list_filter(ts, lambda x: starts_with(x, '{w}'))) AS a{i}" for i, w in enumerate(strong))
    df = ", ".join(f"count(*) FILTER (a{i} > 0) AS d{i}" for i in range(len(strong)))
    idf = ", ".join(f"greatest(ln((docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) AS i{i}" for i in range(len(strong)))
    rank = " + ".join(f"i{i} * a{i} * 2.2 / (a{i} + 1.2 * (0.25 + 0.75 * n / av))" for i in range(len(strong)))
    hits = lambda hay, ws: "(" + " + ".join(f"contains({hay}, '{w}')::INT" for w in ws) + ")"
    return f"""WITH c AS ({_chunks("id, subject, sender, recipients", "(SELECT id, subject, sender, recipients, body AS text FROM " + _DEDUP + ")")}),
w AS (SELECT id, i, (('0x' || right(sha1(w), 2))::INT % 128) AS b, count(*) AS n FROM (SELECT id, i, unnest(list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda x: x <> '')) AS w FROM c) GROUP BY ALL),
q AS (SELECT (('0x' || right(sha1(w), 2))::INT % 128) AS b, count(*) AS n FROM (SELECT unnest(string_split('{query}', ' ')) AS w) GROUP BY 1),
r AS (SELECT w.id, w.i, coalesce(sum(w.n * q.n), 0) / (sqrt(sum(w.n * w.n)) * (SELECT sqrt(sum(n * n)) FROM q)) AS raw FROM w LEFT JOIN q USING (b) GROUP BY ALL),
bd AS (SELECT id, {_TERMS} AS ts FROM {_DEDUP}), bc AS (SELECT id, len(ts) AS n, {count} FROM bd), bs AS (SELECT count(*) AS docs, avg(n) AS av, {df} FROM bc), bi AS (SELECT *, {idf} FROM bs),
best AS (SELECT id, -({rank}) AS rank FROM bc, bi WHERE {" AND ".join(f"a{i} > 0" for i in range(len(strong)))} ORDER BY rank, id LIMIT {max(4 * top_k, 20)}),
s AS (SELECT c.*, raw, best.rank, lower(concat_ws(' ', sender, recipients)) AS people, lower(concat_ws(' ', text, subject, sender, recipients)) AS hay FROM c JOIN r USING (id, i) LEFT JOIN best USING (id))
SELECT 'message:' || id || ':' || i AS citation_id, id AS message_id, round(score, 4) AS score, round(raw, 4) AS raw_score FROM (SELECT *, raw + CASE WHEN NOT EXISTS (SELECT 1 FROM best) THEN 0 WHEN rank IS NOT NULL THEN 0.25 / (rank + 0.001) ELSE -0.6 END
 + CASE WHEN {hits("people", strong)} > 0 THEN 0.2 ELSE -0.8 END + CASE WHEN {hits("hay", strong)} > 0 THEN 0.15 * {hits("hay", strong)} + 0.05 * {hits("hay", words)} ELSE -0.5 END AS score FROM s) ORDER BY score DESC, raw DESC, 'message:' || id, i LIMIT {top_k}"""


ORACLES["hybrid_search"] = _hybrid("latest premium receipt from the insurance brokers", ["premium", "receipt", "insurance", "brokers"], ["latest", "premium", "receipt", "from", "the", "insurance", "brokers"], 10)


def _replaced(column: str, table: list[tuple[str, str]]) -> str:
    for pattern, repl in table:
        column = f"regexp_replace({column}, '{pattern}', '{repl.replace('$1', chr(92) + '1')}', 'g')"
    return column


def _first(column: str, table: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{code}'" for p, code in table) + " END"


def _blank_to_null(column: str) -> str:
    return rf"nullif(trim(regexp_replace({column}, '[\s\x{{00A0}}]+', ' ', 'g')), '')"


def _unit_behind(column: str) -> str:
    """What stands behind the number, or the range, at the head of a text."""
    giga = rf"nullif(regexp_extract({column}, '(?i)(x?10[\^*]9\s*/\s*l)\s*$', 1), '')"
    rest = rf"regexp_replace({column}, '^[^\d]*\d[\d.,]*(?:\s*(?:-|–|to)\s*\d[\d.,]*)?\s*', '')"
    return _blank_to_null(f"coalesce({giga}, CASE WHEN regexp_matches({column}, '[0-9]') AND NOT regexp_matches({rest}, '^[0-9.,]') THEN {rest} END)")


def _units() -> str:
    """Units by their spelling alone: what the evidence of the other sources confirms on these tables."""
    fold = _replaced("lower(u)", units._UNIT_WORDS)
    code_fold = _replaced("lower(unit_code)", units._UNIT_WORDS)
    amount, currency = _first("lower(amount_text)", units._SCALES), f"coalesce({_first('lower(currency)', units._CURRENCIES)}, {_first('lower(amount_text)', units._CURRENCIES)})"
    return f"""WITH k AS (SELECT lower(quantity) AS q, unit_code, common_unit, {code_fold} AS f FROM unit_factors), g AS (SELECT q FROM k WHERE unit_code = '10^9/L'),
l AS (SELECT result_id, lower(regexp_replace(trim(test_name), '\\s+', ' ', 'g')) AS q, coalesce({_blank_to_null("measurement_units")}, {_unit_behind("measurement_text")}, {_unit_behind("reference_range")}) AS u FROM lab_results),
lf AS (SELECT *, CASE WHEN q IN (SELECT q FROM g) THEN regexp_replace({fold}, '^g/l$', '10^9/l') ELSE {fold} END AS f FROM l WHERE u IS NOT NULL),
m AS (SELECT record_id, {currency} AS c, {amount} AS s FROM financial_records)
SELECT DISTINCT 'lab_results' AS record_table, result_id AS record_id, unit_code FROM lf JOIN k USING (q, f) WHERE unit_code <> common_unit
UNION ALL SELECT DISTINCT 'financial_records', record_id, unit_code FROM m JOIN k ON k.q = 'money' AND unit_code = concat_ws(' ', c, s) WHERE c IS NOT NULL AND unit_code <> common_unit"""


ORACLES["p7_found"] = _units()
