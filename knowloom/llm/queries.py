"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knowloom.llm import eval_leaks, garbled_text, mail_spans, mixing, name_links, personal_data, similar_vectors, splitting
from knowloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.found(table(spark, sf_dir, "chunk_embeddings"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's five neighbours with similarity and rank, however far they are."""
    return similar_vectors.similar_vectors(table(spark, sf_dir, "chunk_embeddings"), min_similarity=None)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_links.found(table(spark, sf_dir, "financial_records"), table(spark, sf_dir, "medical_events"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value with the entity it names."""
    return name_links.link(table(spark, sf_dir, "financial_records"), table(spark, sf_dir, "medical_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_spans.found(table(spark, sf_dir, "messages"))


def p3_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the text its sender newly wrote."""
    return mail_spans.new_text(table(spark, sf_dir, "messages").select("id", "thread_id", "received_at", "body")).select("id", "thread_id", "new_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(table(spark, sf_dir, "attachment_texts"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their new chunk_index."""
    return splitting.split_items(table(spark, sf_dir, "attachment_texts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(table(spark, sf_dir, "messages"), table(spark, sf_dir, "attachment_texts"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All free-text fields with placeholders in place of personal data."""
    return personal_data.redacted(table(spark, sf_dir, "messages"), table(spark, sf_dir, "attachment_texts"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of both kinds with the longest run of words."""
    return eval_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, globally shuffled."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).mixed()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).report()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_text.found(table(spark, sf_dir, "documents"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their restored texts."""
    return garbled_text.affected(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_entities, p3_found, p3_new_text, p4_found, p4_pieces, p6_found, p6_redacted, p8_found, p8_leaks, p9_mixed, p9_shares, p10_found, p10_restored)}

def _grams(table_name: str, key: str) -> str:
    """All runs of twelve words of a table's texts."""
    return f"""(SELECT DISTINCT {key}, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table_name} WHERE text IS NOT NULL), unnest(range(1, len(ws) - 10)) AS t(i))"""


ORACLES = {
    "p4_found": "SELECT DISTINCT content_id, page, chunk_index FROM attachment_texts WHERE length(text) > 1000",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM {_grams('documents', 'doc_id')} JOIN {_grams('eval_items', 'item_id')} USING (g)",
    "p1_found": """WITH v AS (SELECT DISTINCT embedding_id AS id, content_id AS c, model AS m, vector::DOUBLE[128] AS x FROM chunk_embeddings WHERE len(vector) = 128 AND list_sum(list_transform(vector, lambda y: y::DOUBLE * y)) > 0),
s AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.x, b.x), 6) AS s FROM v a JOIN v b ON a.m = b.m AND a.c <> b.c),
n AS (SELECT a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS embedding_id_a, greatest(a, b) AS embedding_id_b FROM n WHERE s >= 0.85""",
}
