import pytest
from pyspark.sql import functions as F

from knowloom.config import load_settings, parse_bool
from knowloom.functions import embed, ids, text, values


def one(spark, column, **row):
    fields = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], fields).select(column.alias("x")).first().x


@pytest.mark.parametrize(("t", "want"), [("Rs. 200000.00", 200000), ("USD 3,955", 3955), ("Amount Paid: 12.50", 12.5), ("No digits here", None), ("Rs. 5 lakhs", 500000), ("Amount: 2 lakh", 200000), ("1 crore", 10000000)])
def test_graph_amount(spark, t, want):
    assert one(spark, values.graph_amount(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("Rs 1000", "INR"), ("Amount (INR)", "INR"), ("USD 45", "USD"), ("€25", "EUR"), ("£10", "GBP"), ("Unknown", None)])
def test_graph_currency(spark, t, want):
    assert one(spark, values.graph_currency(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("1,234,567", 1234.0), ("3,5", 35.0), ("4.0-5.7", 4.0), ("none", None)])
def test_first_number(spark, t, want):
    assert one(spark, values.first_number(F.col("t")), t=t) == want


@pytest.mark.parametrize(("t", "want"), [("2023-8-1", "2023-08-01"), ("01/02/23", None), ("16 aug 2023", "2023-08-16"), (None, None)])
def test_dates(spark, t, want):
    assert one(spark, values.iso_date(F.col("t"), values.LAB_DATE_PATTERNS), t=t) == want


@pytest.mark.parametrize(("t", "d", "want"), [("123 Weird Label!", "Entity", "_123_Weird_Label"), ("", "Entity", "Entity"), (None, "Entity", "Entity"), ("has space", "RELATED_TO", "has_space"), ("1bad-type", "RELATED_TO", "_1bad_type")])
def test_graph_names(spark, t, d, want):
    assert one(spark, text.graph_name(F.col("t"), d), t=t) == want


def test_embedding_golden_and_zero(spark):
    v = one(spark, embed.HashedEmbedder().embed(F.col("t")), t="the quick brown fox the")
    assert {i: round(x, 6) for i, x in enumerate(v) if x} == {16: 0.377964, 26: 0.377964, 103: 0.377964, 110: 0.755929}
    assert one(spark, embed.HashedEmbedder().embed(F.col("t")), t="  ") == [0.0] * 128
    assert [round(x, 5) for x in embed.HashedEmbedder().embed_query("the quick brown fox the")] == [round(x, 5) for x in v]


def test_ids(spark):
    assert one(spark, ids.entity_id(F.lit("LAB_TEST"), F.col("t")), t="HbA1c") == "LAB_TEST:6dc0d33f57283063"
    assert one(spark, ids.entity_id(F.lit("MONEY"), F.col("t")), t="INR 1500") == "MONEY:775d07d9e8c0db3a"
    assert ids.task_id("semantic_index", {"content_id": "cid-1"}) == "a14333f7bf14d91478efa570896b1891fd90b5c1"


def test_chunks(spark):
    c = one(spark, text.chunks(F.col("t")), t="ab \n c " * 500)
    assert "".join(c) == " ".join(("ab \n c " * 500).split()) and len(c[0]) == 1000
    assert one(spark, text.chunks(F.col("t")), t=" \n ") == []


def test_spans_and_fences(spark):
    assert one(spark, text.span_of(F.lit("Test HbA1c"), F.col("t"), F.lit(0), F.lit(4)), t="hba1c") == (5, 10)
    assert one(spark, text.span_of(F.lit("Test HbA1c"), F.col("t"), F.lit(0), F.lit(4)), t="zzz") is None
    assert one(spark, text.strip_fences(F.col("t")), t="```json\n[1]\n```") == "[1]"


def test_query_words(spark):
    t = text.query_tokens(F.col("t"))
    assert one(spark, t, t="Last conversation with a.b@c.de. of Ü_x") == ["last", "conversation", "with", "a.b@c.de", "ü_x"]
    assert one(spark, text.strong_tokens(t), t="last home loan home") == ["home", "loan", "home"]


def test_settings(monkeypatch, tmp_path):
    ini = tmp_path / "x.ini"
    ini.write_text("[main]\ndatabase_path = /from/file\nlog_level = debug\nstructured_logging = yes\n")
    monkeypatch.setenv("KNOWLOOM_CONFIG_FILE", str(ini))
    s = load_settings()
    assert (s.database, s.log_level, s.structured_logging) == ("/from/file", "DEBUG", True)
    monkeypatch.setenv("KNOWLOOM_DATABASE", "/from/env")
    assert load_settings().database == "/from/env" and load_settings("/arg").database == "/arg"
    assert [parse_bool(x) for x in ("1", "off", "maybe", None)] == [True, False, None, None]
