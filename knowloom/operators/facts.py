"""Laboratory, financial and medical facts from mentions that stand near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowloom.functions import ids
from knowloom.functions.text import last_word
from knowloom.functions.values import DATE_PATTERNS, LAB_DATE_PATTERNS, currency_of_fact, first_number, iso_date
from knowloom.operators.merge import replace_by_key

CHUNK = ["content_id", "chunk_index"]
# Labels by role.
MEASUREMENT, LAB_TEST, RANGE = ("MEASUREMENT",), ("LAB_TEST",), ("REFERENCE_RANGE",)
PERSON = ("PATIENT", "PERSON", "NAME")
MONEY, RECORD = ("MONEY", "AMOUNT", "TOTAL"), ("INVOICE", "PAYMENT", "BILL", "RECEIPT")
COUNTERPARTY = ("ORGANIZATION", "PERSON", "VENDOR", "CUSTOMER")
MONEY_DATE, REFERENCE = ("DATE", "PAYMENT_DATE", "DUE_DATE"), ("REFERENCE", "INVOICE_REFERENCE", "INVOICE_NUMBER", "ORDER_NUMBER")
EVENT = ("DIAGNOSIS", "MEDICATION", "PRESCRIPTION", "PROCEDURE", "TREATMENT", "TEST")
CLINICIAN, FACILITY = ("CLINICIAN", "DOCTOR", "PHYSICIAN"), ("FACILITY", "ORGANIZATION", "HOSPITAL")
EVENT_DATE, DOSAGE = ("DATE", "APPOINTMENT", "SCHEDULE"), ("DOSAGE", "FREQUENCY")


def _of(mentions: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return mentions.filter(F.upper("label").isin(list(labels)))


_MENTION = ("mention_id", "entity_id", "label", "text", "start_char", "end_char", "metadata")


def nearest(targets: DataFrame, options: DataFrame, name: str) -> DataFrame:
    """Each target with the option nearest in its chunk as a struct column ``name``, null if there is none.

    Distance runs between span edges, min(|start - end'|, |start' - end|); the
    earlier option wins a tie.
    """
    return nearest_of(targets, {name: options})


def nearest_of(targets: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """``targets`` with the nearest option of every kind as a struct column under its name.

    The nearest option ends nearest before or after the target's start, or starts
    nearest before or after its end: four running extremes over the edges of a
    chunk in order.  All kinds share the edges, so targets and options meet in one
    shuffle by chunk, and no pairs are formed.  Targets come out once per
    ``mention_id``; options without chunk or place are nobody's nearest.
    """
    names = list(kinds)
    placed = F.col("start_char").isNotNull() & F.col("end_char").isNotNull() & F.col("content_id").isNotNull() & F.col("chunk_index").isNotNull()
    whole = F.struct(*(F.col(c) for c in targets.columns))
    spot = lambda df, kind, t: df.select(*CHUNK, F.lit(kind).cast("string").alias("kind"), F.struct(*_MENTION).alias("o"), t.alias("t"))
    parts = [spot(targets, None, whole)] + [spot(df.filter(placed), k, F.lit(None)) for k, df in kinds.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # One row for each edge: an option stands at its start and at its end, a target looks from both.
    edge = F.explode(F.array(F.struct(F.col("o.start_char").alias("at"), F.lit(True).alias("is_start")), F.struct(F.col("o.end_char").alias("at"), F.lit(False).alias("is_start")))).alias("e")
    edges = both.select("*", edge).select(*CHUNK, "kind", "o", "t", "e.at", "e.is_start")
    # Both run from the far end on, so each row is looked at once; at one place options come before targets, and among options the earlier is the last.
    ties = [F.col("kind").isNull(), F.desc("o.start_char"), F.desc("o.mention_id")]
    frames = {s: W.partitionBy(*CHUNK).orderBy(o, *ties).rowsBetween(W.unboundedPreceding, W.currentRow) for s, o in (("b", F.asc("at")), ("a", F.desc("at")))}
    seen = edges
    for side, frame in frames.items():
        hits = {f"_{side}{which}{i}": (F.col("kind") == k) & (F.col("is_start") == (which == "s")) for i, k in enumerate(names) for which in "se"}
        seen = seen.select("*", *(F.last(F.when(hit, F.col("o")), ignorenulls=True).over(frame).alias(c) for c, hit in hits.items()))
    mine = seen.filter(F.col("kind").isNull())

    def best(i: int) -> Column:
        """The nearest of kind i seen from this edge, with its distance."""

        def seen_at(which: str, place: str) -> list[Column]:
            options = [F.col(f"_{side}{which}{i}") for side in "ba"]
            return [F.when(o.isNotNull(), F.struct(F.abs(F.col("at") - o[place]).alias("gap"), o["start_char"].alias("start"), o["mention_id"].alias("id"), o.alias("o"))) for o in options]

        # A target's start is measured to the ends of options, its end to their starts.
        return F.array_min(F.array_compact(F.when(F.col("is_start"), F.array(*seen_at("e", "end_char"))).otherwise(F.array(*seen_at("s", "start_char")))))

    # The two edges of a target lie in one partition: no further shuffle.
    both_edges = mine.select(*CHUNK, F.col("o.mention_id").alias("id"), "t", *(best(i).alias(f"_k{i}") for i in range(len(names)))).groupBy(*CHUNK, "id")
    picked = both_edges.agg(F.first("t").alias("t"), *(F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(names))))
    return picked.select("t.*", *(F.col(f"_k{i}.o").alias(k) for i, k in enumerate(names)))


def first_in_chunk(targets: DataFrame, options: DataFrame, name: str) -> DataFrame:
    """Each target with the first option of its chunk."""
    o = options.groupBy(*CHUNK).agg(F.min_by(F.struct("entity_id", "text", "metadata"), F.struct("start_char", "mention_id")).alias(name))
    return targets.join(o, CHUNK, "left")


def _attribute(meta: Column, key: str, strings_only: bool = True) -> Column:
    """Attribute of a mention; for text attributes numbers and the like do not count."""
    value = F.get_json_object(meta, f"$.attributes.{key}")
    if not strings_only:
        return F.nullif(value, F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(meta), f"$.attributes.{key}", "variant"))
    return F.when(kind == "STRING", value)


def _provenance(meta: Column, **more: Column) -> Column:
    parts = {k: F.get_json_object(meta, f"$.{k}") for k in ("page", "filename", "subject", "message_id", "attachment_id")} | more
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))


def _last_written(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one id the one that stands last in the text."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_start"), F.desc("_mention")))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n", "_start", "_mention")


def _mine(mentions: DataFrame, extractor: str, content_id: str | None) -> DataFrame:
    m = mentions.filter(F.col("extractor") == extractor)
    return m if content_id is None else m.filter(F.col("content_id") == content_id)


def lab_results(mentions: DataFrame, extractor: str, created_at: Column, content_id: str | None = None) -> DataFrame:
    """One row per measurement: nearest test, range and date, first person of the chunk."""
    m = _mine(mentions, extractor, content_id)
    t = _of(m, MEASUREMENT)
    t = nearest_of(t, {"test": _of(m, LAB_TEST), "rng": _of(m, RANGE), "day": _of(m, ("DATE",))})
    t = first_in_chunk(t, _of(m, PERSON), "who")
    meta = F.col("metadata")
    text = F.coalesce(_attribute(meta, "value"), F.col("text"))
    rows = t.select(
        ids.fact_id(F.col("content_id"), F.col("chunk_index"), F.col("entity_id"), F.col("test.entity_id")).alias("result_id"),
        "extractor", F.col("test.entity_id").alias("test_entity_id"), F.col("entity_id").alias("measurement_entity_id"), F.col("rng.entity_id").alias("reference_entity_id"),
        F.col("test.text").alias("test_name"), text.alias("measurement_text"), first_number(text).alias("measurement_value"),
        F.coalesce(_attribute(meta, "units", False), last_word(F.col("text"))).alias("measurement_units"),
        F.coalesce(_attribute(F.col("rng.metadata"), "range"), F.col("rng.text")).alias("reference_range"),
        F.col("day.text").alias("date_raw"), iso_date(F.col("day.text"), LAB_DATE_PATTERNS).alias("date_parsed"), F.col("who.text").alias("patient"),
        F.get_json_object(meta, "$.message_id").alias("message_id"), F.get_json_object(meta, "$.attachment_id").alias("attachment_id"), "content_id", "chunk_index",
        _provenance(meta, measurement_attributes=F.get_json_object(meta, "$.attributes"), reference_attributes=F.get_json_object("rng.metadata", "$.attributes")).alias("metadata"),
        created_at.alias("created_at"), F.col("start_char").alias("_start"), F.col("mention_id").alias("_mention"),
    )
    return _last_written(rows, "result_id")


def financial_records(mentions: DataFrame, extractor: str, created_at: Column, content_id: str | None = None) -> DataFrame:
    """One row per amount: nearest record, counterparty, date and reference."""
    m = _mine(mentions, extractor, content_id)
    t = nearest_of(_of(m, MONEY), {"rec": _of(m, RECORD), "party": _of(m, COUNTERPARTY), "day": _of(m, MONEY_DATE), "ref": _of(m, REFERENCE)})
    meta = F.col("metadata")
    text = F.coalesce(_attribute(meta, "amount"), F.col("text"))
    rows = t.select(
        ids.fact_id(F.col("content_id"), F.col("chunk_index"), F.col("entity_id"), F.col("rec.entity_id")).alias("record_id"),
        "extractor", F.coalesce(F.upper("rec.label"), F.lit("PAYMENT")).alias("record_type"), first_number(text).alias("amount_value"), text.alias("amount_text"),
        F.coalesce(_attribute(meta, "currency"), currency_of_fact(text)).alias("currency"), F.col("party.text").alias("counterparty"), F.col("ref.text").alias("reference"),
        F.col("day.text").alias("date_raw"), iso_date(F.col("day.text"), DATE_PATTERNS).alias("date_parsed"),
        F.get_json_object(meta, "$.message_id").alias("message_id"), F.get_json_object(meta, "$.attachment_id").alias("attachment_id"), "content_id", "chunk_index",
        _provenance(meta, amount_attributes=F.get_json_object(meta, "$.attributes")).alias("metadata"), created_at.alias("created_at"),
        F.col("start_char").alias("_start"), F.col("mention_id").alias("_mention"),
    )
    return _last_written(rows, "record_id")


def medical_events(mentions: DataFrame, extractor: str, created_at: Column, content_id: str | None = None) -> DataFrame:
    """One row per event: nearest patient, clinician, facility, date and dosage."""
    m = _mine(mentions, extractor, content_id)
    t = nearest_of(_of(m, EVENT), {"who": _of(m, PERSON), "doctor": _of(m, CLINICIAN), "place": _of(m, FACILITY), "day": _of(m, EVENT_DATE), "dose": _of(m, DOSAGE)})
    meta = F.col("metadata")
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.from_json(F.get_json_object(meta, "$.attributes"), "map<string,string>"), empty)
    extra = F.map_filter(F.create_map(F.lit("dosage"), F.col("dose.text"), F.lit("dosage_attributes"), F.get_json_object("dose.metadata", "$.attributes")), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    rows = t.select(
        ids.fact_id(F.col("content_id"), F.col("chunk_index"), F.col("entity_id")).alias("event_id"),
        "extractor", F.upper("label").alias("event_type"), F.col("text").alias("description"), F.to_json(F.map_concat(own, extra)).alias("attributes"),
        F.col("who.text").alias("patient"), F.col("doctor.text").alias("clinician"), F.col("place.text").alias("facility"),
        F.col("day.text").alias("date_raw"), iso_date(F.col("day.text"), DATE_PATTERNS).alias("date_parsed"),
        F.get_json_object(meta, "$.message_id").alias("message_id"), F.get_json_object(meta, "$.attachment_id").alias("attachment_id"), "content_id", "chunk_index",
        _provenance(meta).alias("metadata"), created_at.alias("created_at"), F.col("start_char").alias("_start"), F.col("mention_id").alias("_mention"),
    )
    return _last_written(rows, "event_id")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of every chunk that gave new ones replaced together, whatever extractor they came from."""
    return replace_by_key(old, new, CHUNK)
