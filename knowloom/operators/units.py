"""Quantities recorded in different units, brought to common units.

A *source* is what one extractor writes as one spelling of a unit for one
quantity.  Sources are linked by the entities they share: the lower and the
upper reference limit of the test, and the patients measured in both.  The graph
has a node for every source and, in each round, one for every code: all sources
labelled with it, pooled.  An edge between a source and a code carries a scale
and an offset, estimated robustly from the shared entities (from the median
limits, else from the quartiles of the shared patients), and is snapped to the
nearest known conversion of ``unit_factors``; each edge votes for the code that
its conversion gives the source.  Labels start at the spellings that are codes
and spread in rounds until nothing changes, so a source may be reached through
sources that were labelled before it.

What the limits and patients say goes before what is written: a source whose
spelling names another unit is corrected.  The words of a spelling decide only
between codes of equal conversions (such as ng/mL and ug/L), and where a source
shares too little with others.  Money has no entity that two sources share, its
codes are read from currency and amount text; rates are those of ``unit_factors``.

Defined results
---------------
* unit stated nowhere, unknown quantity, unit not of the quantity: no code;
* ``evidence`` is ``code`` (spelled as a code, not contradicted), ``estimated``
  (by the graph), ``corrected`` (by the graph, against the spelling) or
  ``spelling`` (by its words only);
* a comma in a measured value is a decimal comma, as laboratories write no
  grouped thousands; money groups by the locale of the source;
* no number in the text: the stored value is converted; no value: null;
* null columns never drop a row, repeated rows stay repeated, further columns
  are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.numbers import written_number
from knowloom.session import bounded_broadcast, materialise

#: Relative error up to which an estimate from limits, or from shared patients, meets a known conversion.
TOLERANCE, PATIENT_TOLERANCE = 0.02, 0.15
#: Rows with limits, and shared patients, that an edge needs; rows that a correction needs.
MIN_EVIDENCE, MIN_PATIENTS, MIN_CORRECTION = 3, 30, 5
#: Rounds after which labels that still change are taken as they are.
MOST_ROUNDS = 8

# Written unit words and the symbol each stands for, applied in this order.
_UNIT_WORDS = [
    (r"[µμ]", "u"),
    (r"[°º]", "deg"),
    (r"\s+", ""),
    (r"percent|pct", "%"),
    (r"(ngsp|ifcc|hb|hba1c)$", ""),
    (r"\.l-1$", "/l"),
    (r"per", "/"),
    (r"cumm|cu\.mm|mm3", "ul"),
    (r"decilit(re|er)s?", "dl"),
    (r"millilit(re|er)s?", "ml"),
    (r"microlit(re|er)s?", "ul"),
    (r"lit(re|er)s?", "l"),
    (r"millimol(e?s)?|mmol(e?s)", "mmol"),
    (r"micromol(e?s)?|mcmol", "umol"),
    (r"nanomol(e?s)?", "nmol"),
    (r"milligrams?|mgs", "mg"),
    (r"nanograms?", "ng"),
    (r"micrograms?|mcg", "ug"),
    (r"kilograms?|kilos?|kgs", "kg"),
    (r"grams?|gms?", "g"),
    (r"milli-?iu", "miu"),
    (r"micro-?iu", "uiu"),
    (r"^mu/", "miu/"),
    (r"lakhs?|lacs?", "lakh"),
    (r"cells", ""),
    (r"^x?10[\^*]9/", "10^9/"),
    (r"^(mg|g)%$", "$1/dl"),
    (r"^mm$", "mmol/l"),
    (r"^(deg)?c(elsius)?$|^degrees?c(elsius)?$", "cel"),
    (r"^(deg)?f(ahrenheit)?$|^degrees?f(ahrenheit)?$", "degf"),
    (r"^centimet(re|er)s?$|^cms$", "cm"),
    (r"^met(re|er)s?$|^mtrs?$", "m"),
    (r"^inch(es)?$|^in\.$", "in"),
    (r"^pounds?$|^lbs?\.?$", "lb"),
]
_GIGA_PER_LITRE = (r"^g/l$", "10^9/l")

# Written currencies and their codes.
_CURRENCIES = [
    (r"(^|[^a-z])us ?\$|(^|[^a-z])usd([^a-z]|$)|dollars?", "USD"),
    (r"€|(^|[^a-z])eur([^a-z]|$)|euros?", "EUR"),
    (r"£|(^|[^a-z])gbp([^a-z]|$)|pounds?( sterling)?|sterling", "GBP"),
    (r"(^|[^a-z])aed([^a-z]|$)|(^|[^a-z])dhs?\.?([^a-z]|$)|dirhams?", "AED"),
    (r"₹|(^|[^a-z])inr([^a-z]|$)|(^|[^a-z])rs\.?([^a-z]|$)|rupees?", "INR"),
    (r"\$", "USD"),
]
# Written scale words and their names in the codes.
_SCALES = [
    (r"\d\s*(crores?|cr)\b", "crore"),
    (r"\d\s*(lakhs?|lacs?|l)\b", "lakh"),
    (r"\d\s*(millions?|mio|mn|m)\b", "million"),
    (r"\d\s*(thousands?|thsd|k)\b", "thousand"),
]


def fold_unit(unit: Column) -> Column:
    """Unit spelling with its words replaced by symbols, for comparison with a folded code."""
    u = F.lower(unit)
    for pattern, repl in _UNIT_WORDS:
        u = F.regexp_replace(u, pattern, repl)
    return u


def _quantity_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def _blank_to_null(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return F.when(t != "", t)


def stated_unit(units: Column, text: Column, reference: Column) -> Column:
    """The unit of a lab row: stated in its own column, else behind the number, else behind the range."""

    def behind(c: Column) -> Column:
        giga = F.regexp_extract(c, r"(?i)(x?10[\^*]9\s*/\s*l)\s*$", 1)
        rest = F.regexp_extract(c, r"^[^\d]*+\d[\d.,]*+(?:\s*(?:-|–|to)\s*\d[\d.,]*+)?+\s*([^\d\s.,].*?)\s*$", 1)
        return _blank_to_null(F.when(giga != "", giga).otherwise(rest))

    return F.coalesce(_blank_to_null(units), behind(text), behind(reference))


def lab_measurements(lab: DataFrame) -> DataFrame:
    """Lab rows reduced to id, quantity key, extractor, patient, stated unit, reference limits and the value as written."""
    ref = F.regexp_replace(F.col("reference_range"), r"(?i)x?10[\^*]9\s*/\s*l\s*$", "")
    number = r"(\d[\d.,]*)"
    pair = rf"{number}\s*(?:-|–|to)\s*{number}"
    top = rf"(?i)(?:<|up to|below|upto)\s*=?\s*{number}"
    value_text = F.regexp_replace(F.col("measurement_text"), r"(?i)x?10[\^*]9\s*/\s*l\s*$", "")
    return lab.select(
        F.col("result_id").alias("record_id"),
        _quantity_key(F.col("test_name")).alias("quantity_key"),
        F.coalesce("extractor", F.lit("")).alias("extractor"),
        "patient",
        stated_unit(F.col("measurement_units"), F.col("measurement_text"), F.col("reference_range")).alias("unit_text"),
        written_number(F.nullif(F.regexp_extract(ref, pair, 1), F.lit("")), F.lit(False)).alias("low"),
        F.coalesce(written_number(F.nullif(F.regexp_extract(ref, pair, 2), F.lit("")), F.lit(False)), written_number(F.nullif(F.regexp_extract(ref, top, 1), F.lit("")), F.lit(False))).alias("high"),
        F.coalesce(written_number(value_text, F.lit(True), F.lit(False)), F.col("measurement_value")).alias("value"),
    )


SOURCE = ["quantity_key", "extractor", "unit_text"]


def shared_entities(measured: DataFrame) -> DataFrame:
    """(source, entity, x, n): what a source says of an entity, in its own unit; entities are the limits and the patients."""
    m = measured.filter(F.col("unit_text").isNotNull() & F.col("quantity_key").isNotNull())
    limits = m.groupBy(*SOURCE).agg(*(f(c).alias(f"{k}_{c}") for c in ("low", "high") for k, f in (("n", F.count), ("x", lambda c: F.percentile_approx(c, 0.5, 1000)))))
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("entity"), F.col(f"x_{c}").alias("x"), F.col(f"n_{c}").alias("n")) for c in ("low", "high")))).alias("e")
    limits = limits.select(*SOURCE, both).select(*SOURCE, "e.*").filter((F.col("n") >= MIN_EVIDENCE))
    patients = m.filter(F.col("patient").isNotNull() & F.col("value").isNotNull())
    patients = patients.groupBy(*SOURCE, F.concat(F.lit("patient:"), "patient").alias("entity")).agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n"))
    return limits.unionByName(patients)


def _edges(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges from every source to every code of its quantity: scale and offset from the source to the code, and where they were estimated."""
    labelled = seen.join(bounded_broadcast(labels), SOURCE)
    pooled = labelled.groupBy("quantity_key", F.col("code").alias("to_code"), "entity").agg(F.percentile_approx("x", 0.5, 1000).alias("y"), F.count(F.lit(1)).alias("members"))
    is_patient = F.col("entity").startswith("patient:")
    at = lambda name, c: F.max(F.when(F.col("entity") == name, F.col(c)))
    quartiles = lambda c: F.percentile_approx(F.when(is_patient, F.col(c)), [0.25, 0.5, 0.75], 1000)
    met = seen.join(pooled, ["quantity_key", "entity"]).groupBy(*SOURCE, "to_code").agg(
        *(at(e, c).alias(f"{c}_{e}") for e in ("low", "high") for c in ("x", "y")), at("high", "n").alias("rows"), F.max("members").alias("members"),
        F.count(F.when(is_patient, 1)).alias("patients"), quartiles("x").alias("xs"), quartiles("y").alias("ys"),
    )
    by_limits = F.col("x_high").isNotNull() & F.col("y_high").isNotNull()
    two = F.col("x_low").isNotNull() & F.col("y_low").isNotNull() & (F.col("x_low") != F.col("x_high"))
    by_patients = ~by_limits & (F.col("patients") >= MIN_PATIENTS) & (F.col("xs")[2] > F.col("xs")[0])
    scale = F.when(by_limits & two, F.try_divide(F.col("y_high") - F.col("y_low"), F.col("x_high") - F.col("x_low"))).when(by_limits, F.try_divide(F.col("y_high"), F.col("x_high")))
    scale = scale.when(by_patients, F.try_divide(F.col("ys")[2] - F.col("ys")[0], F.col("xs")[2] - F.col("xs")[0]))
    offset = F.when(by_limits & two, F.col("y_high") - F.col("scale") * F.col("x_high")).when(by_limits, F.lit(0.0)).when(by_patients, F.col("ys")[1] - F.col("scale") * F.col("xs")[1])
    out = met.withColumn("scale", scale).withColumn("offset", offset).filter(F.col("scale").isNotNull())
    return out.select(
        *SOURCE, "to_code", "scale", "offset", "members", by_limits.alias("by_limits"),
        F.when(by_limits, F.coalesce("x_low", "x_high")).otherwise(F.col("xs")[0]).alias("x1"), F.when(by_limits, F.col("x_high")).otherwise(F.col("xs")[2]).alias("x2"),
        F.when(by_limits, F.col("rows")).otherwise(F.floor(F.col("patients") / 10)).alias("weight"),
    )


def _votes(edges: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, factor, shift_by, weight, scale, offset): the conversion that the snapped edges of a source vote for."""
    own = labels.select(*SOURCE, F.col("code").alias("own_code"))
    to = known.select("quantity_key", F.col("unit_code").alias("to_code"), F.col("factor").alias("to_factor"), F.col("shift_by").alias("to_shift"))
    e = edges.join(bounded_broadcast(own), SOURCE, "left")
    # The pool of its own code tells a source something only if others are in it.
    e = e.filter((F.col("to_code") != F.coalesce("own_code", F.lit(""))) | (F.col("members") > 1)).join(bounded_broadcast(to), ["quantity_key", "to_code"])
    options = e.join(bounded_broadcast(known.select("quantity_key", "factor", "shift_by").distinct()), "quantity_key")
    k, d = F.col("factor") / F.col("to_factor"), (F.col("shift_by") - F.col("to_shift")) / F.col("to_factor")
    gap = lambda x: F.abs((k - F.col("scale")) * F.col(x) + d - F.col("offset"))
    size = F.greatest(F.abs(F.col("scale") * F.col("x2") + F.col("offset")), F.lit(1e-12))
    options = options.withColumn("error", F.greatest(gap("x1"), gap("x2")) / size).filter(F.col("error") <= F.when(F.col("by_limits"), TOLERANCE).otherwise(PATIENT_TOLERANCE))
    snapped = options.groupBy(*SOURCE, "to_code").agg(F.min_by(F.struct("factor", "shift_by", "weight", "scale", "offset"), F.struct("error", "factor", "shift_by")).alias("s")).select(*SOURCE, "s.*")
    tally = snapped.groupBy(*SOURCE, "factor", "shift_by").agg(F.sum("weight").alias("weight"), F.max_by("scale", "weight").alias("scale"), F.max_by("offset", "weight").alias("offset"))
    return tally.groupBy(*SOURCE).agg(F.max_by(F.struct("factor", "shift_by", "weight", "scale", "offset"), F.struct("weight", F.col("factor"), F.col("shift_by"))).alias("v")).select(*SOURCE, "v.*")


def label_sources(measured: DataFrame, factors: DataFrame) -> DataFrame:
    """(source, unit_code, scale, offset, evidence) for every source with a known code; scale and offset lead to the pool that weighed most."""
    known = materialise(factors.select(_quantity_key(F.col("quantity")).alias("quantity_key"), "unit_code", fold_unit(F.col("unit_code")).alias("code_fold"), "factor", "shift_by"))
    giga = known.filter(F.col("unit_code") == "10^9/L").select("quantity_key").distinct().withColumn("giga", F.lit(True))
    seen = materialise(shared_entities(measured))
    sources = measured.filter(F.col("unit_text").isNotNull()).select(*SOURCE).distinct().join(bounded_broadcast(giga), "quantity_key", "left").withColumn("fold", fold_unit(F.col("unit_text")))
    sources = sources.withColumn("fold", F.when(F.col("giga"), F.regexp_replace("fold", *_GIGA_PER_LITRE)).otherwise(F.col("fold"))).drop("giga")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    # Every code that a source can have, with what its spelling says for it.
    options = materialise(sources.join(bounded_broadcast(known), "quantity_key").withColumn("lexical", F.col("fold") == F.col("code_fold")).withColumn("is_code", F.col("lexical") & (plain("unit_text") == plain("unit_code"))))
    labels = options.filter("is_code").select(*SOURCE, F.col("unit_code").alias("code"))
    best, before = None, None
    for _ in range(MOST_ROUNDS):
        votes = _votes(materialise(_edges(seen, labels)), known, labels)
        best = options.join(votes, [*SOURCE, "factor", "shift_by"], "left")
        # The voted conversion first; between its codes, and without a vote, the spelling.
        heavy = F.coalesce(F.col("weight") >= F.when(F.col("said"), MIN_EVIDENCE).otherwise(MIN_CORRECTION), F.lit(False))
        w = [F.max(F.col("lexical").cast("int")), F.max("weight")]
        about = best.groupBy(*SOURCE).agg(w[0].alias("readable"), w[1].alias("votes"))
        best = best.join(about, SOURCE).withColumn("said", (F.col("readable") == 0) | F.col("lexical")).withColumn("heavy", heavy)
        usable = best.filter(F.col("lexical") | F.col("heavy"))
        rank = F.struct((~F.col("heavy")).cast("int").alias("v"), (~F.col("lexical")).cast("int").alias("l"), F.length("unit_code").alias("w"), F.col("unit_code").alias("c"))
        best = usable.groupBy(*SOURCE).agg(F.min_by(F.struct("unit_code", "lexical", "is_code", "readable", "heavy", "scale", "offset"), rank).alias("b")).select(*SOURCE, "b.*")
        best = materialise(best)
        labels = best.filter(F.col("heavy") | F.col("is_code")).select(*SOURCE, F.col("unit_code").alias("code"))
        now = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*SOURCE, "code").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    evidence = F.when(F.col("heavy") & (F.col("readable") == 1) & ~F.col("lexical"), "corrected").when(F.col("is_code"), "code").when(F.col("heavy"), "estimated").otherwise("spelling")
    return best.select(*SOURCE, "unit_code", "scale", "offset", evidence.alias("evidence"))


def convert_lab(lab: DataFrame, factors: DataFrame) -> DataFrame:
    """Lab rows with their code and the value in the common unit."""
    measured = lab_measurements(lab)
    labels = materialise(label_sources(measured, factors))
    known = factors.select(_quantity_key(F.col("quantity")).alias("quantity_key"), "unit_code", "common_unit", "factor", "shift_by")
    labels = labels.join(bounded_broadcast(known), ["quantity_key", "unit_code"])
    out = measured.join(bounded_broadcast(labels), SOURCE, "left")
    return out.select(
        F.lit("lab_results").alias("record_table"),
        "record_id",
        "unit_text",
        "unit_code",
        "common_unit",
        "value",
        (F.col("value") * F.col("factor") + F.col("shift_by")).alias("common_value"),
        "evidence",
    )


def _first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, code in reversed(table):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def money_code(currency: Column, amount_text: Column) -> Column:
    """Currency code, with the scale word of the amount text appended; null if no currency is stated."""
    cur, amt = F.lower(currency), F.lower(amount_text)
    base = F.coalesce(_first_match(cur, _CURRENCIES), _first_match(amt, _CURRENCIES))
    scale = _first_match(amt, _SCALES)
    return F.when(scale.isNull(), base).otherwise(F.concat_ws(" ", base, scale))


def convert_money(records: DataFrame, factors: DataFrame) -> DataFrame:
    """Financial rows with their code and the amount in the common currency."""
    money = factors.filter(F.col("quantity") == "Money").select("unit_code", "common_unit", "factor", "shift_by")
    comma = F.get_json_object(F.col("metadata"), "$.locale").eqNullSafe("de-DE")
    code = money_code(F.col("currency"), F.col("amount_text"))
    has_currency = F.coalesce(_first_match(F.lower(F.col("currency")), _CURRENCIES), _first_match(F.lower(F.col("amount_text")), _CURRENCIES)).isNotNull()
    rows = records.select(
        F.col("record_id"),
        F.coalesce(F.col("currency"), F.col("amount_text")).alias("unit_text"),
        F.when(has_currency, code).alias("unit_code"),
        F.coalesce(written_number(F.regexp_replace("amount_text", r"(?i)\brs\.", ""), comma), F.col("amount_value")).alias("value"),
    )
    out = rows.join(bounded_broadcast(money), "unit_code", "left")
    return out.select(
        F.lit("financial_records").alias("record_table"),
        "record_id",
        "unit_text",
        F.when(F.col("common_unit").isNotNull(), F.col("unit_code")).alias("unit_code"),
        "common_unit",
        "value",
        (F.col("value") * F.col("factor") + F.col("shift_by")).alias("common_value"),
        F.when(F.col("common_unit").isNotNull(), "spelling").alias("evidence"),
    )


def convert_all(lab: DataFrame, records: DataFrame, factors: DataFrame) -> DataFrame:
    return convert_lab(lab, factors).unionByName(convert_money(records, factors))


def found(lab: DataFrame, records: DataFrame, factors: DataFrame) -> DataFrame:
    """Distinct records whose unit is known and is not the common unit."""
    c = convert_all(lab, records, factors)
    return c.filter(F.col("unit_code").isNotNull() & (F.col("unit_code") != F.col("common_unit"))).select("record_table", "record_id", "unit_code").distinct()
