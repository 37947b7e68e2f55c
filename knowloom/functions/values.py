"""Numbers, currencies and dates as the fact builders and the payment graph read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowloom.functions.text import normalise_space

# Date patterns of all fact tables, and those of laboratory dates besides.
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy")
LAB_DATE_PATTERNS = (*DATE_PATTERNS, "d MMM yyyy", "d MMMM yyyy")
# Scale words of amounts below one thousand.
_SCALES = (("crore", 1e7), ("lakh", 1e5), ("lac", 1e5), ("thousand", 1e3))


def first_number(text: Column) -> Column:
    """First number of a fact's text with its commas deleted: ``1,234,567`` is 1234, ``3,5`` is 35."""
    n = F.nullif(F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0), F.lit(""))
    return F.replace(n, F.lit(","), F.lit("")).try_cast("double")


def currency_of_fact(text: Column) -> Column:
    """INR, USD, EUR or GBP anywhere in the text, else by a leading sign."""
    u = F.upper(text)
    out = F.lit(None).cast("string")
    for sign, code in (("£", "GBP"), ("€", "EUR"), ("$", "USD"), ("₹", "INR")):
        out = F.when(u.startswith(sign), code).otherwise(out)
    for code in ("GBP", "EUR", "USD", "INR"):
        out = F.when(F.contains(u, F.lit(code)), code).otherwise(out)
    return out


def graph_amount(text: Column) -> Column:
    """First unsigned number after deleting commas; below 1000 a scale word multiplies it."""
    t = F.lower(F.replace(text, F.lit(","), F.lit("")))
    v = F.nullif(F.regexp_extract(t, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    factor = F.lit(1.0)
    for word, f in reversed(_SCALES):
        factor = F.when(F.contains(t, F.lit(word)), F.lit(f)).otherwise(factor)
    return F.when(v < 1000, v * factor).otherwise(v)


def graph_currency(text: Column) -> Column:
    """Currency by signs and codes inside the text, dollars first, ``rs`` anywhere counting as rupees."""
    t = F.lower(text)
    has = lambda *words: F.array_contains(F.array(*(F.contains(t, F.lit(w)) for w in words)), True)
    return F.when(has("usd", "$"), "USD").when(has("inr", "rs", "₹"), "INR").when(has("eur", "€"), "EUR").when(has("gbp", "£"), "GBP")


def amount_of_names(canonical: Column, aliases: Column) -> Column:
    """(value, text) of the first of the names that holds a number; the canonical name without a value otherwise."""
    names = F.concat(F.array(canonical), F.coalesce(aliases, F.array().cast("array<string>")))
    read = F.transform(names, lambda n: F.struct(graph_amount(n).alias("value"), n.alias("text")))
    return F.coalesce(F.try_element_at(F.filter(read, lambda r: r["value"].isNotNull()), F.lit(1)), F.struct(F.lit(None).cast("double").alias("value"), canonical.alias("text")))


def iso_date(text: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """ISO date by the first pattern that fits, null otherwise; month names in any case."""
    t = F.initcap(normalise_space(text))
    return F.coalesce(*(F.try_to_date(t, p) for p in patterns)).cast("string")
