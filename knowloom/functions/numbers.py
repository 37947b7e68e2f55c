"""Numbers as people write them, read with JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def written_number(text: Column, comma_decimal: Column, dot_groups: Column | None = None) -> Column:
    """First number of ``text`` as a double, with either separator style.

    With both separators present the last one is the decimal sign, and of a
    repeated separator only the last occurrence can be one.  A last comma before
    exactly three digits groups thousands unless the source writes decimal
    commas (``comma_decimal``) or the number begins with zero; a lone dot before
    three digits groups thousands only where ``dot_groups`` holds (by default
    where the source writes decimal commas).  No digits, or null: null.
    """
    n = F.regexp_extract(text, r"[-−]?\d[\d.,  ' ]*", 0)
    n = F.translate(n, "−  ' ", "-")
    for pattern, repl in (
        (r"[.,]+$", ""),
        (r",(?=.*\.)", ""),
        (r"\.(?=.*,)", ""),
        (r",(?=.*,)", ""),
        (r"\.(?=.*\.)", ""),
    ):
        n = F.regexp_replace(n, pattern, repl)
    dot_groups = comma_decimal if dot_groups is None else dot_groups
    grouped = F.when(dot_groups, r"^(-?[1-9]\d*)\.(\d{3})$").when(comma_decimal, r"$^").otherwise(r"^(-?[1-9]\d*),(\d{3})$")
    n = F.regexp_replace(n, grouped, F.lit("$1$2"))
    return F.translate(n, ",", ".").try_cast("double")
