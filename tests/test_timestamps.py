import pandas as pd
import pytest
from pyspark.sql import functions as F

from knowloom.operators import timestamps as ts

CASES = [
    ("2019-01-02", None, None, "2019-01-02"),
    ("01/02/2019", "Europe/London", "en-GB", "2019-02-01"),
    ("01/02/2019", "America/New_York", "en-US", "2019-01-02"),
    ("16th February 2019", None, None, "2019-02-16"),
    ("2. März 2019", "Europe/Berlin", "de-DE", "2019-03-02"),
    ("01-JAN-19", None, None, "2019-01-01"),
    ("20190104T042022Z", "Asia/Kolkata", "en-IN", "2019-01-04T04:20:22Z"),
    ("1546594897", None, None, "2019-01-04T09:41:37Z"),
    ("1547199390237", None, None, "2019-01-11T09:36:30Z"),
    ("2019-07-07 15:40 EST", "America/New_York", "en-US", "2019-07-07T20:40:00Z"),
    ("Fri, 18 Jan 2019 17:35:47 +0530", None, None, "2019-01-18T12:05:47Z"),
    ("2019-03-11T18:14:46.565-0400", None, None, "2019-03-11T22:14:46Z"),
    ("6 May 2019, 12.05 a.m.", "Asia/Kolkata", "en-IN", "2019-05-05T18:35:00Z"),
    # Overlap gives the earlier instant, gap the offset before it.
    ("2019-10-27 02:30:00", "Europe/Berlin", "de-DE", "2019-10-27T00:30:00Z"),
    ("2019-03-31 02:30:00", "Europe/Berlin", "de-DE", "2019-03-31T01:30:00Z"),
    ("2019-01-02 10:00", None, None, None),
    ("2019-01-02 10:00", "Mars/Olympus", None, None),
    ("31/02/2022", "Europe/Berlin", "de-DE", None),
    ("Q3 2022", None, None, None),
    ("yesterday", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("9" * 5000, None, None, None),
    ("12/03/1848", "Europe/London", "en-GB", "1848-03-12"),
    ("0999-01-02", None, None, "0999-01-02"),
    ("1848-03-12 10:00", "Europe/Berlin", None, "1848-03-12T09:06:32Z"),
    ("2150-07-01 12:00", "Europe/Berlin", None, "2150-07-01T10:00:00Z"),
    ("0000-01-02", None, None, None),
    (" " * 400 + "2019-01-02" + "\n" * 400, None, None, "2019-01-02"),
]


@pytest.mark.parametrize(("raw", "zone", "locale", "want"), CASES)
def test_forms(raw, zone, locale, want):
    got = ts.normalise_values(pd.Series([raw], dtype=object), pd.Series([zone], dtype=object), pd.Series([locale], dtype=object))[0]
    assert got == want or (want is None and pd.isna(got))


def test_zone_tables_agree_with_the_zone_database():
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    points, offsets = ts.zone_table("Australia/Sydney")
    z = ZoneInfo("Australia/Sydney")
    import numpy as np

    for y in range(1975, 2035, 3):
        for m in (1, 4, 7, 10):
            local = datetime(y, m, 15, 12)
            sec = int(local.replace(tzinfo=timezone.utc).timestamp())
            assert offsets[np.searchsorted(points, sec, side="right")] == local.replace(tzinfo=z).utcoffset().total_seconds()


def test_tables_found_and_clashing_columns(spark):
    meta = '{"timezone": "Asia/Kolkata", "locale": "en-IN"}'
    df = spark.createDataFrame([("a", "01/02/2019", meta, "x"), ("a", "01/02/2019", meta, "x"), ("b", "2019-01-02", meta, "x"), ("c", "2019-01-02 10:00:00", "not json", "x"), ("d", None, None, "x")], "result_id string, date_raw string, metadata string, zone string")
    lab = df
    fin = df.withColumnRenamed("result_id", "record_id").filter("false")
    med = df.withColumnRenamed("result_id", "event_id").filter("false")
    got = ts.found({"lab_results": lab, "financial_records": fin, "medical_events": med}).collect()
    assert [tuple(r) for r in got] == [("lab_results", "a", "2019-02-01")]
    assert ts.normalise_dates(df.withColumn("extra", F.lit(1))).columns[-2:] == ["normal_form", "zone_version"]
