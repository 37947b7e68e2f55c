from pyspark.sql import functions as F

from knowloom.functions.numbers import written_number
from knowloom.operators import units

FACTORS = [("Urea", "mg/dL", "mg/dL", 1.0, 0.0), ("Urea", "mmol/L", "mg/dL", 6.006, 0.0), ("Money", "INR", "INR", 1.0, 0.0), ("Money", "INR lakh", "INR", 1e5, 0.0), ("Money", "USD", "INR", 82.4, 0.0)]
LAB = "result_id string, extractor string, patient string, test_name string, measurement_text string, measurement_value double, measurement_units string, reference_range string, metadata string"
FIN = "record_id string, amount_text string, amount_value double, currency string, metadata string"


def factors(spark):
    return spark.createDataFrame(FACTORS, "quantity string, unit_code string, common_unit string, factor double, shift_by double")


def test_written_numbers(spark):
    cases = [("2,45,000", False, 245000.0), ("1.234,56", True, 1234.56), ("1,234.56", False, 1234.56), ("12,5", False, 12.5), ("1,234", True, 1.234), ("1,234", False, 1234.0), ("0,901", False, 0.901), ("1.234.567", True, 1234567.0), ("x", False, None), (None, False, None), ("-5.", False, -5.0)]
    df = spark.createDataFrame(cases, "t string, c boolean, want double").withColumn("got", written_number(F.col("t"), F.col("c")))
    for r in df.collect():
        assert r.got == r.want, r


def lab_frame(spark, rows):
    """Rows without extractor and patient, or with both behind the id."""
    return spark.createDataFrame([r if len(r) == 9 else (r[0], None, None, *r[1:]) for r in rows], LAB)


def test_lab_units(spark):
    rows = [
        ("1", "Urea", "10 mg/dl", 10.0, "MG/DL", "< 51", None),
        ("2", " urea ", "2,5", 25.0, None, "1.998 - 8.492 mMol/L", None),
        ("3", "UREA", "8.36 millimol/litre", None, "", None, "{bad"),
        ("4", "Urea", "5", 5.0, None, None, None),
        ("5", None, "5 mg/dL", 5.0, "mg/dL", None, None),
        ("6", "Urea", None, None, "furlong", None, None),
    ]
    # A spelling that says nothing is labelled by its limits.
    rows += [(f"q{i}", "Urea", "4.0 qq", 4.0, "qq", "1.998 - 8.492", None) for i in range(4)]
    rows += [(f"m{i}", "Urea", "20 mg/dL", 20.0, "mg/dL", "12 - 51", None) for i in range(4)]
    got = {r.record_id: r for r in units.convert_lab(lab_frame(spark, rows), factors(spark)).collect()}
    assert got["1"].unit_code == "mg/dL" and got["2"].unit_code == "mmol/L" and got["3"].unit_code == "mmol/L"
    assert got["2"].common_value == 2.5 * 6.006
    assert got["4"].unit_code is None and got["5"].unit_code is None and got["6"].unit_code is None
    assert got["q0"].unit_code == "mmol/L" and got["q0"].evidence == "estimated"
    assert len(got) == len(rows)


def test_money(spark):
    rows = [("1", "Rs. 5 lakhs", 5.0, None, None), ("2", "1,234.50", 1.0, "US$", None), ("3", "9.9 lakh", 9.9, None, None), ("4", None, 7.0, "₹", None), ("5", None, None, None, None), ("6", "3 thousand", 3.0, "AED", None)]
    got = {r.record_id: (r.unit_code, r.common_value) for r in units.convert_money(spark.createDataFrame(rows, FIN), factors(spark)).collect()}
    assert got == {"1": ("INR lakh", 500000.0), "2": ("USD", 1234.5 * 82.4), "3": (None, None), "4": ("INR", 7.0), "5": (None, None), "6": (None, None)}


def test_found_counts_records_once_and_empty_tables(spark):
    lab = lab_frame(spark, [("1", "Urea", "2 mmol/L", 2.0, "mmol/L", None, None)] * 3)
    fin = spark.createDataFrame([], FIN)
    assert [tuple(r) for r in units.found(lab, fin, factors(spark)).collect()] == [("lab_results", "1", "mmol/L")]
    assert units.found(lab.filter("false"), fin, factors(spark)).count() == 0


def test_limits_correct_a_wrong_unit(spark):
    rows = [(f"m{x}{i}", x, None, "Urea", "20", 20.0, "mg/dL", "12 - 51", None) for x in ("a", "b", "c") for i in range(6)]
    # One extractor writes the common unit beside values and limits in the other.
    rows += [(f"w{i}", "d", None, "Urea", "4", 4.0, "mg/dL", "1.998 - 8.492", None) for i in range(6)]
    rows += [(f"o{i}", "d", None, "Urea", "4", 4.0, "mmol/L", "1.998 - 8.492", None) for i in range(6)]
    got = {r.record_id: (r.unit_code, r.evidence) for r in units.convert_lab(lab_frame(spark, rows), factors(spark)).collect()}
    assert got["w0"] == ("mmol/L", "corrected") and got["ma0"] == ("mg/dL", "code") and got["o0"] == ("mmol/L", "code")


def test_shared_patients_tell_the_unit_and_labels_spread(spark):
    rows = []
    for i in range(40):
        v = 10.0 + i
        rows.append((f"m{i}", "a", f"p{i}", "Urea", None, v, "mg/dL", None, None))
        # No limits: known by the patients of the first source, in the other unit, with some noise.
        rows.append((f"q{i}", "a", f"p{i}", "Urea", None, round(v * (1 + 0.02 * (-1) ** i) / 6.006, 2), "qq", "1.998 - 8.492" if i < 5 else None, None))
        # Shares no patient with a code, only limits with the second source.
        rows.append((f"z{i}", "b", f"n{i}", "Urea", None, 3.0, "zz", "1.998 - 8.492" if i < 5 else None, None))
    got = {r.record_id: (r.unit_code, r.evidence) for r in units.convert_lab(lab_frame(spark, rows), factors(spark)).collect()}
    assert got["m0"] == ("mg/dL", "code") and got["q0"] == ("mmol/L", "estimated") and got["z0"] == ("mmol/L", "estimated")
