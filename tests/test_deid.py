from __future__ import annotations

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cloakstone.operators import classify, deid, verify
from cloakstone.plans.trial_view import COLUMNS


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("1981-12-07", dt.date(1981, 12, 7)), ("12/07/1981", dt.date(1981, 12, 7)), ("7 Dec 1981", dt.date(1981, 12, 7)),
        ("Dec 7, 1981", dt.date(1981, 12, 7)), ("7 dec 1981", dt.date(1981, 12, 7)), ("2/3/1950", dt.date(1950, 2, 3)),
        ("31/12/1981", None), ("1981-02-30", None), ("7 December 1981", None), ("7 Foo 1981", None), ("", None), ("nan", None),
    ],
)
def test_four_layouts_and_no_others(spark, text, date):
    assert one(spark, deid.parse_date(F.col("v")), text) == date


@pytest.mark.parametrize(
    ("born", "band"),
    [("1980-01-01", "45-54"), ("1971-01-01", "55-64"), ("1971-01-02", "45-54"), ("1981-01-01", "45-54"),
     ("1981-01-02", "35-44"), ("2023-05-05", "0-4"), ("2020-12-31", "5-14"), ("2030-01-01", None)],
)
def test_age_bands(spark, born, band):
    as_of = dt.date(2026, 1, 1)
    assert one(spark, deid.age_band(deid.age_in_years(deid.parse_date(F.col("v")), as_of)), born) == band


@pytest.mark.parametrize(
    ("text", "number"),
    [("62.5", 62.5), (" 62.5", 62.5), ("62.5 pts", 62.5), ("-5.6", -5.6), ("+3", 3.0), ("", None), ("n/a", None),
     ("12abc34", None), ("nan", None), ("Infinity", None)],
)
def test_measures(spark, text, number):
    assert one(spark, deid.parse_measure(F.col("v")), text) == number


@pytest.mark.parametrize(
    ("text", "flag"), [("Yes", 1), ("Y", 1), ("yes", 1), ("TRUE", 1), ("1", 1), ("No", 0), ("N", 0), ("no", 0),
                       ("FALSE", 0), (" 0 ", 0), ("maybe", None), ("", None)],
)
def test_flags(spark, text, flag):
    assert one(spark, deid.parse_flag(F.col("v")), text) == flag


def test_pseudonyms_plain_and_keyed(spark):
    plain = one(spark, deid.pseudonym(F.col("v")), "MRN123456")
    assert plain == hashlib.sha256(b"MRN123456").hexdigest()[:12]
    for key in (b"k", b"x" * 64, b"y" * 100):
        keyed = one(spark, deid.pseudonym(F.col("v"), key), "MRN123456")
        assert keyed == hmac.new(key, b"MRN123456", hashlib.sha256).hexdigest()[:12]
    assert one(spark, deid.pseudonym(F.col("v")), "  ") is None


def test_no_row_is_lost_and_nothing_identifying_is_left(trial):
    clean = deid.scrub(trial)
    assert clean.count() == trial.count()
    assert clean.columns == ["subject_pseudo_id", "age_band", "site", "arm", "baseline", "followup", "outcome_measure", "adverse_event"]
    assert classify.classify(clean).where("pii_type is not null").count() == 0


def test_verdict_drives_suppression_of_renamed_columns(trial):
    renamed = trial.withColumnRenamed("ssn", "remarks").withColumn("visit", F.lit("week 8"))
    found, analysis = classify.identifier_columns(classify.classify(renamed))
    assert "remarks" in found and "visit" in analysis
    clean = deid.scrub(renamed, identifiers=found)
    assert "remarks" not in clean.columns and "visit" in clean.columns
    assert not set(COLUMNS[:8]) & set(clean.columns)


def test_summary_counts_without_values(frame, trial):
    spoiled = trial.withColumn("dob", F.lit("not a date")).withColumn("arm", F.lit("other"))
    row = deid.scrub_summary(spoiled).first()
    assert row["dob_unparsed"] == row["arm_unknown"] == row["row_count"] == trial.count()
    assert row["columns_dropped"] == 6 and row["flag_unknown"] == 0


def test_collisions(trial):
    row = deid.pseudonym_collisions(trial).first()
    assert row["pseudonyms"] == trial.count() and row["collisions"] == 0


CANARY = '{"ssn":"917-30-5521","name":"Tamsin Orrell"}'


def test_verification(frame):
    clean = frame(age_band=["45-54", "55-64"], arm=["t", "p"])
    row = verify.verify(clean, CANARY, "run-abc").first()
    assert row["passed"] and row["canary_present"] is False and row["run_id"] == "run-abc"
    assert row["columns"] == ["age_band", "arm"] and row["row_count"] == 2
    assert verify.verify(clean).first()["canary_present"] is None


@pytest.mark.parametrize(
    ("column", "kind"),
    [("900-11-2222", "ssn"), ("a@b.org", "email"), ("555-555-0148", "phone"), ("1981-12-07", "dob"),
     ("MRN123456", "mrn"), ("Ada Lovelace", "name"), ("4 Mill St, Town, OH 44000", "address"), ("STUDY-0001", "study_id")],
)
def test_survivors_are_found_by_value(frame, column, kind):
    row = verify.verify(frame(notes=[column], arm=["t"])).first()
    assert not row["passed"]
    assert [(s["name"], s["pii_type"]) for s in row["surviving_identifier_columns"]] == [("notes", kind)]


def test_canary_in_free_text_fails(frame):
    row = verify.verify(frame(comment=["seen 917-30-5521 today", "x"], arm=["t", "p"]), CANARY).first()
    assert row["canary_present"] is True and not row["passed"]


@pytest.mark.parametrize(
    ("text", "problem"),
    [(None, "not found"), ("{not json", "valid JSON"), ('{"row_index":3}', "non-empty string"), ('{"ssn":1,"name":2}', "non-empty string"),
     ('{"ssn":["900-11-2222"],"name":"A B"}', "non-empty string"), ('{"ssn":"","name":"A B"}', "non-empty string"),
     ('{"ssn":true,"name":true}', "non-empty string"), ("[]", "non-empty string"), ("null", "non-empty string")],
)
def test_unusable_canary_fails_with_a_reason(frame, text, problem):
    row = verify.verify(frame(age_band=["45-54"]), text, canary_required=True).first()
    assert not row["passed"] and problem in row["error"] and row["canary_present"] is None


def test_canary_record(spark, tmp_path):
    from cloakstone.sources.canary import CanaryError, parse_canary, read_canary

    full = parse_canary('{"ssn":"917-30-5521","name":"A B","row_index":126,"subject_id":"STUDY-0127","run_id":"r"}', "r")
    assert (full.row_index, full.subject_id) == (126, "STUDY-0127")
    short = parse_canary('{"ssn":"917-30-5521","name":"A B"}')
    assert (short.row_index, short.subject_id) == (-1, "unknown")
    with pytest.raises(CanaryError, match="another run"):
        parse_canary('{"ssn":"917-30-5521","name":"A B","run_id":"old"}', "r")
    path = tmp_path / "canary.json"
    path.write_text(CANARY)
    assert read_canary(spark, str(path)).ssn == "917-30-5521"
