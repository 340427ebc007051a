from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cloakstone.operators import classify as c
from cloakstone.plans.trial_view import COLUMNS


def typed(df):
    return {r["name"]: (r["pii_type"], r["match_rate"]) for r in c.classify(df).collect()}


def test_each_type_is_found_and_analysis_columns_are_not(trial):
    found = typed(trial)
    wanted = ["study_id", "name", "ssn", "mrn", "dob", "email", "phone", "address"]
    assert [found[n][0] for n in COLUMNS[:8]] == wanted
    assert all(found[n][0] is None for n in COLUMNS[8:])


@pytest.mark.parametrize(
    ("values", "verdict"),
    [
        (["  ADA LOVELACE ", "grace hopper", "Mary-Ann O'Neil  ", "\tJo Li\n"], ("name", 1.0)),
        (["900-11-2222", "", "900-11-2223", "   "], ("ssn", 1.0)),
        (["900-11-2222", "900-11-2223", "900-11-2224", "unknown"], ("ssn", 0.75)),
        (["900-11-2222", "note", "text", "more"], (None, 0.25)),
        (["", "", ""], (None, 0.0)),
        (["1981-12-07", "12/07/1981", "7 Dec 1981", "Dec 7, 1981"], ("dob", 1.0)),
        (["(555) 555-0148", "555.555.0148", "555-555-0148", "+1 555 555 0148"], ("phone", 1.0)),
        (["482 Kestrel Way, Oldtown, IA 50123", "1 a, b, oh 44000"], ("address", 1.0)),
        (["SITE-001", "SITE-001", "SITE-002", "SITE-002"], (None, 1.0)),
        (["STUDY-0001", "STUDY-0002", "STUDY-0003"], ("study_id", 1.0)),
    ],
)
def test_rates(frame, values, verdict):
    assert typed(frame(x=values))["x"] == verdict


def test_rates_round_half_even(frame):
    # 1/32 = 0.03125
    assert typed(frame(x=["900-11-2222"] + ["text"] * 31))["x"] == (None, 0.0312)


def test_counts_and_types(frame):
    rows = c.classify(frame(a=["1", "", "  ", "22"], b=["1.5", "2", "-3", ""], d=["x", "1", "", ""])).collect()
    got = {r["name"]: (r["populated"], r["blank"], r["dtype"]) for r in rows}
    assert got == {"a": (2, 2, "bigint"), "b": (3, 1, "double"), "d": (2, 2, "string")}


def test_mixed_identifiers_show_in_the_extra_rate(frame):
    row = c.classify(frame(x=["900-11-2222", "a@b.org", "MRN12345", "plain"])).first()
    assert row["pii_type"] is None and row["any_identifier_rate"] == 0.75


def test_unicode_digits_are_an_option(frame):
    arabic = frame(x=["١٢٣-٤٥-٦٧٨٩"])
    assert c.classify(arabic).first()["pii_type"] is None
    assert c.classify(arabic, unicode=True).first()["pii_type"] == "ssn"


def test_partitioning_and_row_order_do_not_matter(trial):
    plain = c.classify(trial).collect()
    assert c.classify(trial.orderBy(F.rand(3)).repartition(7)).collect() == plain


def test_document_is_closed_and_value_free(trial):
    document = json.loads(c.rendered(c.verdict_document(c.classify(trial), "run-9")))
    assert set(document) == {"schema_version", "run_id", "row_count", "column_count", "pii_columns", "columns"}
    assert document["run_id"] == "run-9" and document["pii_columns"] == COLUMNS[:8]
    for column in document["columns"]:
        assert set(column) == {"name", "dtype", "populated", "blank", "pii_type", "match_rate", "example"}
        assert column["example"] is None
    text = json.dumps(document)
    for row in trial.limit(50).collect():
        assert not any(len(v.strip()) >= 5 and v.strip() in text for v in row if v.strip().lower() not in ("placebo",))


def test_backstop_names_the_column_but_not_the_value(frame):
    df = frame(code=["abcdef", "xy"], site=["address", "other"])
    c.assert_output_safe(df, "address xy")  # a label of ours, and a value too short to compare
    with pytest.raises(c.ValueExposed) as caught:
        c.assert_output_safe(df, "we saw abcdef here")
    assert "code (6 chars)" in str(caught.value) and "abcdef" not in str(caught.value)


def test_csv_end_to_end(spark, trial, tmp_path):
    from cloakstone.sources import tables

    path = str(tmp_path / "csv")
    tables.write_csv(trial, path)
    back = tables.read_text_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, trial.collect()))
    assert tables.table_digest(back).first() == tables.table_digest(trial).first()
    document = c.classify_csv(spark, path, "run-1").first()
    assert document["row_count"] == trial.count() and len(document["pii_columns"]) == 8
    assert tables.dtype_names(tables.read_typed_csv(spark, path))["baseline"] in ("string", "double")


def test_csv_keeps_blanks_padding_and_na(spark, tmp_path):
    from cloakstone.sources.tables import read_text_csv

    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n x ,NA,""\n"say ""hi""",,z\n')
    rows = [tuple(r) for r in read_text_csv(spark, str(path)).collect()]
    assert rows == [(" x ", "NA", ""), ('say "hi"', "", "z")]
