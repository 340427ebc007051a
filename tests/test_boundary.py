from __future__ import annotations

import pytest

from cloakstone.operators import boundary, classify, events
from cloakstone.plans import queries
from cloakstone.plans.trial_view import trial_view
from cloakstone.sources import planting
from cloakstone.sources.canary import Canary
from conftest import SMALL

CANARY = Canary("900-00-9999", "Tamsin Orrell")


def check(spark, trial, text, columns=("subject_id", "patient_name"), **options):
    df = spark.createDataFrame([(0, "nothing here"), (1, text)], "id int, text string")
    return boundary.check_boundary(df, "id", "text", CANARY, [trial], list(columns), **{"gaps": None, **options})


@pytest.fixture(scope="module")
def sample(trial):
    return trial.limit(200).cache()


def test_holds(spark, sample):
    row = boundary.assert_boundary(check(spark, sample, "dates like 1999-01-01 are examples"), "ingest")
    assert row["passed"] and row["lookalikes"] == 1 and row["lookalikes_real"] == 0 and row["values_compared"] > 200


def test_order_of_failures(spark, sample):
    person = sample.where("trim(email) <> ''").first()
    cases = {
        "canary": f"{CANARY.name} and {person['email'].strip()}", "lookalike found in the data": f"mail {person['email'].strip()}",
        "identifier value": f"met {person['patient_name'].strip()}",
    }
    for failure, text in cases.items():
        verdict = check(spark, sample, text)
        assert verdict.first()["first_failure"] == failure
        with pytest.raises(boundary.BoundaryBreached) as caught:
            boundary.assert_boundary(verdict, "review")
        assert person["email"].strip() not in str(caught.value) and "review" in str(caught.value)


def test_fails_closed(spark, sample):
    assert check(spark, sample, "clean", columns=["unknown"]).first()["first_failure"] == "no values compared"
    gaps = spark.createDataFrame([("s", False)], "session_id string, complete boolean")
    assert check(spark, sample, "clean", gaps=gaps).first()["first_failure"] == "incomplete history"
    assert check(spark, sample, "clean").first()["passed"]


@pytest.mark.parametrize("numbers, failure", [([3, 4, 5], None), ([3, 5], "incomplete history"), ([3, None, 4], None)])
def test_a_hole_in_the_log_fails_a_clean_text(spark, sample, numbers, failure):
    log = spark.createDataFrame([("s", n) for n in numbers] + [("t", 9)], "session_id string, seq long")
    row = check(spark, sample, "clean", gaps=events.sequence_gaps(log)).first()
    assert (row["first_failure"], row["sessions_incomplete"]) == (failure, int(failure is not None))


def test_proof_queries_take_the_gaps_of_their_log(spark):
    import __spark_entry__ as contract

    incomplete = events.sequence_gaps(queries.log(spark, SMALL)).where("NOT complete").count()
    assert incomplete > 0
    for name in ("boundary_verdict", "leak_proof_summary"):
        assert contract.queries()[name](spark, SMALL).first()["sessions_incomplete"] == incomplete


def test_proof_summary(spark, sample):
    threads = spark.createDataFrame([("main", False), ("a", True), ("b", True)], "thread_id string, is_subagent boolean")
    row = boundary.proof_summary(check(spark, sample, "clean"), sample, ["subject_id"], threads).first()
    assert (row["data_rows"], row["subagent_threads"], row["identifier_columns"], row["passed"]) == (200, 2, 1, True)


# --- planting ---


@pytest.mark.parametrize("rows", [3, 4, 50, 10_000])
def test_planted_row_is_interior(rows):
    assert all(0 < planting.interior_row(rows) < rows - 1 for _ in range(20))


def test_too_few_rows():
    with pytest.raises(ValueError):
        planting.interior_row(2)


def test_minted_record_is_planted_once(spark):
    raw = trial_view(spark.read.parquet(f"{SMALL}/orders.parquet"), keep_key=True)
    canary = planting.mint_canary(raw)
    planted = planting.plant(raw, "i", 41, canary).cache()
    planting.assert_planted_once(planted, canary)
    assert planted.where("i = 41").first()["ssn"] == canary.ssn and canary.ssn.startswith("9")
    with pytest.raises(AssertionError):
        planting.assert_planted_once(planted, CANARY)
    found, analysis = classify.identifier_columns(classify.classify(planted.drop("i")))
    assert len(found) == 8 and analysis == ["site", "arm", "baseline", "followup", "outcome_measure", "adverse_event"]


def test_minting_ends_when_all_is_taken(spark, monkeypatch):
    monkeypatch.setattr(planting, "invented_name", lambda: "Some One")
    table = spark.createDataFrame([(" SOME ONE", "x")], "patient_name string, ssn string")
    with pytest.raises(ValueError, match="taken"):
        planting.mint_canary(table)
