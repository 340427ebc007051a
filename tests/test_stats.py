from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cloakstone.functions import distributions as d
from cloakstone.operators import deid, stats


def test_published_example():
    """t = -3.85 at the Welch degrees of that run gives p = 0.000146; chi2 = 0.30 gives 0.58."""
    assert d.t_two_sided(-3.85, 282.0) == pytest.approx(0.000146, abs=1e-6)
    assert d.chi2_upper(0.30, 1) == pytest.approx(0.5839, abs=1e-4)


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 3.0, 12.0, 40.0])
def test_closed_forms(x):
    assert d.chi2_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    assert d.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert d.chi2_upper(x, 8) == pytest.approx(
        math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(4)), rel=1e-10
    )
    assert d.t_two_sided(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-9)
    assert d.t_two_sided(x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-9)
    assert d.t_two_sided(x, 1e9) == pytest.approx(math.erfc(x / math.sqrt(2)), rel=1e-6)


def test_quantiles():
    assert d.t_critical(0.95, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert d.t_critical(0.95, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert math.isnan(d.t_critical(0.95, float("nan")))


@pytest.fixture()
def arms(spark):
    rows = [("t", x) for x in (1.0, 2.0, 4.0, 7.0)] + [("p", x) for x in (3.0, 5.0, 8.0)] + [("t", None)]
    return spark.createDataFrame(rows, "arm string, y double")


def test_welch(arms):
    row = stats.welch_inference(stats.welch(arms, "y", "arm", "t", "p")).first()
    n1, n2, v1, v2 = 4, 3, 7.0, 19 / 3
    se = math.sqrt(v1 / n1 + v2 / n2)
    assert (row["n_t"], row["n_c"]) == (4, 3)
    assert row["difference"] == pytest.approx(3.5 - 16 / 3)
    assert row["t_statistic"] == pytest.approx((3.5 - 16 / 3) / se)
    assert row["degrees"] == pytest.approx(se**4 / ((v1 / n1) ** 2 / 3 + (v2 / n2) ** 2 / 2))
    assert row["cohens_d"] == pytest.approx((3.5 - 16 / 3) / math.sqrt((3 * v1 + 2 * v2) / 5))
    assert row["ci_low"] < row["difference"] < row["ci_high"]
    assert row["p_value"] == pytest.approx(d.t_two_sided(row["t_statistic"], row["degrees"]))


def test_degenerate_strata_give_null_not_an_error(spark):
    df = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("b", "p", 1.0)], "s string, arm string, y double")
    rows = {r["s"]: r for r in stats.welch_inference(stats.welch(df, "y", "arm", "t", "p", ["s"])).collect()}
    assert rows["a"]["t_statistic"] is None and rows["b"]["degrees"] is None


def brute_chi2(table):
    n = sum(map(sum, table))
    rows, columns = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    yates = len(rows) == len(columns) == 2
    total = 0.0
    for i, r in enumerate(table):
        for j, o in enumerate(r):
            e = rows[i] * columns[j] / n
            gap = abs(o - e)
            total += (gap - min(0.5, gap) if yates else gap) ** 2 / e
    return total


@pytest.mark.parametrize(
    "table", [[[12, 5], [7, 9]], [[10, 10], [10, 10]], [[5, 0], [3, 4]], [[3, 0, 2], [1, 4, 0]], [[30, 1], [2, 0]]]
)
def test_chi_square_matches_the_textbook_sum(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, r in enumerate(table) for j, o in enumerate(r) for _ in range(o)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = stats.chi_square(stats.contingency(df, "a", "b")).first()
    assert got["chi2"] == pytest.approx(brute_chi2(table), abs=1e-9)
    assert got["p_value"] == pytest.approx(d.chi2_upper(got["chi2"], got["degrees"]), abs=1e-12)


def test_report_agrees_with_its_parts(trial):
    clean = deid.scrub(trial)
    report = {(r["section"], r["metric"], r["arm"]): r["value"] for r in stats.report_table(clean).collect()}
    test = stats.welch_inference(stats.welch(clean, "outcome_measure", "arm", "treatment", "placebo")).first()
    for metric in ("difference", "t_statistic", "degrees", "cohens_d", "p_value", "ci_low", "ci_high"):
        assert report["primary", metric, "both"] == pytest.approx(test[metric], rel=1e-9, abs=1e-300)
    chi = stats.chi_square(stats.contingency(clean, "arm", "adverse_event")).first()
    assert report["safety", "chi2", "both"] == pytest.approx(chi["chi2"])
    assert report["safety", "chi2_p", "both"] == pytest.approx(chi["p_value"], rel=1e-6)
    arms = {r["arm"]: r for r in stats.disposition(clean, "arm", "outcome_measure").collect()}
    for arm, row in arms.items():
        assert report["disposition", "randomised", arm] == row["randomised"] == row["completed"] + row["dropped_out"]


def test_strata_add_up(trial):
    clean = deid.scrub(trial)
    by_site = stats.welch(clean, "outcome_measure", "arm", "treatment", "placebo", ["site"])
    whole = stats.welch(clean, "outcome_measure", "arm", "treatment", "placebo").first()
    assert by_site.agg(F.sum("n_t")).first()[0] == whole["n_t"]


def test_analysis_document_is_written_quotes_its_run_and_is_believed(spark, trial, tmp_path):
    from cloakstone.operators import events
    from cloakstone.operators.scan import assert_aggregate_only
    from cloakstone.sources.tables import write_documents

    document = stats.analysis_document(stats.report_table(deid.scrub(trial)), "r")
    assert_aggregate_only(document)
    path = str(tmp_path / "analysis")
    write_documents(document, path)
    text = spark.read.text(path).first()["value"]
    payloads = spark.createDataFrame([("s", 0, text)], "session_id string, ordinal int, payload string")
    judged = {run: events.judged_payloads(payloads, F.lit(run)).first() for run in ("r", "other")}
    assert (judged["r"]["kind"], judged["r"]["reason"]) == ("analysis", None)
    assert judged["other"]["reason"] == "other run"
