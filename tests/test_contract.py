from __future__ import annotations

import __spark_entry__ as contract
from conftest import SMALL

from cloakstone.plans.oracles import SQL
from cloakstone.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["n_t"] > 0 and row["difference"] < 0


def test_settings_a_session_chose_itself_are_kept(spark):
    from cloakstone.sources.session import tune

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    tune(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_audit_results_hold_no_identifier(spark, trial):
    """Scan, verification and classification outputs never repeat a cell of the table."""
    cells = {v.strip() for r in trial.select("ssn", "mrn", "subject_id", "address").limit(300).collect() for v in r}
    for name in ("classify_verdict", "verify_unscrubbed", "pattern_hits_allowed", "value_scan_anchored", "boundary_verdict", "exec_failures"):
        text = str(contract.queries()[name](spark, SMALL).collect())
        assert not any(v in text for v in cells), name


def test_scans_read_only_what_they_need(spark):
    plan = contract.queries()["pattern_hits"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and "n_chars" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scrubbing_needs_no_shuffle(spark, trial):
    from cloakstone.operators import deid
    from cloakstone.plans.trial_view import trial_view

    raw = trial_view(spark.read.parquet(f"{SMALL}/orders.parquet"))
    plan = deid.scrub(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
