from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cloakstone.sources.session import local_session, shared_folder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Rows of text from a dict of columns."""

    def make(**columns):
        names = list(columns)
        rows = list(zip(*columns.values(), strict=True))
        return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    return make


@pytest.fixture(scope="session")
def trial(spark):
    from cloakstone.plans.trial_view import trial_view

    return trial_view(spark.read.parquet(f"{SMALL}/orders.parquet")).cache()
