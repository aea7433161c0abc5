from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmetrics.operators.profile import Profiler  # noqa: E402
from shelfmetrics.plans.workspace import Workspace  # noqa: E402
from shelfmetrics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def workspace(spark, tmp_path_factory):
    return Workspace(spark, str(tmp_path_factory.mktemp("stages")))


@pytest.fixture
def profiler(workspace):
    return Profiler(workspace)


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
