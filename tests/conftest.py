"""One local session for all tests, and the small data folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from matrixloom.session import Scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
