from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from regatta.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def triangles(spark):
    """Two triangles 0-1-2 and 3-4-5 joined by 2-3, unit weights, both directions."""
    links = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    rows = [(a, b, 1.0) for x, y in links for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(rows, "src long, dst long, w double")


@pytest.fixture
def singletons(spark):
    return spark.createDataFrame([(i, i) for i in range(6)], "node long, community long")
