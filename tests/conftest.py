from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from quadweave.schema import QUADS, empty_snapshot, local_table  # noqa: E402
from quadweave.session import build_session  # noqa: E402
from support import row  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def quads(spark):
    return lambda *rows: local_table(spark, [row(*r) for r in rows], QUADS)


@pytest.fixture
def blank(spark):
    return empty_snapshot(spark)
