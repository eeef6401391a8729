"""Every registered query next to its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, duck, name):
    ok, text = check.compare(spark, duck, name, SF)
    assert ok, text


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
