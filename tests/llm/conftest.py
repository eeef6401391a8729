from __future__ import annotations

import pytest
from pyspark.sql import types as T

from quadweave.schema import local_table
from samples import ODD

#: Names that operators use for columns of their own.
CLASHING = ["size", "fp", "key", "f0", "kept", "score", "row", "own", "first", "found", "group", "shard", "chunk", "level", "copies", "host", "verdict"]


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text[, source]), with extra columns of clashing names."""

    schema = T.StructType.fromDDL("doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))

    def make(*rows):
        filled = [(r[0], r[1], r[2] if len(r) > 2 else "s", *["x"] * len(CLASHING)) for r in rows]
        return local_table(spark, filled, schema)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(*ODD)


@pytest.fixture(scope="session")
def empty(docs):
    return docs()
