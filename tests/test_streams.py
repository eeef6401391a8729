"""The roll-up of modified times on streams: right when late rows come, and with state that expires."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quadweave.operators import lookup
from quadweave.schema import QUAD_COLS, local_table, struct
from quadweave.sources import quads as source
from quadweave.streaming import ingest


def files(spark, folder, *batches):
    for i, rows in enumerate(batches):
        table = local_table(spark, rows, struct("g STRING, at STRING")).coalesce(1)
        table.write.mode("append").json(f"{folder}/{i}")


def rolled(spark, folder, tmp_path, **how):
    """(latest time per graph over all batches, rows of state at the end of each batch)."""
    lines = spark.readStream.schema("g STRING, at STRING").option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    stamped = lines.select("g", F.col("at").cast("timestamp").alias("ts"))
    seen = []

    def keep(batch, _):
        seen.extend(map(tuple, batch.select("g", F.date_format("modified", "yyyy-MM-dd HH:mm")).collect()))

    query = ingest.modified_rollup(stamped, **how).writeStream.outputMode("update").foreachBatch(keep)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    latest = {}
    for g, at in seen:
        latest[g] = max(at, latest.get(g, at))
    return latest, state


DAYS = [[(f"g{d}", f"2024-03-{d:02d} 10:00:00"), ("hot", f"2024-03-{d:02d} 11:00:00"), ("hot", f"2024-03-{d:02d} 09:00:00")] for d in range(1, 9)]
WANT = {f"g{d}": f"2024-03-{d:02d} 10:00" for d in range(1, 9)} | {"hot": "2024-03-08 11:00"}


@pytest.mark.parametrize("how", [{}, {"late": "1 day"}])
def test_latest_times_of_a_stream(spark, tmp_path, how):
    files(spark, tmp_path / "in", *DAYS)
    latest, state = rolled(spark, tmp_path / "in", tmp_path, **how)
    assert latest == WANT
    if how:
        assert max(state) < 16 and state[-1] <= 8  # two graphs a day, of few days
    else:
        assert state[-1] == 9  # a row for every graph there ever was


LINES = ['<s> <p> "a\\u00e9\\n" <g> .', "<s> <p> _:b .", "no statement", '<s> <p> "x\\q" <g> .', '<s> <p> "plain"@EN .', "# note"]


def test_what_became_of_lines_is_kept(spark):
    """A quad, or a line with its reason: nothing is matched again when quads and rejects are read."""
    lines, held = local_table(spark, [(x,) for x in LINES], struct("value STRING")), []
    parsed = source.parse_lines(lines, keep=lambda df: held.append(df) or df)
    plain = source.parse_lines(lines)
    assert held[0].columns == ["line", "reason", *QUAD_COLS]
    assert sorted(map(repr, parsed.quads.collect())) == sorted(map(repr, plain.quads.collect()))
    assert sorted(map(tuple, parsed.rejects.collect())) == sorted(map(tuple, plain.rejects.collect()))
    assert parsed.rejects.count() == 2 and parsed.quads.count() == 3
    assert held[0].filter("(line IS NULL) = (reason IS NULL) AND (reason IS NULL) = (s IS NOT NULL)").count() == 5


def test_a_ledger_is_applied_without_another_copy(spark, quads, tmp_path, monkeypatch):
    rows = quads(*[(f"s{i}", "p", "o", "g") for i in range(5)])
    monkeypatch.setattr(lookup, "LOCAL_ROWS", 2)
    monkeypatch.setattr(lookup, "stage", lambda df: pytest.fail("copied"))
    seen = []
    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"), lambda given: seen.append(lookup.once(given).collect()), None)
    ledger.take(rows, 0)
    assert ledger.flush() == 1
    assert sorted(map(repr, seen[0])) == sorted(map(repr, rows.collect()))
