"""Alerts from keyed state against the batch answer, over batches and restarts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.streaming import STATE_STORE, alert_from_state, alert_once, read_alerts

SCHEMA = "cve_name STRING, ts DOUBLE, port INT"


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.set(STATE_STORE[0], before)


def given(seed):
    """Parts that come one after another; one run holds a third of all rows."""
    rng = random.Random(seed)
    for part in range(4):
        rows = [
            (
                rng.choice(["hot", "hot", "hot", *(f"run-{i}" for i in range(5 + part))]),
                float(rng.randint(-50, 5000 - 900 * part)),
                rng.choice([4444, 80, 80, None]),
            )
            for _ in range(300)
        ]
        yield rows


def test_state_alerts_equal_batch(spark, state_store, tmp_path):
    parts = list(given(5))
    parts[0] += [(None, 7.0, 4444), ("no time", None, 4444), ("nan", math.nan, 4444), ("never", 1.0, 80)]
    parts[1] += [("nan", None, 4444), ("no time", math.nan, 4444)]
    parts[2] += [(None, 3.0, 4444), ("no time", 5.0, 4444)]
    parts.append([])
    source, target = str(tmp_path / "in"), str(tmp_path / "alerts")
    condition = F.coalesce(F.col("port") == 4444, F.lit(False))
    seen, earliest = [], {}
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(source)
        # A query of its own each time: it goes on from the checkpoint.
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        alert_from_state(stream, condition, target, str(tmp_path / "state")).awaitTermination()
        alert_once(stream, condition, str(tmp_path / "table"), str(tmp_path / "once")).awaitTermination()
        seen += rows
        for run, ts, port in rows:
            if port == 4444:
                at = (2, 0) if ts is None else (1, 0) if math.isnan(ts) else (0, ts)
                earliest[run] = min(earliest.get(run, at), at)
        got = {r.cve_name: r.ts for r in read_alerts(spark, target).collect()}
        assert got.keys() == earliest.keys()
        for run, (kind, ts) in earliest.items():
            assert got[run] is None if kind == 2 else math.isnan(got[run]) if kind else got[run] == ts
        batch = {r.cve_name: r.ts for r in read_alerts(spark, str(tmp_path / "table")).collect()}
        # The table corrects no alert that has no time.
        timed = got.keys() - {"no time", "nan"}
        assert {run: got[run] for run in timed} == {run: batch[run] for run in timed}
    rows = spark.read.parquet(target).collect()
    # One first alert a run; every later row of it is earlier than those before.
    assert sorted(str(r.cve_name) for r in rows if not r.corrects) == sorted(map(str, earliest))
    assert any(r.corrects for r in rows)
    for run in earliest:
        times = [r.ts for r in sorted(rows, key=lambda r: r.batch_id) if r.cve_name == run]
        known = [t for t in times if t is not None and not math.isnan(t)]
        assert known == sorted(known, reverse=True) and len(set(known)) == len(known)


def test_state_alerts_name_the_missing_setting(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0, 4444)], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    with pytest.raises(ValueError, match="providerClass"):
        alert_from_state(stream, F.lit(True), str(tmp_path / "out"), str(tmp_path / "cp"))
