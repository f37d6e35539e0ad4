"""Streams against hand-made rows."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import scratch_path
from gaugeframe.streaming import monitor as mo


def test_rate_limit(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 7, t), (2, 7, t + timedelta(seconds=10)), (3, 7, t + timedelta(seconds=20)), (4, 8, t + timedelta(seconds=20)), (5, 7, t + timedelta(seconds=61)), (6, None, t)]
    path = scratch_path(spark, "limit")
    spark.createDataFrame(rows, "request_id long, caller long, ts timestamp").write.parquet(path)
    log = spark.readStream.schema("request_id long, caller long, ts timestamp").parquet(path)
    got = {r.request_id: (r.allowed, r.retry_after) for r in mo.rate_limit(log, 60, 2, "t").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: True, 2: True, 3: False, 4: True, 5: True}
    assert got[3][1] == 40.0


def _plain_limit(rows, seconds, limit):
    """allowed and retry_after of each request, one after the other."""
    held, out = {}, {}
    for i, caller, ts in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        own = held.setdefault(caller, [])
        own[:] = [x for x in own if (ts - x).total_seconds() < seconds]
        out[i] = (len(own) < limit, 0.0 if len(own) < limit else max(1, -(-((own[0] - ts).total_seconds() + seconds) // 1)))
        if len(own) < limit:
            own.append(ts)
    return out


def test_rate_limit_over_batches_and_a_restart(spark):
    """One caller has a third of all requests; the stream stops and goes on from its checkpoint, and equals the batch twin row by row."""
    r, t = random.Random(3), datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else r.randrange(2, 12), t + timedelta(seconds=i * 7 + r.randrange(5), microseconds=r.randrange(10**6))) for i in range(600)]
    kinds = "request_id long, caller long, ts timestamp"
    path, out, state = (scratch_path(spark, n) for n in ("log", "out", "state"))
    parts = [rows[i : i + 100] for i in range(0, 600, 100)]
    log = _log(spark, parts[:3], path, kinds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert mo.rate_limit(log, 120, 4, "t", out=out, state=state).count() == 300
        for i, part in enumerate(parts[3:], 3):
            spark.createDataFrame(part, kinds).coalesce(1).write.parquet(f"{path}/{i}")
        got = {x.request_id: (x.allowed, x.retry_after) for x in mo.rate_limit(log, 120, 4, "t", out=out, state=state).collect()}
        whole = {x.request_id: (x.allowed, x.retry_after) for x in mo.rate_limit_batch(spark.read.option("recursiveFileLookup", True).parquet(path), 120, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == whole == _plain_limit(rows, 120, 4)
    assert 0 < sum(not ok for ok, _ in got.values()) < 600
    kept = spark.read.parquet(f"{state}/times")
    last = kept.where(F.col("batch") == kept.agg(F.max("batch")).first()[0])
    assert last.groupBy("caller").count().agg(F.max("count")).first()[0] <= 4


def test_histogram_is_cumulative(spark):
    log = spark.createDataFrame([(0.004,), (0.02,), (3.0,)], "seconds double").withColumn("route", F.lit("r"))
    r = mo.histogram(log, "seconds", (0.01, 0.025, 1.0), "route").first()
    assert (r.le_0, r.le_1, r.le_2, r["count"]) == (1, 2, 2, 3)


def _log(spark, rows, path, kinds="request_id long, caller long, ts timestamp, p double"):
    """One file for each list of rows, read one file a batch in the order of their names."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_update_mode_keeps_the_last_row_and_repeats_safely(spark):
    t = datetime(2024, 1, 1)
    parts = [[(10 * i + k, 1, t + timedelta(hours=6 * i), 0.5) for k in range(i + 1)] for i in range(8)]
    path, out, state = (scratch_path(spark, n) for n in ("log", "out", "state"))
    log = _log(spark, parts, path)
    counted = lambda rows: mo.windowed(rows, "1 day").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    want = {r.start: r.n for r in counted(spark.read.option("recursiveFileLookup", True).parquet(path)).collect()}
    got = mo.run(counted(log), "update", "u", ["start"], out=out, state=state)
    assert {r.start: r.n for r in got.collect()} == want and len(want) == 2
    spark.createDataFrame(parts[7], "request_id long, caller long, ts timestamp, p double").coalesce(1).write.parquet(f"{path}/8")
    again = mo.run(counted(log), "update", "u", ["start"], out=out, state=state)  # the stream goes on from its checkpoint
    late = max(want)
    assert {r.start: r.n for r in again.collect()} == want | {late: want[late] + 8}
    # a batch that is repeated replaces its own folder
    batches = spark.read.parquet(out)
    last = batches.agg(F.max("batch")).first()[0]
    spark.read.parquet(f"{out}/batch={last}").collect()
    rows = spark.createDataFrame(spark.read.parquet(f"{out}/batch={last}").collect(), "start timestamp, n long")
    rows.write.mode("overwrite").parquet(f"{out}/batch={last}")
    assert {r.start: r.n for r in mo.latest(spark.read.parquet(out), ["start"]).collect()} == want | {late: want[late] + 8}


def test_planted_score_shift_raises_the_alarm(spark):
    t = datetime(2024, 1, 1)
    draw = np.random.default_rng(4)
    base = spark.createDataFrame([(0, 0, t, float(x)) for x in draw.beta(2, 5, 4000)], "request_id long, caller long, ts timestamp, p double")
    days = [draw.beta(2, 5, 900), draw.beta(2, 5, 900), draw.beta(5, 2, 900), np.array([1.0, 0.0, None, 0.3], object)]
    rows = [[(i, 0, t + timedelta(days=d, seconds=i), None if x is None else float(x)) for i, x in enumerate(v)] for d, v in enumerate(days)]
    log = _log(spark, rows, scratch_path(spark, "shift"))
    got = {(r.start - t).days: r for r in mo.run(mo.score_shift(log, mo.score_baseline(base), "1 day", least_rows=100), "update", "s", ["start"]).collect()}
    assert [got[d].alarm for d in range(4)] == [False, False, True, False] and got[3].n == 3

    def plain(q, b):
        edges = np.linspace(0, 1, 21)
        q, b = (np.histogram(np.array(x, float), edges)[0] for x in (q, b))
        s, u = (q + 0.5) / (q.sum() + 10), (b + 0.5) / (b.sum() + 10)
        return ((s - u) * np.log(s / u)).sum(), np.abs(np.cumsum(q) / q.sum() - np.cumsum(b) / b.sum()).max()

    reference = [r.p for r in base.collect()]
    for d in range(3):
        psi, distance = plain(days[d], reference)
        assert abs(got[d].psi - psi) < 1e-5 and abs(got[d].distance - distance) < 1e-5
