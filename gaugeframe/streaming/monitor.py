"""Monitoring of a serving log as streams (J1-J9); every aggregate also runs on a batch table.

The aggregates are plain DataFrame functions, so a stream and its batch twin
share them.  ``run`` drives a stream over all data that is there and returns the
written result: append keeps each closed window once, update the last row of each
window, complete rewrites the (bounded) result with every batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.functions.scores import decide, sigmoid
from gaugeframe.operators.ranking import exact_quantiles
from gaugeframe.sources.images import many_small_files
from gaugeframe.sources.scratch import drop_written, materialize_observed, scratch_path

LATE, LATE_SECONDS = "1 hour", 3600
# Bounds of the service's histograms.
LATENCY_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
INFERENCE_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
SCORE_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def read_events(spark: SparkSession, sf_dir: str, max_files: int = 1000) -> DataFrame:
    """The events table as a file stream of at most ``max_files`` files a micro-batch; the pattern lets the table be one file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/events.parque[t]")


def run(df: DataFrame, mode: str, name: str, keys: list[str] | None = None, *, out: str | None = None, state: str | None = None) -> DataFrame:
    """Process all data that is there and return what the stream has written.

    ``append`` keeps each closed window once.  ``update`` writes the changed rows of each batch to a folder of that batch's number, which a
    repeated batch replaces, and returns the last row of each of the ``keys``: the watermark frees the state of closed windows.  ``complete``
    rewrites the (bounded) result with every batch.  ``out`` and ``state`` name the folders of a stream that goes on later.
    """
    spark = df.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "update":
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    written = spark.read.schema(df.schema if mode != "update" else f"{_ddl(df)}, batch long").parquet(out)
    return latest(written, keys or []) if mode == "update" else written


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each of the keys, of rows with a column ``batch``."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*keys, "_row.*").select(*(c for c in written.columns if c != "batch"))


def windowed(log: DataFrame, length: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Group by time window and keys, with the watermark on a stream."""
    rows = log.withWatermark("ts", LATE) if log.isStreaming else log
    return rows.groupBy(F.window("ts", length, slide), *keys)


def request_counts(log: DataFrame) -> DataFrame:
    g = windowed(log, "1 day", "method", "route", "status").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "method", "route", "status", "n")


def prediction_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("model_version", "predicted", "needs_review").agg(F.count("*").alias("n"))


def histogram(log: DataFrame, value: str, bounds: tuple[float, ...], *keys: str) -> DataFrame:
    """Cumulative counts at each bound, with count and sum, for each group of ``keys``."""
    at = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return log.groupBy(*keys).agg(*at, F.count("*").alias("count"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("sum"))


def drift_alarm(log: DataFrame, baseline: float, factor: float, slide: str | None = None) -> DataFrame:
    """Review share of each window, and whether it exceeds the baseline by the factor."""
    g = windowed(log, "1 day", slide=slide).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("reviews"))
    share = F.col("reviews") / F.col("n")
    return g.select(F.col("window.start").alias("start"), "n", F.round(share, 6).alias("review_share"), (share > baseline * factor).alias("alarm"))


def score_bins(log: DataFrame, bins: int) -> list[Column]:
    """Counts of the score p in equal-width bins over 0 to 1 (the last one closed): a sketch of the scores that merges by addition."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return [F.count_if(at == k).alias(f"b{k}") for k in range(bins)]


def score_baseline(log: DataFrame, bins: int = 20) -> DataFrame:
    """One row: the counts of a reference period, to hold later windows against."""
    return log.agg(*score_bins(log, bins))


def score_shift(log: DataFrame, baseline: DataFrame, length: str, *, bins: int = 20, most: float = 0.2, slide: str | None = None, least_rows: int = 1) -> DataFrame:
    """start, n, psi, distance and alarm of each window: how far its scores lie from the baseline's.

    psi is the sum of (q - b) ln(q / b) over the bins' shares (half a row is added to every bin, so none is empty), distance the largest
    difference of the two distribution curves at a bin's end.  The alarm needs ``least_rows`` rows and a psi above ``most``.
    """
    g = windowed(log, length, slide=slide).agg(F.count("p").alias("n"), *score_bins(log, bins))
    base = baseline.select(F.array(*(F.col(f"b{k}") for k in range(bins))).alias("_base"))
    rows = g.crossJoin(F.broadcast(base)).withColumn("_own", F.array(*(F.col(f"b{k}") for k in range(bins))))  # the baseline is one row
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda c: F.transform(c, lambda x: (x + 0.5) / (total(F.col(c)) + 0.5 * bins))
    psi = F.aggregate(F.zip_with(share("_own"), share("_base"), lambda q, b: (q - b) * F.ln(q / b)), F.lit(0.0), lambda s, x: s + x)
    step = F.zip_with("_own", "_base", lambda x, y: x / total(F.col("_own")) - y / total(F.col("_base")))
    curve = F.aggregate(step, F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("most")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["most"], F.abs(s["at"] + x)).alias("most")))
    rows = rows.withColumns({"psi": psi, "distance": curve["most"]})
    alarm = (F.col("n") >= least_rows) & (F.col("psi") > most)
    return rows.select(F.col("window.start").alias("start"), "n", F.round("psi", 6).alias("psi"), F.round("distance", 6).alias("distance"), alarm.alias("alarm"))


def error_counts(log: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of each error code of the dimension table (error, status)."""
    return log.join(errors, "status").groupBy("error").agg(F.count("*").alias("n"))


def with_model_info(log: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions of each model with its data from the static model table (model_version, threshold)."""
    return log.join(models, "model_version").groupBy("model_version", "threshold").agg(F.count("*").alias("n"))


def burst_flags(log: DataFrame, seconds: int, limit: int) -> DataFrame:
    """request_id and burst: more than ``limit`` requests of its caller in the ``seconds`` up to it (batch)."""
    span = Window.partitionBy("caller").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return log.select("request_id", (F.count("*").over(span) > limit).alias("burst"))


def _limited(ids: np.ndarray, times: np.ndarray, accepted: list[float], seconds: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """allowed and retry_after of requests in order; ``accepted`` (times, oldest first) is brought up to date."""
    ok, retry = np.zeros(len(ids), bool), np.zeros(len(ids))
    for k, now in enumerate(times.tolist()):
        while accepted and accepted[0] <= now - seconds:
            accepted.pop(0)
        ok[k] = len(accepted) < limit
        if ok[k]:
            accepted.append(now)
        else:
            retry[k] = max(1, math.ceil(accepted[0] + seconds - now))
    return ok, retry


def _rate_limited(rows: DataFrame, seconds: int, limit: int, accepted: DataFrame | None = None) -> DataFrame:
    """kind, request_id, caller, t, allowed, retry_after: a row of kind 1 for each request, and of kind 2 for each accepted time that still counts.

    Spark sorts each caller's requests outside memory, behind the times that were ``accepted`` before (caller, t); a task streams them with a
    caller's accepted times, at most ``limit``, as its only state.
    """
    asked = rows.where("caller is not null").select(F.lit(1).alias("kind"), F.col("request_id").cast("long").alias("request_id"), F.col("caller").cast("long").alias("caller"), F.unix_micros("ts").alias("t"))
    if accepted is not None:
        asked = asked.unionByName(accepted.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("request_id"), "caller", "t"))
    asked = asked.repartition("caller").sortWithinPartitions("caller", "kind", "t", "request_id")
    names = ["kind", "request_id", "caller", "t", "allowed", "retry_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller, held = None, []

        def left():
            """The times of the caller that was streamed last."""
            n = len(held)
            columns = [np.full(n, 2, np.int32), None, np.full(n, caller or 0), np.round(np.array(held, float) * 1e6).astype(np.int64), None, None]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, callers, t = (batch.column(c).to_numpy() for c in ("kind", "caller", "t"))
            ids = batch.column("request_id").fill_null(0).to_numpy()
            ok, retry = np.zeros(len(ids), bool), np.zeros(len(ids))
            cut = np.flatnonzero((callers[1:] != callers[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                if callers[a] != caller:
                    if held:
                        yield left()
                    caller, held = int(callers[a]), []
                if kind[a] == 0:
                    held.extend((t[a:b] / 1e6).tolist())
                else:
                    ok[a:b], retry[a:b] = _limited(ids[a:b], t[a:b] / 1e6, held, seconds, limit)
            own = kind == 1
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (kind, ids, callers, t, ok, retry)], names)
        if held:
            yield left()

    return asked.mapInArrow(run, "kind int, request_id long, caller long, t long, allowed boolean, retry_after double")


DECIDED = ["request_id", "caller", "allowed", "retry_after"]


def rate_limit(log: DataFrame, seconds: int, limit: int, name: str, *, out: str | None = None, state: str | None = None) -> DataFrame:
    """request_id, caller, allowed and retry_after (whole seconds, at least 1; 0 for allowed ones) by a moving window over each caller's accepted requests.

    A rejected request is not recorded.  Each micro-batch is sorted and streamed (``_rate_limited``), so no caller's requests are held; the
    accepted times that still count go from batch to batch as a table.  Decisions and times are written to folders of the batch's number, so a
    batch that is repeated finds the times of the one before it and replaces its own.  Times older than the window before the watermark
    (an hour behind the latest request) go, so the table grows with active callers only.  ``out`` and ``state`` name the folders of a
    stream that goes on later.
    """
    spark = log.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    times = "caller long, t long"

    def batch(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(times).parquet(f"{state}/times/batch={number - 1}") if number else None
        decided, seen = materialize_observed(_rate_limited(rows, seconds, limit, before), "decided", F.max("t").alias("t"))
        decided.where("kind = 1").select(*DECIDED).write.mode("overwrite").parquet(f"{out}/batch={number}")
        still = decided.where("kind = 2").select("caller", "t")
        if before is not None:  # callers without a request in this batch
            still = still.unionByName(before.join(decided.where("kind = 1").select("caller").distinct().hint("merge"), "caller", "left_anti"))
        if seen["t"] is not None:
            still = still.where(F.col("t") > seen["t"] - (seconds + LATE_SECONDS) * 1_000_000)
        still.write.mode("overwrite").parquet(f"{state}/times/batch={number}")
        drop_written(decided)

    log.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("request_id long, caller long, allowed boolean, retry_after double, batch long").parquet(out).drop("batch")


def rate_limit_batch(log: DataFrame, seconds: int, limit: int) -> DataFrame:
    """As ``rate_limit`` on a batch table."""
    return _rate_limited(log, seconds, limit).where("kind = 1").select(*DECIDED)


def judge_stream(files: DataFrame, judge: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that ``judge`` makes of the files as they arrive, written once each: a batch has a folder of its own, which a repeated batch replaces.

    While the stream runs, Spark lists and reads many small files in a task (``many_small_files``); a batch's rows are put together in few files.
    """
    spark, out = files.sparkSession, scratch_path(files.sparkSession, name)
    sink = lambda rows, number: judge(rows).hint("rebalance").write.mode("overwrite").parquet(f"{out}/batch={number}")
    with many_small_files(spark):
        files.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def accept_whole(judged: DataFrame, request: str, threshold: float, low: float, high: float, *, max_files: int = 16, max_bytes: int = 32 << 20) -> DataFrame:
    """Judged files (rel_path, size_bytes, verdict, status, z) with index, p, accepted, decision, confidence and needs_review.

    A request's files count only if all of them are sound, they are no more than ``max_files`` and hold no more than ``max_bytes``; refusal
    names why a request was refused (its limits come before its files).  The index is a file's place in its request, by path.
    """
    broken = F.min(F.when(F.col("verdict") != "ok", F.struct("rel_path", "verdict")))["verdict"]
    whole = judged.groupBy(request).agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_bytes"), broken.alias("_broken"))
    refusal = F.when(F.col("_bytes") > max_bytes, "payload_too_large").when(F.col("_n") > max_files, "too_many_files").otherwise(F.col("_broken"))
    rows = judged.join(whole.select(request, refusal.alias("refusal")).hint("merge"), request)
    index = F.row_number().over(Window.partitionBy(request).orderBy("rel_path")) - 1
    rows = rows.withColumns({"index": index, "accepted": F.col("refusal").isNull(), "p": F.when(F.col("refusal").isNull(), sigmoid(F.col("z")))})
    rows = decide(rows, threshold, low, high).withColumn("decision", F.when(F.col("accepted"), F.when(F.col("predicted") == 1, "defective").otherwise("normal")))
    return rows.select("rel_path", request, "index", "verdict", "status", "p", "accepted", "refusal", "decision", "confidence", "needs_review")


def latency_percentiles(log: DataFrame, key: str) -> DataFrame:
    """Exact p50, p95, p99 and mean of seconds for each value of ``key``, and requests a second at the median."""
    cuts = exact_quantiles(log, "seconds", [0.5, 0.95, 0.99], [key])
    g = log.groupBy(key).agg(F.avg("seconds").alias("mean")).join(cuts.hint("merge"), key)
    g = g.select(key, *(F.col("quantiles")[i].alias(p) for i, p in enumerate(("p50", "p95", "p99"))), "mean")
    return g.withColumn("throughput", F.when(F.col("p50") > 0, 1 / F.col("p50")))
