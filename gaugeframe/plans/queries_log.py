"""Queries over the serving log (streams and batch), image files and written outputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gaugeframe.operators import inventory as inv
from gaugeframe.plans.bindings import BAND, PARTS, PREDICTIONS, REQUEST_LOG, THRESHOLD, parts, predictions, request_log, thumbs, with_request_columns
from gaugeframe.plans.fixtures import write_images
from gaugeframe.plans.registry import query
from gaugeframe.sources import images as im
from gaugeframe.sources.scratch import materialize, scratch_path
from gaugeframe.streaming import monitor as mo

W = f"WITH {REQUEST_LOG}"


def stream(s, d):
    return with_request_columns(mo.read_events(s, d))


_DAY = "time_bucket(INTERVAL 1 DAY, ts)"
_J1 = f"{W} SELECT {_DAY} AS start, method, route, status, count(*) AS n FROM request_log GROUP BY ALL"


@query("j1_request_counters", _J1)
def _(s, d):
    return mo.run(mo.request_counts(stream(s, d)), "update", "requests", ["start", "method", "route", "status"])


@query("j1_request_counters_batch", _J1)
def _(s, d):
    return mo.request_counts(request_log(s, d))


@query("j1_closed_windows", f"{W}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM request_log), c AS ({_J1[len(W):]}) SELECT c.* FROM c, m WHERE start + INTERVAL 1 DAY <= w")
def _(s, d):
    """Append mode: the windows that the watermark has closed."""
    return mo.run(mo.request_counts(stream(s, d)), "append", "closed")


@query("j2_prediction_counters", f"{W} SELECT model_version, predicted, needs_review, count(*) AS n FROM request_log GROUP BY ALL")
def _(s, d):
    return mo.run(mo.prediction_counts(stream(s, d)), "complete", "predictions")


def _bounds(value, bounds):
    return ", ".join(f"count(*) FILTER ({value} <= {b}e0) AS le_{i}" for i, b in enumerate(bounds))


@query("j3_latency_histogram", f"{W} SELECT route, {_bounds('seconds', mo.LATENCY_BOUNDS)}, count(*) AS count, sum(seconds::DECIMAL(18,4))::DOUBLE AS sum FROM request_log GROUP BY route")
def _(s, d):
    return mo.run(mo.histogram(stream(s, d), "seconds", mo.LATENCY_BOUNDS, "route"), "complete", "latency")


@query("j3_inference_histogram", f"{W} SELECT {_bounds('seconds', mo.INFERENCE_BOUNDS)}, count(*) AS count, sum(seconds::DECIMAL(18,4))::DOUBLE AS sum FROM request_log WHERE status = 200 AND route <> '/v1/model'")
def _(s, d):
    """Time of the requests that reached the scorer."""
    served = stream(s, d).where("status = 200 and route != '/v1/model'")
    return mo.run(mo.histogram(served, "seconds", mo.INFERENCE_BOUNDS), "complete", "inference")


@query("j3_score_histogram", f"{W} SELECT model_version, {_bounds('p', mo.SCORE_BOUNDS)}, count(*) AS count, sum(p::DECIMAL(18,4))::DOUBLE AS sum FROM request_log GROUP BY model_version")
def _(s, d):
    return mo.run(mo.histogram(stream(s, d), "p", mo.SCORE_BOUNDS, "model_version"), "complete", "scores")


@query("j4_drift_alarm", f"{W} SELECT {_DAY} AS start, count(*) AS n, round(count(*) FILTER (needs_review) / count(*)::DOUBLE, 6) AS review_share, count(*) FILTER (needs_review) / count(*)::DOUBLE > 0.4e0 * 1.2e0 AS alarm FROM request_log GROUP BY 1")
def _(s, d):
    return mo.run(mo.drift_alarm(stream(s, d), 0.4, 1.2), "update", "drift", ["start"])


@query(
    "j4_drift_alarm_sliding",
    f"""{W}, e AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM request_log)
    SELECT start, count(*) AS n, round(count(*) FILTER (needs_review) / count(*)::DOUBLE, 6) AS review_share, count(*) FILTER (needs_review) / count(*)::DOUBLE > 0.4e0 * 1.2e0 AS alarm FROM e GROUP BY 1""",
)
def _(s, d):
    return mo.run(mo.drift_alarm(stream(s, d), 0.4, 1.2, "12 hours"), "update", "drift-sliding", ["start"])


_BINS = 20
_SHARES = "list_transform(range(0, 20), lambda k: (len(list_filter({b}, lambda x: x = k)) + 0.5e0) / (len({b}) + 10e0))"
_CURVE = "list_transform(range(0, 20), lambda k: len(list_filter({b}, lambda x: x <= k)) / len({b})::DOUBLE)"


@query("j4_score_shift", f"""{W}, r AS (SELECT {_DAY} AS start, least(floor(p * 20), 19)::INTEGER AS b, model_version FROM request_log), base AS (SELECT list(b) AS bb FROM r WHERE model_version = 'v1'),
  g AS (SELECT start, list(b) AS own FROM r WHERE model_version = 'v2' GROUP BY start),
  s AS (SELECT start, len(own) AS n, list_zip({_SHARES.format(b='own')}, {_SHARES.format(b='bb')}) AS z, list_zip({_CURVE.format(b='own')}, {_CURVE.format(b='bb')}) AS c FROM g, base),
  t AS (SELECT start, n, list_sum(list_transform(z, lambda x: (x[1] - x[2]) * ln(x[1] / x[2]))) AS psi, list_max(list_transform(c, lambda x: abs(x[1] - x[2]))) AS distance FROM s)
  SELECT start, n, round(psi, 6) AS psi, round(distance, 6) AS distance, psi > 0.2e0 AS alarm FROM t""")
def _(s, d):
    """The new model's scores of each day against all scores of the old one."""
    base = materialize(mo.score_baseline(request_log(s, d).where("model_version = 'v1'"), _BINS), "baseline")
    return mo.run(mo.score_shift(stream(s, d).where("model_version = 'v2'"), base, "1 day", bins=_BINS), "update", "shift", ["start"])


@query("j5_burst_flags", f"{W} SELECT request_id, count(*) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) > 3 AS burst FROM request_log")
def _(s, d):
    return mo.burst_flags(request_log(s, d), 86_400, 3)


@query("j5_rate_limit")
def _(s, d):
    return mo.rate_limit(stream(s, d), 86_400, 3, "limited")


@query("j5_rate_limit_batch")
def _(s, d):
    return mo.rate_limit_batch(request_log(s, d), 86_400, 3)


@query("j6_failed_auth_bursts", f"{W} SELECT request_id, count(*) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 604800 SECOND PRECEDING AND CURRENT ROW) > 1 AS burst FROM request_log WHERE status = 401")
def _(s, d):
    return mo.burst_flags(request_log(s, d).where("status = 401"), 604_800, 1)


@query("j6_failed_auth_throttle")
def _(s, d):
    return mo.rate_limit(stream(s, d).where("status = 401"), 604_800, 1, "throttled")


_ERRORS = "errors(error, status) AS (VALUES " + ", ".join(f"('{e}', {c})" for e, c in inv.ERROR_STATUS.items()) + ")"


def errors(s):
    return s.createDataFrame(list(inv.ERROR_STATUS.items()), "error string, status int")


@query("j7_error_counters", f"{W}, {_ERRORS} SELECT error, count(*) AS n FROM request_log JOIN errors USING (status) GROUP BY error")
def _(s, d):
    return mo.run(mo.error_counts(stream(s, d), errors(s)), "complete", "errors")


@query("j9_model_info", f"{W}, models(model_version, threshold) AS (VALUES ('v1', 0.6e0), ('v2', 0.55e0)) SELECT model_version, threshold, count(*) AS n FROM request_log JOIN models USING (model_version) GROUP BY ALL")
def _(s, d):
    models = s.createDataFrame([("v1", 0.6), ("v2", 0.55)], "model_version string, threshold double")
    return mo.run(mo.with_model_info(stream(s, d), models), "complete", "models")


@query("b10_error_status", f"{W}, {_ERRORS} SELECT request_id, error, status FROM request_log JOIN errors USING (status)")
def _(s, d):
    return request_log(s, d).join(F.broadcast(errors(s)), "status").select("request_id", "error", "status")


@query("b11_safe_request_id", f"""{W}, r AS (SELECT request_id, CASE WHEN request_id % 5 = 0 THEN 'bad id ' || request_id ELSE 'req-' || request_id END AS given FROM request_log)
  SELECT request_id, CASE WHEN regexp_matches(given, '^[A-Za-z0-9._-]{{1,64}}$') THEN given ELSE 'gen-' || substr(md5(given), 1, 16) END AS safe FROM r""")
def _(s, d):
    given = F.when(F.col("request_id") % 5 == 0, F.concat(F.lit("bad id "), F.col("request_id").cast("string"))).otherwise(F.concat(F.lit("req-"), F.col("request_id").cast("string")))
    return request_log(s, d).select("request_id", inv.safe_request_id(given).alias("safe"))


@query("b12_caller_fingerprint", f"{W} SELECT request_id, CASE WHEN caller % 3 <> 0 THEN 'key:' || substr(sha256('key' || caller), 1, 12) ELSE 'ip:10.0.0.' || caller END AS caller FROM request_log")
def _(s, d):
    key = F.when(F.col("caller") % 3 != 0, F.concat(F.lit("key"), F.col("caller").cast("string")))
    return request_log(s, d).select("request_id", inv.caller_fingerprint(key, F.concat(F.lit("10.0.0."), F.col("caller").cast("string"))).alias("caller"))


_PROBLEMS = [
    ("schema_version <> 1", "unknown schema version"), ("NOT (threshold > 0 AND threshold < 1)", "threshold outside (0, 1)"), ("threshold < low OR threshold > high", "threshold outside the review band"),
    ("temperature <= 0", "temperature not positive"), ("class_names <> ['normal', 'defective']", "unexpected class names"), ("positive_class <> 'defective'", "unexpected positive class"),
    ("NOT exported", "no exported model"), ("exported AND opset < 13", "opset below 13"), ("exported AND output_name IS NULL", "input or output without a name"),
]


@query("b14_registry_problems", f"""{W}, reg AS (SELECT route || '@' || model_version AS model_version, avg(p) AS threshold, 0.35e0 AS low, 0.49e0 AS high, count(*) % 2 AS temperature,
    CASE WHEN route = '/v1/model' THEN 'normal' ELSE 'defective' END AS positive_class, CASE WHEN count(*) % 3 = 0 THEN ['ok', 'defective'] ELSE ['normal', 'defective'] END AS class_names,
    1 + (count(*) % 5 = 0)::INTEGER AS schema_version, count(*) % 4 <> 1 AS exported, 11 + count(*) % 4 AS opset, CASE WHEN count(*) % 7 <> 0 THEN 'logits' END AS output_name FROM request_log GROUP BY route, request_log.model_version)
  SELECT model_version, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _PROBLEMS)}], lambda x: x IS NOT NULL)) AS problem FROM reg""")
def _(s, d):
    g = request_log(s, d).groupBy("route", "model_version").agg(F.avg("p").alias("threshold"), F.count("*").alias("n"))
    n = F.col("n")
    names = F.when(n % 3 == 0, F.array(F.lit("ok"), F.lit("defective"))).otherwise(F.array(F.lit("normal"), F.lit("defective")))
    onnx = F.struct((11 + n % 4).alias("opset"), F.lit("input").alias("input_name"), F.when(n % 7 != 0, "logits").alias("output_name"))
    reg = g.select(
        F.concat("route", F.lit("@"), "model_version").alias("model_version"), "threshold", F.lit(0.35).alias("low"), F.lit(0.49).alias("high"), (n % 2).alias("temperature"), names.alias("class_names"),
        F.when(F.col("route") == "/v1/model", "normal").otherwise("defective").alias("positive_class"), (1 + (n % 5 == 0).cast("int")).alias("schema_version"), F.when(n % 4 != 1, onnx).alias("onnx"),
    )
    return inv.registry_problems(reg)


@query("d31_latency_percentiles", f"{W} SELECT route, round(quantile_cont(seconds, 0.5e0), 9) AS p50, round(quantile_cont(seconds, 0.95e0), 9) AS p95, round(quantile_cont(seconds, 0.99e0), 9) AS p99, round(avg(seconds), 9) AS mean, round(1 / quantile_cont(seconds, 0.5e0), 9) AS throughput FROM request_log GROUP BY route")
def _(s, d):
    out = mo.latency_percentiles(request_log(s, d), "route")
    return out.withColumns({c: F.round(c, 9) for c in ("p50", "p95", "p99", "mean", "throughput")})


@query("h10_json", "SELECT event_id, (props->>'$.k')::INTEGER AS k, '{\"id\":' || event_id || ',\"k\":' || (props->>'$.k') || '}' AS line FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int").alias("props"))
    return e.select("event_id", "props.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("props.k").alias("k"))).alias("line"))


@query("h12_run_stamp", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def image_folder(s, d) -> str:
    """Thumbnails of the embeddings table as PNG files in the shared folder."""
    folder = scratch_path(s, "pngs")
    write_images(thumbs(s, d), folder)
    return folder


@query("a1_scan_files")
def _(s, d):
    return im.scan_files(s, image_folder(s, d))


@query("a5_decode_check")
def _(s, d):
    return im.decode_files(s, image_folder(s, d)).drop("sha256")


@query("a15_thumbnails")
def _(s, d):
    return im.thumbnails(s, image_folder(s, d), 4, 8)


@query("a16_model_input")
def _(s, d):
    return im.model_input(s, image_folder(s, d), 8)


_CHANNELS = ", ".join(f"list_transform(embedding, lambda v: (v::DOUBLE - {a}e0) / {b}e0)" for a, b in zip(im.MEAN, im.STD, strict=True))


@query("a16_normalise", f"SELECT vec_id, len(t) AS n, round(list_sum(t), 4) AS total, round(list_sum(list_transform(t, lambda x: x * x)), 3) AS square FROM (SELECT vec_id, flatten([{_CHANNELS}]) AS t FROM embeddings)")
def _(s, d):
    """The normalised planes (one for each channel's statistics) of every vector, whole."""
    planes = F.flatten(F.array(*(im.normalised(F.col("embedding").cast("array<double>"), c) for c in range(3))))
    t = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", planes.alias("t"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return t.select("vec_id", F.size("t").alias("n"), F.round(total(F.col("t")), 4).alias("total"), F.round(total(F.transform("t", lambda x: x * x)), 3).alias("square"))


@query("b16_augmentation")
def _(s, d):
    return im.augment(s, image_folder(s, d), 8, 2, 42)


def arriving(s, d):
    """The image folder as a stream of files, a request of several files for each class folder, and the folder."""
    folder = image_folder(s, d)
    return folder, im.stream_files(s, folder).select(im.rel_path(folder), "content")


@query("j8_arriving_files")
def _(s, d):
    """Files as they arrive: judged by their headers, decoded and scored by a linear scorer of the model's input, each written once;
    a request (files of neighbouring numbers) counts only if all its files are sound and within the limits of an upload."""
    _, files = arriving(s, d)
    weights = np.array([round(((7 * i) % 13 - 6) / 10, 1) for i in range(192)])
    request = F.floor(F.regexp_extract("rel_path", r"(\d+)\.\w+$", 1).cast("long") / 12)
    judged = mo.judge_stream(files.withColumn("request", request), lambda rows: im.judge_files(rows, lambda x: x.reshape(len(x), -1) @ weights / 100, side=8), "arrived")
    return mo.accept_whole(judged, "request", THRESHOLD, *BAND)


@query("j8_batch_rule", f"WITH {PARTS} SELECT h % 97 AS batch, count(*) AS files, bool_and(error IS NULL) AS accepted FROM parts GROUP BY 1")
def _(s, d):
    return parts(s, d).groupBy((F.col("h") % 97).alias("batch")).agg(F.count("*").alias("files"), F.bool_and(F.col("error").isNull()).alias("accepted"))


@query("a11_table_sink", f"WITH {PARTS} SELECT rel_path, source_split, label, CASE WHEN h % 2 = 0 THEN '' ELSE 'kept' END AS exclude_reason FROM parts")
def _(s, d):
    rows = parts(s, d).select("rel_path", "source_split", "label", F.when(F.col("h") % 2 == 0, "").otherwise("kept").alias("exclude_reason"))
    return im.write_table(rows, scratch_path(s, "table"), ["source_split"])


@query("a12_report_sink", f"WITH {PARTS} SELECT source_split, count(*) AS n, substr(sha256('{{\"k\": 3}}'), 1, 12) AS config_hash, true AS stamped FROM parts GROUP BY source_split")
def _(s, d):
    """A report with its provenance: the code's commit, the hash of the configuration and the time of writing."""
    rows = parts(s, d).groupBy("source_split").agg(F.count("*").alias("n"))
    written = im.write_report(rows, scratch_path(s, "report"), {"k": 3})
    recent = F.abs(F.unix_timestamp("created_at") - F.unix_timestamp(F.current_timestamp())) < 3600
    return written.select("source_split", "n", "config_hash", (recent & F.col("commit").isNotNull()).alias("stamped"))


@query("a18_prediction_export", f"WITH {PREDICTIONS} SELECT id, split, label, p, predicted, needs_review FROM predictions")
def _(s, d):
    rows = predictions(s, d).select("id", "split", "label", "p", "predicted", "needs_review", F.lit("bytes").alias("image"))
    return im.write_csv(rows, scratch_path(s, "export"), ["image"])
