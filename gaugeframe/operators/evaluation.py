"""The one evaluation of a run on its test sets and the release of a model version."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.scores import decide
from gaugeframe.operators import metrics as m
from gaugeframe.operators.inventory import set_fingerprint
from gaugeframe.operators.splits import keys_in_two_splits
from gaugeframe.sources.scratch import materialize


def latest_run(runs: DataFrame) -> DataFrame:
    """run and created_at of the run created last (of equal times the larger name)."""
    return runs.agg(F.max(F.struct("created_at", "run")).alias("s")).select("s.run", "s.created_at")


def audit_of(rows: DataFrame, *, passed: bool, id_col: str = "id", split: str = "split") -> DataFrame:
    """What an audit stores of its test sets: split, n, fingerprint (of the hashed ids) and passed."""
    hashed = rows.select(split, F.sha2(F.col(id_col).cast("string"), 256).alias("sha256"))
    return set_fingerprint(hashed, split).withColumn("passed", F.lit(passed))


def store_audit(rows: DataFrame, folder: str, *, id_col: str = "id") -> DataFrame:
    """Audit scored rows of all splits, write what ``audit_of`` says of each split, and read it back.

    It passes if no id is in two splits and every split has both classes.
    """
    spark = rows.sparkSession
    twice = keys_in_two_splits(rows, id_col).count()
    single = rows.groupBy("split").agg(F.count_distinct("label").alias("n")).where("n < 2").count()
    audit = audit_of(rows, passed=twice == 0 and single == 0, id_col=id_col)
    audit.write.mode("errorifexists").parquet(f"{folder}/audit")
    return spark.read.schema(audit.schema).parquet(f"{folder}/audit")


def _exclusive(spark: SparkSession, path: str, body: dict) -> bool:
    """Create a file that must not exist yet; False if it does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    except Py4JJavaError as e:
        if "exist" in str(e.java_exception).lower():
            return False
        raise
    out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
    out.close()
    return True


def _read_json(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    text = "".join(r["value"] for r in spark.read.text(path).collect())  # a file of one line
    return json.loads(text) if text else {}


def _long(df: DataFrame, split: str, part: str, key: str | None = None) -> DataFrame:
    """A wide row of numbers as rows split, part, key, metric, value (low and high of intervals are null)."""
    names = [c for c in df.columns if c != key]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    null = F.lit(None).cast("double")
    at = F.lit("") if key is None else F.col(key).cast("string")
    return df.select(F.lit(split).alias("split"), F.lit(part).alias("part"), at.alias("key"), each.alias("m")).select("split", "part", "key", "m.metric", "m.value", null.alias("low"), null.alias("high"))


def evaluation_parts(rows: DataFrame, split: str, threshold: float, low: float, high: float, *, resamples: int, edges: list[float], seed: int = 0) -> list[DataFrame]:
    """All results of one test set as long rows: size, metrics at the point with their intervals and at 0.5, confusion, review band, and,
    where the columns are there, the buckets of similarity to train and the brightness probe."""
    rows = rows.withColumn("correct", (F.col("p") >= threshold).cast("int") == F.col("label"))
    intervals = m.bootstrap(rows, threshold, resamples, seed=seed)
    parts = [
        _long(rows.agg(F.count("*").alias("n"), F.sum("label").alias("n_defective")), split, "size"),
        intervals.select(F.lit(split).alias("split"), F.lit("at_operating_threshold").alias("part"), F.lit("").alias("key"), "metric", F.col("point").alias("value"), "low", "high"),
        _long(m.classification_metrics(rows, 0.5).crossJoin(F.broadcast(m.ranking_metrics(rows))), split, "at_0.5_reference"),
        _long(m.confusion(rows, threshold), split, "confusion"),
        _long(m.band_summary(rows, threshold, low, high), split, "review_band"),
    ]
    if "similarity" in rows.columns:
        parts.append(_long(m.bucket_metrics(rows.where("similarity is not null"), edges).drop("hi"), split, "by_similarity_to_train", "lo"))
    if "brightness" in rows.columns:
        parts.append(_long(m.quartile_errors(rows), split, "brightness_quartiles", "quartile"))
        parts.append(_long(m.spearman_by(rows, "p", "brightness", "label"), split, "brightness_spearman", "label"))
    return parts


def evaluate_once(
    rows: DataFrame, audit: DataFrame, run_folder: str, threshold: float, low: float, high: float, id_col: str = "id", *, resamples: int = 1000,
    edges: tuple[float, ...] = (0.0, 0.95, 0.97, 0.98, 0.99), resume: bool = False,
) -> DataFrame:
    """split, n, reviewed and the metrics of each test set; everything else is written below ``run_folder`` too.

    Refused (ValueError) if the stored ``audit`` didn't pass, or if the rows of a split are not those that it stored (their fingerprint is
    computed anew).  A run is claimed by the exclusive creation of a file *before* anything is evaluated, so of two runs at a time one
    is refused.  A finished run is never evaluated again; one that was claimed and broke off can be taken up with ``resume``, on the same rows
    and the same point only.  Written are ``test_metrics`` (the result), ``test_results`` (long rows, see ``evaluation_parts``) and
    ``test_predictions``; the marker with the fingerprints comes last.
    """
    spark = rows.sparkSession
    now = audit_of(rows, passed=True, id_col=id_col).select("split", F.col("fingerprint").alias("now"))
    seen = audit.hint("merge").join(now.hint("merge"), "split", "full_outer").select("split", "passed", "fingerprint", "now").collect()  # a row for each split
    if not seen or not all(r["passed"] for r in seen if r["passed"] is not None) or all(r["passed"] is None for r in seen):
        raise ValueError("the leakage audit did not pass; the test sets are not evaluated")
    if any(r["fingerprint"] != r["now"] for r in seen):
        raise ValueError("the test rows differ from the audited ones")
    marker, claimed = f"{run_folder}/TEST_EVALUATED", f"{run_folder}/TEST_CLAIMED"
    claim = {"threshold": threshold, "low": low, "high": high, "fingerprints": {r["split"]: r["now"] for r in seen}}
    if _read_json(spark, marker) is not None:
        raise ValueError("this run was already evaluated on its test sets, which are used once")
    if not _exclusive(spark, claimed, claim):
        if not resume:
            raise ValueError("another evaluation has claimed this run and has not ended; if it broke off, it can be resumed")
        if _read_json(spark, claimed) != claim:
            raise ValueError("this run was claimed for other rows or another operating point")
    rows = materialize(rows, "test-rows")
    parts = [p for split in sorted(claim["fingerprints"]) for p in evaluation_parts(rows.where(F.col("split") == split), split, threshold, low, high, resamples=resamples, edges=list(edges))]
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    results.write.mode("overwrite").parquet(f"{run_folder}/test_results")
    decided = decide(rows, threshold, low, high).withColumn("correct", F.col("predicted") == F.col("label"))
    decided.write.mode("overwrite").parquet(f"{run_folder}/test_predictions")
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if((F.col("p") >= low) & (F.col("p") < high)).alias("reviewed"))
    result = counts.join(m.classification_metrics(rows, threshold, ["split"]).hint("merge"), "split")
    result.write.mode("overwrite").parquet(f"{run_folder}/test_metrics")
    if not _exclusive(spark, marker, claim | {"evaluated_at": datetime.now(UTC).isoformat(timespec="seconds")}):
        raise ValueError("this run was already evaluated on its test sets, which are used once")
    return spark.read.schema(result.schema).parquet(f"{run_folder}/test_metrics")


def release(scorer: DataFrame, exported: DataFrame, metrics: DataFrame, models_folder: str, version: str, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """Write a model version's rows (the metrics of each test set, the version, the tolerance used) and read them back.

    ``scorer`` and ``exported`` (id, z) must agree within atol + rtol * abs(z), else ValueError; a version that exists is never
    written again.
    """
    spark = metrics.sparkSession
    both = m.parity(scorer, exported, atol, rtol).first()
    if not both["n"] or not both["passed"]:
        raise ValueError(f"the exported scorer differs from the trained one by {both['max_abs']}")
    rows = metrics.withColumns({"model_version": F.lit(version), "tolerance_used": F.lit(float(both["used"]))})
    rows.write.mode("errorifexists").parquet(f"{models_folder}/{version}")
    return spark.read.schema(rows.schema).parquet(f"{models_folder}/{version}")
