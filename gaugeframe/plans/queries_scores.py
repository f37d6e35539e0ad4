"""Queries over the scored-split, prediction and history views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeframe.functions import scores as sc
from gaugeframe.functions.arrays import bin_index
from gaugeframe.operators import metrics as m
from gaugeframe.plans.bindings import BAND, HISTORY, LOGITS, PREDICTIONS, TEMPERATURE, THRESHOLD, history, logits, predictions
from gaugeframe.operators.evaluation import evaluate_once, latest_run, release, store_audit
from gaugeframe.operators.ranking import exact_quantiles
from gaugeframe.plans.registry import query
from gaugeframe.sources.scratch import materialize, scratch_path

L, P, H = f"WITH {LOGITS}", f"WITH {PREDICTIONS}", f"WITH {HISTORY}"
T, LO, HI = f"{THRESHOLD}e0", f"{BAND[0]}e0", f"{BAND[1]}e0"
EDGES = [0.0, 0.95, 0.97, 0.98, 0.99]
_COUNTS = f"""counts AS (SELECT (count(*) FILTER (p >= {T} AND label = 1))::DOUBLE AS tp, (count(*) FILTER (p >= {T} AND label = 0))::DOUBLE AS fp,
  (count(*) FILTER (p < {T} AND label = 0))::DOUBLE AS tn, (count(*) FILTER (p < {T} AND label = 1))::DOUBLE AS fn FROM logits)"""


@query("b4_calibrated_probability", f"{L} SELECT id, margin, round(1e0 / (1e0 + exp((0e0 - margin) / 2.5e0)), 9) AS p FROM logits")
def _(s, d):
    return logits(s, d).select("id", "margin", F.round(sc.calibrated_probability(F.lit(0.0), F.col("margin"), 2.5), 9).alias("p"))


@query("b5_decide", f"{P} SELECT id, margin, predicted, round(confidence, 9) AS confidence, needs_review FROM predictions")
def _(s, d):
    return predictions(s, d).select("id", "margin", "predicted", F.round("confidence", 9).alias("confidence"), "needs_review")


@query("b6_prediction_rows", f"{P} SELECT id, split, label, p, predicted, correct, needs_review, round(similarity, 6) AS similarity, round(brightness, 4) AS brightness FROM predictions")
def _(s, d):
    return predictions(s, d).select("id", "split", "label", "p", "predicted", "correct", "needs_review", F.round("similarity", 6).alias("similarity"), F.round("brightness", 4).alias("brightness"))


@query("b7_error_table", f"{P} SELECT id, split, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_type, p FROM predictions WHERE NOT correct")
def _(s, d):
    return m.error_table(predictions(s, d))


@query("b13_logit_sigmoid", f"{L} SELECT id, margin, round(ln(p / (1 - p)), 6) AS logit, round(1e0 / (1e0 + exp(-margin)), 9) AS sigmoid FROM logits")
def _(s, d):
    return logits(s, d).select("id", "margin", F.round(sc.logit(F.col("p")), 6).alias("logit"), F.round(sc.sigmoid(F.col("margin")), 9).alias("sigmoid"))


@query("c2_key_alignment", f"{L}, e AS (SELECT DISTINCT id, similarity FROM logits WHERE split <> 'val') SELECT l.id, l.margin, round(coalesce(e.similarity, -1e0), 6) AS similarity FROM logits l LEFT JOIN e ON e.id = l.id")
def _(s, d):
    rows = logits(s, d)
    known = rows.where("split != 'val'").select("id", "similarity").distinct()
    return rows.select("id", "margin").join(known, "id", "left").select("id", "margin", F.round(F.coalesce("similarity", F.lit(-1.0)), 6).alias("similarity"))


_BUCKETS = "b AS (SELECT * FROM (VALUES (0, 0e0, 0.95e0), (1, 0.95e0, 0.97e0), (2, 0.97e0, 0.98e0), (3, 0.98e0, 0.99e0), (4, 0.99e0, NULL)) t(bucket, lo, hi))"


@query("c9_bucket_join", f"{P}, {_BUCKETS} SELECT id, margin, bucket, lo, hi FROM predictions JOIN b ON similarity >= lo AND (hi IS NULL OR similarity < hi)")
def _(s, d):
    return m.similarity_buckets(predictions(s, d), EDGES).select("id", "margin", "bucket", "lo", "hi")


@query(
    "d19_bucket_metrics",
    f"""{P}, {_BUCKETS} SELECT lo, hi, count(*) AS n, sum(label)::BIGINT AS n_defective, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct AND label = 1) AS missed, count(*) FILTER (NOT correct AND label = 0) AS false_alarms,
      round(count(*) FILTER (NOT correct) / count(*)::DOUBLE, 4) AS error_rate FROM predictions JOIN b ON similarity >= lo AND (hi IS NULL OR similarity < hi) GROUP BY lo, hi""",
)
def _(s, d):
    return m.bucket_metrics(predictions(s, d), EDGES)


_OTHER = "margin + CASE WHEN h % 7919 = 0 THEN 0.01e0 ELSE 0.00001e0 END"


@query(
    "c10_score_parity",
    f"""{L}, b AS (SELECT id, min(margin) AS x FROM logits GROUP BY id), o AS (SELECT id, min({_OTHER}) AS y FROM logits GROUP BY id)
    SELECT count(*) AS n, round(max(abs(x - y)), 9) AS max_abs, round(max(abs(x - y) / (0.0001e0 + 0.0001e0 * abs(x))), 6) AS used, max(abs(x - y) / (0.0001e0 + 0.0001e0 * abs(x))) <= 1 AS passed FROM b JOIN o USING (id)""",
)
def _(s, d):
    rows = logits(s, d)
    a = rows.groupBy("id").agg(F.min("margin").alias("z"))
    b = rows.groupBy("id").agg(F.min(F.col("margin") + F.when(F.col("h") % 7919 == 0, 0.01).otherwise(0.00001)).alias("z"))
    return m.parity(a, b).select("n", F.round("max_abs", 9).alias("max_abs"), F.round("used", 6).alias("used"), "passed")


_AP = "sum(pos / positives * tp / (tp + fp))"
_AUC = "sum(pos * (negatives - fp + neg / 2) / positives / negatives)"
_SCORER = """x{i} AS (SELECT label, {p} AS p FROM o), g{i} AS (SELECT p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM x{i} GROUP BY p),
  v{i} AS (SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives FROM g{i} WINDOW w AS (ORDER BY p DESC)),
  n{i} AS (SELECT (count(*) FILTER (p >= {t} AND label = 1))::DOUBLE AS tp, (count(*) FILTER (p >= {t} AND label = 0))::DOUBLE AS fp, (count(*) FILTER (p < {t} AND label = 1))::DOUBLE AS fn FROM x{i})"""
_SCORER_ROW = "SELECT '{name}' AS scorer, round((SELECT {ap} FROM v{i}), 9) AS average_precision, round((SELECT {auc} FROM v{i}), 9) AS roc_auc, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, {dp} AS max_dp, {ch} AS decisions_changed FROM n{i}"


@query(
    "c11_scorer_comparison",
    f"""{L}, o AS (SELECT label, p, round(p + ((h % 200) - 100) / 5000e0, 9) AS q FROM logits), {_SCORER.format(i=1, p='p', t=T)}, {_SCORER.format(i=2, p='q', t=T)}
    {_SCORER_ROW.format(name='p', i=1, ap=_AP, auc=_AUC, dp='0e0', ch='0')}
    UNION ALL {_SCORER_ROW.format(name='p_other', i=2, ap=_AP, auc=_AUC, dp='(SELECT round(max(abs(p - q)), 9) FROM o)', ch=f'(SELECT count(*) FILTER ((p >= {T}) <> (q >= {T})) FROM o)')}""",
)
def _(s, d):
    rows = logits(s, d).withColumn("p_other", F.round(F.col("p") + (F.col("h") % 200 - 100) / 5000.0, 9))
    rows = materialize(rows.select("label", "p", "p_other"), "two-scorers")
    return m.compare_scorers(rows, THRESHOLD).withColumns({c: F.round(c, 9) for c in ("average_precision", "roc_auc", "max_dp")})


@query("d13_confusion", f"{L}, {_COUNTS} SELECT tp, fp, tn, fn, round(tn / (tn + fp), 4) AS tn_rate, round(fp / (tn + fp), 4) AS fp_rate, round(fn / (tp + fn), 4) AS fn_rate, round(tp / (tp + fn), 4) AS tp_rate FROM counts")
def _(s, d):
    return m.confusion(logits(s, d), THRESHOLD)


@query("d14_operating_point", f"{L}, {_COUNTS} SELECT tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, fp / (fp + tn) AS false_alarm_rate, 2 * tp / (2 * tp + fp + fn) AS f1 FROM counts")
def _(s, d):
    return m.operating_point(logits(s, d), THRESHOLD)


_METRICS = "tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy"
_BY_SPLIT = _COUNTS.replace("SELECT (count", "SELECT split, (count").replace("FROM logits)", "FROM logits GROUP BY split)")


@query("d15_classification", f"{L}, {_BY_SPLIT} SELECT split, {_METRICS} FROM counts")
def _(s, d):
    return m.classification_metrics(logits(s, d), THRESHOLD, ["split"])


_CURVE = """g AS (SELECT p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM logits GROUP BY p),
curve AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives FROM g WINDOW w AS (ORDER BY p DESC)),
pr AS (SELECT p AS threshold, tp / (tp + fp) AS precision, tp / positives AS recall FROM curve)"""


@query("d16_average_precision", f"{L}, {_CURVE} SELECT round(sum(pos / positives * tp / (tp + fp)), 9) AS average_precision FROM curve")
def _(s, d):
    return m.ranking_metrics(logits(s, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("d17_roc_auc", f"{L}, {_CURVE} SELECT round(sum(pos * (negatives - fp + neg / 2) / positives / negatives), 9) AS roc_auc FROM curve")
def _(s, d):
    return m.ranking_metrics(logits(s, d)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("d18_bootstrap")
def _(s, d):
    """Seven metrics, 1,000 resamples (numpy's binomial draws are not SQL; tests hold them against a plain bootstrap)."""
    return m.bootstrap(logits(s, d), THRESHOLD, 1000)


@query("d18_point_metrics", f"""{L}, {_COUNTS}, {_CURVE} SELECT 'precision' AS metric, tp / (tp + fp) AS point FROM counts UNION ALL SELECT 'recall', tp / (tp + fn) FROM counts UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM counts
  UNION ALL SELECT 'macro_f1', (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 FROM counts UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + tn + fn) FROM counts
  UNION ALL SELECT 'average_precision', round({_AP}, 9) FROM curve UNION ALL SELECT 'roc_auc', round({_AUC}, 9) FROM curve""")
def _(s, d):
    """The point values of the bootstrap's metrics."""
    return m.point_metrics(logits(s, d), THRESHOLD).select("metric", F.round("point", 9).alias("point"))


@query(
    "d20_quartile_errors",
    f"""{P}, b AS (SELECT *, round(brightness, 4) AS br FROM predictions), c AS (SELECT quantile_cont(br, [0.25e0, 0.5e0, 0.75e0]) AS cuts FROM b)
    SELECT 1 + (cuts[1] < br)::INTEGER + (cuts[2] < br)::INTEGER + (cuts[3] < br)::INTEGER AS quartile, count(*) AS n, count(*) FILTER (NOT correct) AS errors FROM b, c GROUP BY 1""",
)
def _(s, d):
    return m.quartile_errors(predictions(s, d).withColumn("brightness", F.round("brightness", 4)))


_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2e0"


@query(
    "d21_spearman",
    f"""{P}, b AS (SELECT label, p, round(brightness, 4) AS br FROM predictions), r AS (SELECT label, {_RANK.format(by='label', v='p')} AS rx, {_RANK.format(by='label', v='br')} AS ry FROM b)
    SELECT label, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY label""",
)
def _(s, d):
    rows = predictions(s, d).withColumn("brightness", F.round("brightness", 4))
    return m.spearman_by(rows, "p", "brightness", "label").select("label", F.round("spearman", 9).alias("spearman"))


@query("e7_average_rank", f"{L}, r AS (SELECT split, p, {_RANK.format(by='split', v='p')} AS rank FROM logits) SELECT DISTINCT split, p, rank FROM r")
def _(s, d):
    return m.average_ranks(logits(s, d), "p", ["split"])


@query("d23_shortcut_table", f"""{P}, f AS (SELECT label, 'brightness' AS feature, round(brightness, 4) AS v FROM predictions UNION ALL SELECT label, 'similarity', round(similarity, 6) FROM predictions),
  r AS (SELECT *, {_RANK.format(by='feature', v='v')} AS rank FROM f),
  g AS (SELECT feature, avg(v) FILTER (label = 1) AS m1, avg(v) FILTER (label = 0) AS m0, var_samp(v) FILTER (label = 1) AS v1, var_samp(v) FILTER (label = 0) AS v0,
    sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0, sum(rank) FILTER (label = 1) AS s FROM r GROUP BY feature),
  a AS (SELECT *, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g)
  SELECT feature, round(m1, 3) AS mean_defective, round(m0, 3) AS mean_normal, round((m1 - m0) / sqrt((v1 + v0) / 2), 3) AS cohens_d, round(greatest(auc, 1 - auc), 3) AS separability FROM a""")
def _(s, d):
    rows = predictions(s, d).withColumns({"brightness": F.round("brightness", 4), "similarity": F.round("similarity", 6)})
    return m.shortcut_table(rows, ["brightness", "similarity"])


_BIN = " + ".join(f"({i / 15!r}::DOUBLE <= p)::INTEGER" for i in range(1, 15))
_BINS = f"bins AS (SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, coalesce(mp, 0e0) AS mean_p, coalesce(sh, 0e0) AS share FROM range(15) t(i) LEFT JOIN (SELECT {_BIN} AS b, count(*) AS n, avg(p) AS mp, avg(label) AS sh FROM logits GROUP BY 1) g ON g.b = t.i)"


@query("d24_reliability_bins", f"{L}, {_BINS} SELECT bin, n, round(mean_p, 9) AS mean_p, round(share, 9) AS share FROM bins")
def _(s, d):
    return m.reliability_bins(logits(s, d), 15).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("share", 9).alias("share"))


@query("d25_ece", f"{L}, {_BINS} SELECT round(sum(n * abs(mean_p - share)) / sum(n), 9) AS ece FROM bins")
def _(s, d):
    return m.expected_calibration_error(logits(s, d), 15).select(F.round("ece", 9).alias("ece"))


_X = "CASE WHEN label = 1 THEN margin ELSE -margin END"


@query("d26_nll", f"{L} SELECT round(avg(greatest(-x, 0e0) + ln(1 + exp(-abs(x)))), 9) AS nll FROM (SELECT ({_X}) / {TEMPERATURE}e0 AS x FROM logits)")
def _(s, d):
    return m.nll(logits(s, d), TEMPERATURE).select(F.round("nll", 9).alias("nll"))


@query("d27_separable", f"{L} SELECT split, min(margin) FILTER (label = 1) > max(margin) FILTER (label = 0) AS separable FROM logits WHERE split = 'val' GROUP BY split")
def _(s, d):
    return m.is_separable(logits(s, d).where("split = 'val'")).select(F.lit("val").alias("split"), "separable")


_BAND = f"""band AS (SELECT count(*) AS n, count(*) FILTER (p >= {LO} AND p < {HI}) AS reviewed, count(*) FILTER (p >= {LO} AND p < {HI}) / count(*)::DOUBLE AS review_share,
  count(*) FILTER ((p >= {T}) <> (label = 1)) AS errors, count(*) FILTER ((p >= {T}) <> (label = 1) AND p >= {LO} AND p < {HI}) AS errors_caught,
  count(*) FILTER ((p >= {T}) <> (label = 1) AND NOT (p >= {LO} AND p < {HI})) AS auto_errors, count(*) FILTER (label = 1 AND p < {LO}) AS missed_auto_passed,
  count(*) FILTER (label = 0 AND p >= {HI}) AS alarms_auto_rejected FROM logits)"""


@query("d28_band_summary", f"{L}, {_BAND} SELECT * FROM band")
def _(s, d):
    return m.band_summary(logits(s, d), THRESHOLD, *BAND)


def _cost_sql(points: dict[str, str], chosen: str, low: str, high: str, table: str = "logits", extra: str = "") -> str:
    rows = [f"SELECT '{name}' AS policy, round(1000 * (20 * count(*) FILTER (label = 1 AND p < {t}) + count(*) FILTER (label = 0 AND p >= {t})) / count(*)::DOUBLE, 6) AS cost FROM {table}{extra}" for name, t in points.items()]
    band = f"SELECT '{chosen}+review_band', round(1000 * (20 * count(*) FILTER (label = 1 AND p < {low}) + count(*) FILTER (label = 0 AND p >= {high}) + 0.25e0 * count(*) FILTER (p >= {low} AND p < {high})) / count(*)::DOUBLE, 6) FROM {table}{extra}"
    return " UNION ALL ".join([*rows, band])


@query("d29_expected_cost", f"{L} {_cost_sql({'default_0.5': '0.5e0', 'f1_optimal': '0.55e0', 'recall_constrained': T}, 'recall_constrained', LO, HI)}")
def _(s, d):
    points = {"default_0.5": 0.5, "f1_optimal": 0.55, "recall_constrained": THRESHOLD}
    return m.cost_table(logits(s, d), points, "recall_constrained", *BAND).withColumn("cost", F.round("cost", 6))


@query("d30_class_weights", f"{L} SELECT label, count(*) AS n, (sum(count(*)) OVER ()) / ((count(*) OVER ()) * count(*))::DOUBLE AS weight FROM logits GROUP BY label")
def _(s, d):
    return m.class_weights(logits(s, d))


@query("d33_batch_summary", f"{P} SELECT split, count(*) AS images, count(*) FILTER (predicted = 1) AS defective, count(*) FILTER (needs_review) AS needs_review FROM predictions GROUP BY split")
def _(s, d):
    return predictions(s, d).groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("predicted") == 1).alias("defective"), F.count_if("needs_review").alias("needs_review"))


@query("d35_feature_histogram", f"{L} SELECT label, least(greatest(floor((p - 0e0) / 0.05e0), 0), 19)::INTEGER AS bin, count(*) AS n FROM logits GROUP BY 1, 2")
def _(s, d):
    return m.feature_histogram(logits(s, d), "p", 0.0, 0.05, 20)


@query("d36_metric_pivot", f"""{L}, {_BY_SPLIT}, v AS (SELECT split, {_METRICS} FROM counts), u AS (SELECT split, 'f1' AS metric, f1 AS value FROM v UNION ALL SELECT split, 'recall', recall FROM v UNION ALL SELECT split, 'precision', precision FROM v)
  SELECT metric, max(value) FILTER (split = 'val') AS val, max(value) FILTER (split = 'test') AS test, max(value) FILTER (split = 'external_test') AS external_test FROM u GROUP BY metric""")
def _(s, d):
    each = m.classification_metrics(logits(s, d), THRESHOLD, ["split"])
    long = each.select("split", F.explode(F.create_map(*(x for c in ("f1", "recall", "precision") for x in (F.lit(c), F.col(c))))).alias("metric", "value"))
    return long.groupBy("metric").pivot("split", ["val", "test", "external_test"]).agg(F.max("value"))


@query("h11_metric_maps", f"{L}, {_BY_SPLIT}, v AS (SELECT split, {_METRICS} FROM counts) SELECT split, round(100 * recall, 6) AS recall_pct, round(100 * accuracy, 6) AS accuracy_pct FROM v")
def _(s, d):
    each = m.classification_metrics(logits(s, d), THRESHOLD, ["split"])
    maps = each.select("split", F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("precision", "recall", "accuracy")))).alias("metrics"))
    kept = maps.select("split", F.transform_values(F.map_filter("metrics", lambda k, v: k != "precision"), lambda k, v: F.round(100 * v, 6)).alias("metrics"))
    return kept.select("split", F.col("metrics")["recall"].alias("recall_pct"), F.col("metrics")["accuracy"].alias("accuracy_pct"))


@query("h4_bin_index", f"{L} SELECT id, margin, (0.25e0 <= p)::INTEGER + (0.5e0 <= p)::INTEGER + (0.75e0 <= p)::INTEGER AS left_closed, (0.25e0 < p)::INTEGER + (0.5e0 < p)::INTEGER + (0.75e0 < p)::INTEGER AS right_closed FROM logits")
def _(s, d):
    e = [0.25, 0.5, 0.75]
    return logits(s, d).select("id", "margin", bin_index(F.col("p"), e).alias("left_closed"), bin_index(F.col("p"), e, closed_left=False).alias("right_closed"))


@query("h5_quantiles", f"{L} SELECT split, round(quantile_cont(p, 0.25e0), 9) AS q25, round(quantile_cont(p, 0.5e0), 9) AS q50, round(quantile_cont(p, 0.9e0), 9) AS q90 FROM logits GROUP BY split")
def _(s, d):
    out = exact_quantiles(logits(s, d), "p", [0.25, 0.5, 0.9], ["split"])
    return out.select("split", *(F.round(F.col("quantiles")[i], 9).alias(q) for i, q in enumerate(("q25", "q50", "q90"))))


@query("h6_softmax", f"{L} SELECT id, margin, round(1 / (1 + exp(margin) + exp(-margin)), 9) AS s0, round(exp(margin) / (1 + exp(margin) + exp(-margin)), 9) AS s1 FROM logits")
def _(s, d):
    z = F.array(F.lit(0.0), F.col("margin"), -F.col("margin"))
    return logits(s, d).withColumn("soft", sc.softmax(z)).select("id", "margin", F.round(F.col("soft")[0], 9).alias("s0"), F.round(F.col("soft")[1], 9).alias("s1"))


@query("e5_pr_curve", f"{L}, {_CURVE} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr")
def _(s, d):
    return m.pr_curve(logits(s, d)).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("e6_roc_curve", f"{L}, {_CURVE} SELECT p AS threshold, round(fp / negatives, 9) AS fpr, round(tp / positives, 9) AS tpr FROM curve")
def _(s, d):
    return m.roc_curve(logits(s, d)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_LOGIT = "ln({x} / (1 - {x}))"
_MID = "round(coalesce(1 / (1 + exp(-(" + _LOGIT.format(x="c") + " + " + _LOGIT.format(x="lower") + ") / 2)), c), 7) AS threshold FROM (SELECT c, (SELECT max(p) FROM logits WHERE p < c) AS lower FROM cand)"


@query("e8_margin_threshold", f"{L}, cand AS (SELECT min(p) AS c FROM logits WHERE p >= {T}) SELECT {_MID}")
def _(s, d):
    rows = logits(s, d)
    candidate = rows.where(F.col("p") >= THRESHOLD).agg(F.min("p").alias("candidate"))
    return m.margin_threshold(rows, candidate).select(F.round("threshold", 7).alias("threshold"))


@query("i6_threshold_for_recall", f"{L}, {_CURVE}, best AS (SELECT max(precision) AS bp FROM pr WHERE recall >= 0.95e0), cand AS (SELECT min(threshold) AS c FROM pr, best WHERE recall >= 0.95e0 AND precision = bp) SELECT {_MID}")
def _(s, d):
    return m.threshold_for_recall(logits(s, d), 0.95).select(F.round("threshold", 7).alias("threshold"))


@query("i7_f1_threshold", f"{L}, {_CURVE}, f AS (SELECT threshold, 2 * precision * recall / (precision + recall) AS f1 FROM pr) SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def _(s, d):
    return m.f1_optimal_threshold(logits(s, d))


@query("i8_threshold_for_precision", f"{L}, {_CURVE} SELECT coalesce(min(threshold) FILTER (precision >= 0.9e0 AND threshold >= 0.5e0), greatest(max(threshold), 0.5e0)) AS threshold FROM pr")
def _(s, d):
    return m.threshold_for_precision(logits(s, d), 0.9, 0.5)


@query("i9_max_threshold_with_recall", f"{L}, {_CURVE}, cand AS (SELECT max(threshold) AS c FROM pr WHERE recall >= 0.99e0) SELECT {_MID}")
def _(s, d):
    return m.max_threshold_with_recall(logits(s, d), 0.99).select(F.round("threshold", 7).alias("threshold"))


@query("i10_review_band", f"{L}, {_CURVE}, cand AS (SELECT max(threshold) AS c FROM pr WHERE recall >= 0.99e0), lo AS (SELECT {_MID}) SELECT least(lo.threshold, {T}) AS low, (SELECT coalesce(min(threshold) FILTER (precision >= 0.9e0 AND threshold >= {T}), greatest(max(threshold), {T})) FROM pr) AS high FROM lo")
def _(s, d):
    return m.review_band(logits(s, d), THRESHOLD, 0.99, 0.9).select(F.round("low", 7).alias("low"), "high")


def _grid_sql(table: str = "logits", where: str = "split = 'val'") -> str:
    """CTEs of the temperature fit; ``b<ROUNDS>`` holds the best point i of the last grid, whose ends are in ``e<ROUNDS - 1>``."""
    out = [f"c AS (SELECT m, count(*) AS n FROM (SELECT {_X} AS m FROM {table} WHERE {where}) GROUP BY m), e0 AS (SELECT ln({m.LOW_T}e0) AS lo, ln({m.HIGH_T}e0) AS hi)"]
    step = f"lo + (hi - lo) * {{i}} / {m.GRID - 1}e0"
    for r in range(1, m.ROUNDS + 1):
        out.append(f"g{r} AS (SELECT i, {step.format(i='i')} AS lt FROM range({m.GRID}) r(i), e{r - 1})")
        out.append(f"l{r} AS (SELECT i, sum(n * (greatest(-m / exp(lt), 0e0) + ln(1 + exp(-abs(m / exp(lt)))))) AS v FROM g{r}, c GROUP BY i)")
        out.append(f"b{r} AS (SELECT i FROM l{r} ORDER BY v, i LIMIT 1)")
        out.append(f"e{r} AS (SELECT {step.format(i='greatest(i - 1, 0)')} AS lo, {step.format(i=f'least(i + 1, {m.GRID - 1})')} AS hi FROM b{r}, e{r - 1})")
    out.append(f"sep AS (SELECT coalesce(min(margin) FILTER (label = 1) > max(margin) FILTER (label = 0), false) AS s FROM {table} WHERE {where})")
    out.append(f"fit AS (SELECT exp({step.format(i='i')}) AS t FROM b{m.ROUNDS}, e{m.ROUNDS - 1})")
    note = f"CASE WHEN s THEN 'separable' WHEN t < {m.LOW_T}e0 * 1.01e0 OR t > {m.HIGH_T}e0 / 1.01e0 THEN 'at a bound' ELSE '' END"
    out.append(f"chosen AS (SELECT CASE WHEN s THEN 1e0 ELSE t END AS temperature, {note} AS note FROM fit, sep)")
    return ", ".join(out)


@query("i4_temperature_fit", f"{L}, {_grid_sql()} SELECT round(ln(t), 4) AS log_t FROM fit")
def _(s, d):
    t = m.fit_temperature(logits(s, d).where("split = 'val'"))
    return s.range(1).select(F.round(F.ln(F.lit(t)), 4).alias("log_t"))


@query("i5_choose_temperature", f"{L}, {_grid_sql()} SELECT round(ln(temperature), 4) AS log_t, note FROM chosen")
def _(s, d):
    chosen = m.choose_temperature(logits(s, d).where("split = 'val'"))
    return chosen.select(F.round(F.ln("temperature"), 4).alias("log_t"), "note")


@query("i5_separable_keeps_one", f"{L}, apart AS (SELECT label, CASE WHEN label = 1 THEN abs(margin) + 0.5e0 ELSE -abs(margin) END AS margin FROM logits), {_grid_sql('apart', 'true')} SELECT temperature, note FROM chosen")
def _(s, d):
    """Margins that one cut separates have no finite best temperature: 1 is kept."""
    apart = logits(s, d).withColumn("margin", F.when(F.col("label") == 1, F.abs("margin") + 0.5).otherwise(-F.abs("margin")))
    return m.choose_temperature(apart)


def calibrate_and_select(s, d) -> dict:
    """The choices from the validation split alone: temperature, thresholds and band, with the written scored split and its curve."""
    val = materialize(logits(s, d).where("split = 'val'").select("id", "label", "margin"), "val")
    t = m.choose_temperature(val).first()["temperature"]
    val = materialize(val.withColumn("p", F.round(sc.sigmoid(F.col("margin") / F.round(F.lit(t), 4)), 9)), "val-scored")
    curve = materialize(m.pr_curve(val), "val-curve")
    threshold = m.threshold_for_recall(val, 0.95, curve).first()[0]
    low, high = m.review_band(val, threshold, 0.99, 0.9, curve).first()
    points = {"default_0.5": 0.5, "f1_optimal": m.f1_optimal_threshold(val, curve).first()[0], "recall_constrained": threshold}
    return {"val": val, "temperature": t, "points": points, "threshold": threshold, "low": low, "high": high}


_VAL = f"""{_grid_sql()}, val AS (SELECT label, margin, round(1e0 / (1e0 + exp(-margin / round(temperature, 4))), 9) AS p FROM logits, chosen WHERE split = 'val'),
g AS (SELECT p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM val GROUP BY p),
curve AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives FROM g WINDOW w AS (ORDER BY p DESC)),
pr AS (SELECT p AS threshold, tp / (tp + fp) AS precision, tp / positives AS recall FROM curve),
c1 AS (SELECT min(threshold) AS c FROM pr WHERE recall >= 0.95e0 AND precision = (SELECT max(precision) FROM pr WHERE recall >= 0.95e0)),
c2 AS (SELECT max(threshold) AS c FROM pr WHERE recall >= 0.99e0),
th AS (SELECT {_MID.replace('FROM logits', 'FROM val').replace('FROM cand', 'FROM c1').replace('round(coalesce', 'coalesce', 1).replace(', c), 7) AS threshold', ', c) AS threshold')}),
lo0 AS (SELECT {_MID.replace('FROM logits', 'FROM val').replace('FROM cand', 'FROM c2').replace('round(coalesce', 'coalesce', 1).replace(', c), 7) AS threshold', ', c) AS threshold')}),
pt AS (SELECT th.threshold AS rc, least(lo0.threshold, th.threshold) AS low,
  (SELECT coalesce(min(threshold) FILTER (precision >= 0.9e0 AND threshold >= th.threshold), greatest(max(threshold), th.threshold)) FROM pr) AS high,
  (SELECT threshold FROM (SELECT threshold, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pr) ORDER BY f1 DESC, threshold LIMIT 1) AS f1 FROM th, lo0)"""


def _ece_sql(p: str) -> str:
    bins = " + ".join(f"({i / 15!r}::DOUBLE <= {p})::INTEGER" for i in range(1, 15))
    return f"(SELECT round(sum(n * abs(mp - sh)) / sum(n), 6) FROM (SELECT count(*) AS n, avg({p}) AS mp, avg(label) AS sh FROM val GROUP BY {bins}))"


def _nll_sql(t: str) -> str:
    return f"(SELECT round(avg(greatest(-x, 0e0) + ln(1 + exp(-abs(x)))), 6) FROM (SELECT (CASE WHEN label = 1 THEN margin ELSE -margin END) / {t} AS x FROM val, chosen))"


_RAW = "(1e0 / (1e0 + exp(-margin)))"


@query(
    "i11_calibrate_and_select",
    f"""{L}, {_VAL} SELECT round(ln(temperature), 4) AS log_t, note, count(*) AS n, sum(label)::BIGINT AS n_defective, round(max(rc), 6) AS threshold, round(max(f1), 6) AS f1_threshold, round(max(low), 6) AS low, round(max(high), 6) AS high,
      count(*) FILTER (p >= low AND p < high) AS reviewed, count(*) FILTER ((p >= rc) <> (label = 1)) AS errors, count(*) FILTER ((p >= rc) <> (label = 1) AND p >= low AND p < high) AS errors_caught,
      count(*) FILTER (label = 1 AND p < low) AS missed_auto_passed, count(*) FILTER (label = 0 AND p >= high) AS alarms_auto_rejected,
      {_ece_sql(_RAW)} AS ece_before, {_ece_sql('p')} AS ece_after, {_nll_sql('1e0')} AS nll_before, {_nll_sql('temperature')} AS nll_after FROM val, chosen, pt GROUP BY temperature, note""",
)
def _(s, d):
    """One row: temperature and note, thresholds, review band and its summary, calibration error and loss before and after."""
    c = calibrate_and_select(s, d)
    val, t = c["val"], c["temperature"]
    before = val.withColumn("p", sc.sigmoid(F.col("margin")))
    one = m.band_summary(val, c["threshold"], c["low"], c["high"]).select("n", "reviewed", "errors", "errors_caught", "missed_auto_passed", "alarms_auto_rejected")
    for name, df in (("ece_before", m.expected_calibration_error(before, 15)), ("ece_after", m.expected_calibration_error(val, 15)), ("nll_before", m.nll(val, 1.0)), ("nll_after", m.nll(val, t))):
        one = one.crossJoin(F.broadcast(df.select(F.round(F.col(df.columns[0]), 6).alias(name))))
    one = one.crossJoin(F.broadcast(val.agg(F.sum("label").alias("n_defective"))))
    note = "separable" if m.is_separable(val).first()[0] else "at a bound" if t < m.LOW_T * 1.01 or t > m.HIGH_T / 1.01 else ""
    at = {"threshold": c["threshold"], "f1_threshold": c["points"]["f1_optimal"], "low": c["low"], "high": c["high"]}
    return one.withColumns({"log_t": F.round(F.ln(F.lit(t)), 4), "note": F.lit(note), **{k: F.round(F.lit(v), 6) for k, v in at.items()}})


@query(
    "i11_operating_points",
    f"""{L}, {_VAL}, p3 AS (SELECT 'default_0.5' AS point, 0.5e0 AS t UNION ALL SELECT 'f1_optimal', f1 FROM pt UNION ALL SELECT 'recall_constrained', rc FROM pt),
    k AS (SELECT point, t, (count(*) FILTER (p >= t AND label = 1))::DOUBLE AS tp, (count(*) FILTER (p >= t AND label = 0))::DOUBLE AS fp, (count(*) FILTER (p < t AND label = 0))::DOUBLE AS tn, (count(*) FILTER (p < t AND label = 1))::DOUBLE AS fn FROM val, p3 GROUP BY point, t)
    SELECT point, round(t, 6) AS threshold, tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS false_alarm_rate FROM k""",
)
def _(s, d):
    """Counts and rates of the three operating points."""
    c = calibrate_and_select(s, d)
    return m.point_table(c["val"], c["points"]).withColumn("threshold", F.round("threshold", 6))


@query("i11_cost_table", f"{L}, {_VAL}, w AS (SELECT * FROM val, pt) {_cost_sql({'default_0.5': '0.5e0', 'f1_optimal': 'f1', 'recall_constrained': 'rc'}, 'recall_constrained', 'low', 'high', 'w')}")
def _(s, d):
    """Illustrative cost of the three points, and of the chosen one with its review band."""
    c = calibrate_and_select(s, d)
    return m.cost_table(c["val"], c["points"], "recall_constrained", c["low"], c["high"]).withColumn("cost", F.round("cost", 6))


@query("i15_evaluate_once", f"{L}, {_BY_SPLIT}, b AS (SELECT split, count(*) FILTER (p >= {LO} AND p < {HI}) AS reviewed, count(*) AS n FROM logits GROUP BY split) SELECT split, n, reviewed, {_METRICS} FROM counts JOIN b USING (split) WHERE split <> 'val'")
def _(s, d):
    """Both test sets at the chosen point; refused without a passed audit, on other rows than the audited, and a second time."""
    return _evaluated(s, d)[0]


def _evaluated(s, d):
    """The metrics and the folder of the one evaluation of the test rows, against the audit that was stored for them."""
    rows, folder = materialize(logits(s, d).where("split != 'val'"), "held-out"), scratch_path(s, "run")
    return evaluate_once(rows, store_audit(rows, folder), folder, THRESHOLD, *BAND, edges=tuple(EDGES)), folder


def _per_metric(part: str, key: str, columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT split, '{part}' AS part, {key} AS key, '{c}' AS metric, round({c}::DOUBLE, 6) AS value FROM {table}" for c in columns)


_CORRECT = f"(p >= {T}) = (label = 1)"


@query("i15_results", f"""{L}, t AS (SELECT *, {_CORRECT} AS right_ FROM logits WHERE split <> 'val'), {_BUCKETS},
  size AS (SELECT split, count(*) AS n, sum(label) AS n_defective FROM t GROUP BY split),
  k AS (SELECT split, (count(*) FILTER (p >= {T} AND label = 1))::DOUBLE AS tp, (count(*) FILTER (p >= {T} AND label = 0))::DOUBLE AS fp, (count(*) FILTER (p < {T} AND label = 0))::DOUBLE AS tn,
    (count(*) FILTER (p < {T} AND label = 1))::DOUBLE AS fn FROM t GROUP BY split),
  conf AS (SELECT *, round(tn / (tn + fp), 4) AS tn_rate, round(fp / (tn + fp), 4) AS fp_rate, round(fn / (tp + fn), 4) AS fn_rate, round(tp / (tp + fn), 4) AS tp_rate FROM k),
  half AS (SELECT split, (count(*) FILTER (p >= 0.5e0 AND label = 1))::DOUBLE AS tp, (count(*) FILTER (p >= 0.5e0 AND label = 0))::DOUBLE AS fp, (count(*) FILTER (p < 0.5e0 AND label = 0))::DOUBLE AS tn,
    (count(*) FILTER (p < 0.5e0 AND label = 1))::DOUBLE AS fn FROM t GROUP BY split), ref AS (SELECT split, {_METRICS} FROM half),
  pt AS (SELECT split, {_METRICS} FROM k),
  band AS (SELECT split, count(*) AS n, count(*) FILTER (p >= {LO} AND p < {HI}) AS reviewed, count(*) FILTER (p >= {LO} AND p < {HI}) / count(*)::DOUBLE AS review_share, count(*) FILTER (NOT right_) AS errors,
    count(*) FILTER (NOT right_ AND p >= {LO} AND p < {HI}) AS errors_caught, count(*) FILTER (NOT right_ AND NOT (p >= {LO} AND p < {HI})) AS auto_errors,
    count(*) FILTER (label = 1 AND p < {LO}) AS missed_auto_passed, count(*) FILTER (label = 0 AND p >= {HI}) AS alarms_auto_rejected FROM t GROUP BY split),
  bk AS (SELECT split, lo, count(*) AS n, sum(label) AS n_defective, count(*) FILTER (NOT right_) AS errors, count(*) FILTER (NOT right_ AND label = 1) AS missed, count(*) FILTER (NOT right_ AND label = 0) AS false_alarms,
    round(count(*) FILTER (NOT right_) / count(*)::DOUBLE, 4) AS error_rate FROM t JOIN b ON similarity >= lo AND (hi IS NULL OR similarity < hi) GROUP BY split, lo)
  {_per_metric('size', "''", ['n', 'n_defective'], 'size')} UNION ALL {_per_metric('at_operating_threshold', "''", ['precision', 'recall', 'f1', 'macro_f1', 'accuracy'], 'pt')}
  UNION ALL {_per_metric('at_0.5_reference', "''", ['precision', 'recall', 'f1', 'macro_f1', 'accuracy'], 'ref')}
  UNION ALL {_per_metric('confusion', "''", ['tp', 'fp', 'tn', 'fn', 'tn_rate', 'fp_rate', 'fn_rate', 'tp_rate'], 'conf')}
  UNION ALL {_per_metric('review_band', "''", ['n', 'reviewed', 'review_share', 'errors', 'errors_caught', 'auto_errors', 'missed_auto_passed', 'alarms_auto_rejected'], 'band')}
  UNION ALL {_per_metric('by_similarity_to_train', 'lo::VARCHAR', ['n', 'n_defective', 'errors', 'missed', 'false_alarms', 'error_rate'], 'bk')}""")
def _(s, d):
    """The stored results of the one evaluation, as long rows (what SQL can say of them: without ranking metrics and the brightness probe)."""
    rows = s.read.parquet(_evaluated(s, d)[1] + "/test_results")
    rows = rows.where("part not like 'brightness%' and metric not in ('average_precision', 'roc_auc')")
    return rows.select("split", "part", "key", "metric", F.round("value", 6).alias("value"))


@query("i15_intervals")
def _(s, d):
    """The stored bootstrap intervals, ranking metrics and brightness probe of the one evaluation."""
    rows = s.read.parquet(_evaluated(s, d)[1] + "/test_results")
    return rows.where("part like 'brightness%' or low is not null or metric in ('average_precision', 'roc_auc')")


@query("i16_brightness_probe", f"""{P}, b AS (SELECT label, correct, p, round(brightness, 4) AS br FROM predictions), c AS (SELECT quantile_cont(br, [0.25e0, 0.5e0, 0.75e0]) AS cuts FROM b),
  r AS (SELECT label, {_RANK.format(by='label', v='p')} AS rx, {_RANK.format(by='label', v='br')} AS ry FROM b)
  SELECT 'quartile' || (1 + (cuts[1] < br)::INTEGER + (cuts[2] < br)::INTEGER + (cuts[3] < br)::INTEGER) AS part, count(*) AS n, (count(*) FILTER (NOT correct))::DOUBLE AS value FROM b, c GROUP BY 1
  UNION ALL SELECT 'spearman' || label, count(*), round(corr(rx, ry), 9) FROM r GROUP BY label""")
def _(s, d):
    rows = materialize(predictions(s, d).select("label", "correct", "p", F.round("brightness", 4).alias("brightness")), "probe")
    q = m.quartile_errors(rows).select(F.concat(F.lit("quartile"), F.col("quartile")).alias("part"), "n", F.col("errors").cast("double").alias("value"))
    r = m.spearman_by(rows, "p", "brightness", "label")
    return q.unionByName(r.select(F.concat(F.lit("spearman"), F.col("label")).alias("part"), "n", F.round("spearman", 9).alias("value")))


@query("i22_overfit_summary", f"{L}, {_BY_SPLIT}, v AS (SELECT split, {_METRICS} FROM counts) SELECT (SELECT f1 FROM v WHERE split = 'test') - (SELECT f1 FROM v WHERE split = 'val') AS f1_gap, (SELECT recall FROM v WHERE split = 'test') - (SELECT recall FROM v WHERE split = 'val') AS recall_gap")
def _(s, d):
    each = m.classification_metrics(logits(s, d), THRESHOLD, ["split"])
    at = lambda c, k: F.max(F.when(F.col("split") == k, F.col(c)))
    return each.agg((at("f1", "test") - at("f1", "val")).alias("f1_gap"), (at("recall", "test") - at("recall", "val")).alias("recall_gap"))


@query("e10_sample_correct", f"{P}, r AS (SELECT split, label, id, row_number() OVER (PARTITION BY split, label ORDER BY md5('3|' || id), id) AS k FROM predictions WHERE correct) SELECT split, label, id FROM r WHERE k <= 6")
def _(s, d):
    return m.sample_correct(predictions(s, d), 6, 3)


@query(
    "f3_explain_cases",
    f"""{P} SELECT * FROM (SELECT 'FN' AS kind, split, id, p FROM predictions WHERE NOT correct AND label = 1 AND split = 'test' ORDER BY p, id LIMIT 2)
    UNION ALL SELECT * FROM (SELECT 'FP', split, id, p FROM predictions WHERE NOT correct AND label = 0 AND split = 'external_test' ORDER BY p DESC, id LIMIT 2)""",
)
def _(s, d):
    return m.explain_cases(predictions(s, d))


@query("a19_explain_index", f"""{P} SELECT id AS case_id, kind || ' in ' || split AS title FROM (SELECT * FROM (SELECT 'FN' AS kind, split, id FROM predictions WHERE NOT correct AND label = 1 AND split = 'test' ORDER BY p, id LIMIT 2)
  UNION ALL SELECT * FROM (SELECT 'FP', split, id FROM predictions WHERE NOT correct AND label = 0 AND split = 'external_test' ORDER BY p DESC, id LIMIT 2))""")
def _(s, d):
    return m.explain_cases(predictions(s, d)).select(F.col("id").alias("case_id"), F.concat("kind", F.lit(" in "), "split").alias("title"))


@query("f4_first_rows", f"{L} SELECT id, label FROM logits WHERE split = 'val' ORDER BY id, margin LIMIT 32")
def _(s, d):
    return logits(s, d).where("split = 'val'").orderBy("id", "margin").limit(32).select("id", "label")


@query("f6_worst_errors", f"""{P}, e AS (SELECT split, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS error_type, id, p, abs(p - {T}) AS off FROM predictions WHERE NOT correct),
  r AS (SELECT *, row_number() OVER (PARTITION BY split, error_type ORDER BY round(off, 9) DESC, id) AS k FROM e) SELECT split, error_type, id, p, k FROM r WHERE k <= 24""")
def _(s, d):
    e = m.error_table(predictions(s, d))
    order = Window.partitionBy("split", "error_type").orderBy(F.desc(F.round(F.abs(F.col("p") - THRESHOLD), 9)), "id")
    return e.withColumn("k", F.row_number().over(order)).where("k <= 24").select("split", "error_type", "id", "p", "k")


@query("i21_release_gate", f"""{L}, b AS (SELECT id, min(margin) AS x FROM logits GROUP BY id), o AS (SELECT id, min({_OTHER.replace('0.01e0', '0.00002e0')}) AS y FROM logits GROUP BY id), {_BY_SPLIT}, v AS (SELECT split, {_METRICS} FROM counts),
  par AS (SELECT max(abs(x - y) / (0.0001e0 + 0.0001e0 * abs(x))) AS r FROM b JOIN o USING (id))
  SELECT split, 'v1' AS model_version, precision, recall, f1, macro_f1, accuracy, round(r, 6) AS tolerance_used FROM v, par WHERE r <= 1 AND split <> 'val'""")
def _(s, d):
    """Release of a version: the exported scorer agrees with the trained one, metrics of the test sets go along, the version is written once."""
    rows = logits(s, d)
    scorer = rows.groupBy("id").agg(F.min("margin").alias("z"))
    exported = rows.groupBy("id").agg(F.min(F.col("margin") + F.when(F.col("h") % 7919 == 0, 0.00002).otherwise(0.00001)).alias("z"))
    metrics = m.classification_metrics(rows.where("split != 'val'"), THRESHOLD, ["split"])
    return release(scorer, exported, metrics, scratch_path(s, "models"), "v1").withColumn("tolerance_used", F.round("tolerance_used", 6))


_RUNS = "runs AS (SELECT run, make_timestamp(2024, 1, 1, 0, 0, 0) + to_seconds(sum(n)::BIGINT * 7919 % 1000003) AS created_at FROM history GROUP BY run)"


@query("a17_latest_run", f"{H}, {_RUNS} SELECT run, created_at FROM runs ORDER BY created_at DESC, run DESC LIMIT 1")
def _(s, d):
    """The run created last."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    runs = history(s, d).groupBy("run").agg((F.sum("n") * 7919 % 1_000_003).alias("late"))
    runs = runs.select("run", F.timestamp_seconds(F.unix_timestamp(start) + F.col("late")).alias("created_at"))
    return latest_run(runs)


@query("d32_generalisation_gap", f"{H} SELECT run, round(avg(train_pr_auc) - avg(val_pr_auc), 9) AS gap FROM history GROUP BY run")
def _(s, d):
    return history(s, d).groupBy("run").agg(F.round(F.avg("train_pr_auc") - F.avg("val_pr_auc"), 9).alias("gap"))


@query(
    "e9_epoch_trace",
    f"""{H}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY stage DESC, epoch) AS k FROM history),
    b AS (SELECT a.run, a.stage, a.epoch, a.k, NOT EXISTS (SELECT 1 FROM o c WHERE c.run = a.run AND c.k < a.k AND (c.val_pr_auc > a.val_pr_auc OR (c.val_pr_auc = a.val_pr_auc AND c.val_loss <= a.val_loss))) AS better FROM o a),
    i AS (SELECT *, sum(better::INTEGER) OVER (PARTITION BY run, stage ORDER BY epoch) AS island FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY run, stage, island ORDER BY epoch) - CASE WHEN island = 0 THEN 0 ELSE 1 END AS since FROM i)
    SELECT run, stage, epoch, better, since, stage = 'finetune' AND since >= 4 AS stop FROM n""",
)
def _(s, d):
    return m.epoch_trace(history(s, d), 4)


@query("i14_model_selection", f"{H}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_pr_auc DESC, val_loss, stage DESC, epoch DESC) AS k FROM history) SELECT run, stage, epoch, val_pr_auc FROM r WHERE k = 1")
def _(s, d):
    return m.best_epochs(history(s, d))
