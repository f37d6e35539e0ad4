"""Score analytics over a table of id, label (0/1) and p.

Curves first count by distinct score.  Running totals over distinct scores are
dealt by range (``operators.ranking``), so no task orders all scores, however
they are spread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.arrays import bin_index
from gaugeframe.functions.scores import logit, sigmoid
from gaugeframe.operators.ranking import exact_quantiles, running_totals
from gaugeframe.sources.scratch import drop_written, materialize, materialize_observed

#: Distinct scores that one task of the bootstrap draws weights for at a time.
CELLS = 1024
#: Temperatures that one round of the fit tries, and its rounds: the last grid's points lie 3e-6 apart in ln T.
GRID, ROUNDS = 64, 4
LOW_T, HIGH_T = 0.05, 20.0


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def counts_at(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn at p >= threshold, for each group of ``by``."""
    hit, pos = F.col("p") >= threshold, F.col("label") == 1
    return df.groupBy(*(by or [])).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn")
    )


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """One row: the four counts and, by true class, their shares (4 places)."""
    c = counts_at(df, threshold)
    neg, pos = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    share = lambda a, b: F.round(_ratio(F.col(a), b, 0.0), 4)
    return c.withColumns({"tn_rate": share("tn", neg), "fp_rate": share("fp", neg), "fn_rate": share("fn", pos), "tp_rate": share("tp", pos)})


def operating_point(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Counts, precision (1 when nothing is flagged), recall, F1 and false-alarm rate."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    c = counts_at(df, threshold, by)
    c = c.withColumns({"precision": _ratio(tp, tp + fp, 1.0), "recall": _ratio(tp, tp + fn, 0.0), "false_alarm_rate": _ratio(fp, fp + tn, 0.0)})
    return c.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def classification_metrics(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 (0 on 0/0), macro F1 and accuracy; a group without both classes raises."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    c = counts_at(df, threshold, by)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn, 0.0), _ratio(2 * tn, 2 * tn + fp + fn, 0.0)
    both = (tp + fn > 0) & (tn + fp > 0)
    return c.select(
        *(by or []), F.when(both, _ratio(tp, tp + fp, 0.0)).otherwise(F.raise_error(F.lit("both classes are needed")).cast("double")).alias("precision"),
        _ratio(tp, tp + fn, 0.0).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"), ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
    )


def score_curve(df: DataFrame) -> DataFrame:
    """Each distinct score with pos, neg, and tp, fp of all scores at least as high, positives, negatives."""
    each = df.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    above = running_totals(each, [], [F.desc("p")], {"_tp": "pos", "_fp": "neg"})
    total = above.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    out = above.crossJoin(F.broadcast(total))
    return out.select("p", "pos", "neg", (F.col("_tp") + F.col("pos")).alias("tp"), (F.col("_fp") + F.col("neg")).alias("fp"), "positives", "negatives")


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score; recall is 0 where there are no positives."""
    c = score_curve(df)
    recall = _ratio(F.col("tp"), F.col("positives"), 0.0)
    return c.select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))


def roc_curve(df: DataFrame) -> DataFrame:
    return score_curve(df).select(F.col("p").alias("threshold"), (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"))


def ranking_metrics(df: DataFrame) -> DataFrame:
    """One row: average precision (steps over distinct scores) and tie-aware ROC-AUC."""
    c = score_curve(df)
    ap = F.sum(F.col("pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    below = F.col("negatives") - F.col("fp") + F.col("neg") / 2
    return c.agg(ap.alias("average_precision"), F.sum(F.col("pos") * below / F.col("positives") / F.col("negatives")).alias("roc_auc"))


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values of each group with their average rank (ties share it), by distributed running totals."""
    return weighted_ranks(df.withColumn("_w", F.lit(1)), value, by, "_w")


def weighted_ranks(df: DataFrame, value: str, by: list[str], weight: str) -> DataFrame:
    """As ``average_ranks``, for rows that stand for ``weight`` equal ones."""
    each = df.groupBy(*by, value).agg(F.sum(weight).alias("n"))
    done = running_totals(each, by, [value], {"before": "n"})
    return done.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman_by(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rows n and Spearman correlation in each group, null for two rows or fewer."""
    pairs = materialize(df.groupBy(by, x, y).agg(F.count("*").alias("_w")), "pairs")  # the narrow input is computed once
    rx, ry = (weighted_ranks(pairs, v, [by], "_w").withColumnRenamed("rank", r).hint("merge") for v, r in ((x, "_rx"), (y, "_ry")))
    rows = pairs.join(rx, [by, x]).join(ry, [by, y])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = rows.groupBy(by).agg(F.sum("_w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"))
    centred = rows.join(F.broadcast(sums), by)
    da, db = a - F.col("sa") / F.col("n"), b - F.col("sb") / F.col("n")
    m = centred.groupBy(by).agg(F.max("n").alias("n"), F.sum(w * da * db).alias("ab"), F.sum(w * da * da).alias("aa"), F.sum(w * db * db).alias("bb"))
    spread = F.sqrt(F.col("aa") * F.col("bb"))
    return m.select(by, "n", F.when((F.col("n") > 2) & (spread > 0), F.col("ab") / spread).alias("spearman"))


BOOTSTRAPPED = ("average_precision", "roc_auc", "precision", "recall", "f1", "macro_f1", "accuracy")


def _rng(*key: int | str) -> np.random.Generator:
    """The generator of one node or block; equal whenever it is asked for again."""
    return np.random.Generator(np.random.PCG64(zlib.crc32("|".join(map(str, key)).encode())))


def _dealt(path: pd.DataFrame, resamples: int, seed: int) -> np.ndarray:
    """How many of each resample's draws fall into one block: from the root of the tree of blocks on, a node deals its draws to its
    two halves by a binomial over their rows.  ``path`` holds the nodes above the block: level, node, rows, left_rows, went_right."""
    path = path.sort_values("level", ascending=False)
    draws = np.full(resamples, path["rows"].iloc[0], np.int64)
    for level, node, rows, left, right in path[["level", "node", "rows", "left_rows", "went_right"]].itertuples(index=False):
        if level:
            to_left = _rng(seed, "node", level, node).binomial(draws, left / rows)
            draws = draws - to_left if right else to_left
    return draws


def _drawn(cells: pd.DataFrame, block: int, draws: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws of a block dealt to its cells (cells x resamples), positives and negatives; equal whenever the block is drawn again."""
    counts = np.concatenate([cells["pos"].to_numpy(), cells["neg"].to_numpy()]).astype(float)
    weights = _rng(seed, "block", block).multinomial(draws, counts / counts.sum()).T
    return weights[: len(cells)], weights[len(cells) :]


def _paths(cells: DataFrame) -> DataFrame:
    """For each block the nodes of the binary tree over all blocks that lie above it, level 0 being the block itself."""
    sizes, seen = materialize_observed(cells.groupBy("block").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")), "bootstrap-blocks", F.max("block").alias("last"))
    levels = F.sequence(F.lit(0), F.lit(int(seen["last"] or 0).bit_length()))
    above = sizes.select("block", "n", F.explode(levels).alias("level")).select("block", "n", "level", F.expr("shiftright(block, level)").alias("node"))
    nodes = materialize(above.groupBy("level", "node").agg(F.sum("n").alias("rows")), "bootstrap-nodes")
    left = nodes.where("node % 2 = 0").select((F.col("level") + 1).alias("level"), (F.col("node") / 2).cast("long").alias("node"), F.col("rows").alias("left_rows"))
    path = above.drop("n").join(nodes.hint("merge"), ["level", "node"]).join(left.hint("merge"), ["level", "node"], "left")
    went_right = (F.col("level") > 0) & (F.expr("shiftright(block, level - 1)") % 2 == 1)
    return path.select("block", "level", "node", "rows", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), went_right.alias("went_right"))


def resampled_counts(df: DataFrame, threshold: float, resamples: int, seed: int = 0) -> DataFrame:
    """For each resample b: tp, fp, tn, fn at the threshold and the sums ``steps`` and ``below`` of the two ranking metrics.

    Each resample draws exactly as many rows as there are, with replacement, yet rows are never multiplied: they are counted by distinct
    score and label, the counts lie in blocks of ``CELLS`` scores in descending order, and a resample's draws are dealt down a binary tree
    over the blocks (binomials) and to the counts of a block (a multinomial), by generators that follow from seed and place.  One pass
    sums the draws of a block, a second adds the totals of the blocks before and draws the same again.
    """
    from gaugeframe.operators.ranking import distributed_rank

    each = df.groupBy("p").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    placed = distributed_rank(each.withColumn("down", -F.col("p")), [], ["down"], "at")
    cells = materialize(placed.select(F.floor(F.col("at") / CELLS).alias("block"), "at", "p", "pos", "neg"), "bootstrap-cells")

    def sums(key: tuple, pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        draws = _dealt(path, resamples, seed)
        pos, neg = _drawn(pdf.sort_values("at"), key[0], draws, seed)
        return pd.DataFrame({"block": key[0], "b": np.arange(resamples), "draws": draws, "pos": pos.sum(0), "neg": neg.sum(0)})

    dealt = cells.groupBy("block").cogroup(_paths(cells).groupBy("block"))
    blocks = dealt.applyInPandas(sums, "block long, b int, draws long, pos long, neg long")
    ahead = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", "b", "draws", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("pos", "neg")))
    before = materialize(before, "bootstrap-before")

    def metrics(key: tuple, pdf: pd.DataFrame, off: pd.DataFrame) -> pd.DataFrame:
        pdf, off = pdf.sort_values("at"), off.sort_values("b")
        pos, neg = _drawn(pdf, key[0], off["draws"].to_numpy(), seed)
        tp, fp = pos.cumsum(0) + off.pos.to_numpy(), neg.cumsum(0) + off.neg.to_numpy()
        hit = (pdf.p.to_numpy() >= threshold)[:, None]
        flagged = tp + fp
        steps = np.divide(pos * tp, flagged, out=np.zeros(pos.shape), where=flagged > 0)
        total = {"tp": (pos * hit).sum(0), "fp": (neg * hit).sum(0), "tn": (neg * ~hit).sum(0), "fn": (pos * ~hit).sum(0)}
        return pd.DataFrame({"b": np.arange(resamples), **total, "steps": steps.sum(0), "below": (pos * (fp - neg / 2.0)).sum(0)})

    schema = "b int, tp long, fp long, tn long, fn long, steps double, below double"
    part = cells.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(metrics, schema)
    return part.groupBy("b").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "steps", "below")))


def _by_metric(values: dict[str, Column], name: str) -> Column:
    """A row for each of the seven metrics: metric and its value."""
    return F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), values[k].cast("double").alias(name)) for k in BOOTSTRAPPED)))


def point_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """metric and point of the seven metrics."""
    wide = classification_metrics(df, threshold).crossJoin(F.broadcast(ranking_metrics(df)))
    return wide.select(_by_metric({k: F.col(k) for k in BOOTSTRAPPED}, "point"))


def bootstrap(df: DataFrame, threshold: float, resamples: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """metric, point, low, high, resamples, skipped of the seven metrics by the bootstrap (as many draws as rows); single-class resamples are skipped and counted."""
    each = resampled_counts(df, threshold, resamples, seed)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn, 0.0), _ratio(2 * tn, 2 * tn + fp + fn, 0.0)
    values = {
        "average_precision": F.col("steps") / pos, "roc_auc": 1 - F.col("below") / pos / neg, "precision": _ratio(tp, tp + fp, 0.0), "recall": tp / pos, "f1": f1,
        "macro_f1": (f1 + f0) / 2, "accuracy": (tp + tn) / (pos + neg),
    }
    tail = (1 - level) / 2
    used = each.where((pos > 0) & (neg > 0)).select(_by_metric(values, "v"))
    spread = used.groupBy("metric").agg(F.percentile("v", tail).alias("low"), F.percentile("v", 1 - tail).alias("high"), F.count("*").alias("resamples"))
    return point_metrics(df, threshold).join(F.broadcast(spread), "metric", "left").select(
        "metric", "point", "low", "high", F.coalesce("resamples", F.lit(0)).alias("resamples"), (F.lit(resamples) - F.coalesce("resamples", F.lit(0))).alias("skipped")
    )


def similarity_buckets(df: DataFrame, edges: list[float], value: str = "similarity") -> DataFrame:
    """Add bucket (number) and bounds lo, hi of the left-closed buckets, the last one open; values below the first edge go."""
    bounds = df.sparkSession.createDataFrame([(i, lo, edges[i + 1] if i + 1 < len(edges) else None) for i, lo in enumerate(edges)], "bucket int, lo double, hi double")
    rows = df.withColumn("bucket", bin_index(F.col(value), edges) - 1)
    return rows.join(F.broadcast(bounds), "bucket")


def bucket_metrics(df: DataFrame, edges: list[float]) -> DataFrame:
    """Defective rows, errors, misses and false alarms of each similarity bucket that has rows."""
    wrong = ~F.col("correct")
    g = similarity_buckets(df, edges).groupBy("lo", "hi").agg(
        F.count("*").alias("n"), F.sum("label").alias("n_defective"), F.count_if(wrong).alias("errors"), F.count_if(wrong & (F.col("label") == 1)).alias("missed"), F.count_if(wrong & (F.col("label") == 0)).alias("false_alarms")
    )
    return g.withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 4))


def quartile_errors(df: DataFrame, value: str = "brightness") -> DataFrame:
    """Rows and errors of each quartile; a value equal to a cut belongs to the lower one."""
    cuts = exact_quantiles(df, value, [0.25, 0.5, 0.75]).withColumnRenamed("quantiles", "cuts")
    q = 1 + F.size(F.filter("cuts", lambda c: c < F.col(value)))
    return df.crossJoin(F.broadcast(cuts)).groupBy(q.alias("quartile")).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("errors"))


def reliability_bins(df: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins (empty ones too): n, mean p, share of positives."""
    inner = [i / bins for i in range(1, bins)]
    # a bin that can't be null: else the join's null filter is pushed below the grouping and computes p once for each edge
    at = F.coalesce(bin_index(F.col("p"), inner), F.lit(-1)).alias("bin")
    g = df.groupBy(at).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("share"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(g), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_p", F.lit(0.0)).alias("mean_p"), F.coalesce("share", F.lit(0.0)).alias("share"))


def expected_calibration_error(df: DataFrame, bins: int) -> DataFrame:
    return reliability_bins(df, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def _loss(margin: Column, temperature: Column | float) -> Column:
    """-ln sigmoid(margin / T) of the signed margin, in the branch that cannot overflow."""
    x = margin / temperature
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def signed_margin() -> Column:
    return F.when(F.col("label") == 1, F.col("margin")).otherwise(-F.col("margin"))


def nll(df: DataFrame, temperature: float) -> DataFrame:
    return df.agg(F.avg(_loss(signed_margin(), temperature)).alias("nll"))


def is_separable(df: DataFrame) -> DataFrame:
    pos, neg = F.min(F.when(F.col("label") == 1, F.col("margin"))), F.max(F.when(F.col("label") == 0, F.col("margin")))
    return df.agg(F.coalesce(pos > neg, F.lit(False)).alias("separable"))


def fit_temperature(df: DataFrame, rounds: int = ROUNDS) -> float:
    """The temperature of least mean loss, on a grid in ln T that each round narrows around its best point.

    A round is one aggregation over counted margins and grid points; the best point alone returns.
    """
    from math import exp, log

    each = materialize(df.groupBy(signed_margin().alias("m")).agg(F.count("*").alias("n")), "margins")
    low, high, best = log(LOW_T), log(HIGH_T), 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        tried = each.select("m", "n", F.posexplode(F.array(*(F.lit(exp(t)) for t in grid))).alias("i", "t"))
        loss = tried.groupBy("i").agg(F.sum(F.col("n") * _loss(F.col("m"), F.col("t"))).alias("loss"))
        i = loss.agg(F.min(F.struct("loss", "i")).alias("s")).first()["s"]["i"]
        best = exp(grid[i])
        low, high = grid[max(i - 1, 0)], grid[min(i + 1, GRID - 1)]
    drop_written(each)
    return best


def choose_temperature(df: DataFrame) -> DataFrame:
    """One row: temperature and a note; separable margins keep 1, a fit at a bound is noted."""
    if is_separable(df).first()[0]:
        return df.sparkSession.createDataFrame([(1.0, "separable")], "temperature double, note string")
    t = fit_temperature(df)
    note = "at a bound" if t < LOW_T * 1.01 or t > HIGH_T / 1.01 else ""
    return df.sparkSession.createDataFrame([(float(t), note)], "temperature double, note string")


def margin_threshold(df: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: the logit midpoint of the candidate (column ``candidate``) and the next lower score, or the candidate itself."""
    lower = df.crossJoin(F.broadcast(candidate)).where(F.col("p") < F.col("candidate")).groupBy("candidate").agg(F.max("p").alias("lower"))
    both = candidate.join(lower, "candidate", "left")
    middle = sigmoid((logit(F.col("candidate")) + logit(F.col("lower"))) / 2)
    return both.select(F.when(F.col("lower").isNull(), F.col("candidate")).otherwise(middle).alias("threshold"))


def _reached(candidate: Column, asked: str) -> Column:
    """The candidate, or an error where no threshold gives it."""
    return F.when(candidate.isNotNull(), candidate).otherwise(F.raise_error(F.lit(f"no threshold reaches {asked}")).cast("double"))


def threshold_for_recall(df: DataFrame, recall: float, curve: DataFrame | None = None) -> DataFrame:
    """Best precision with at least ``recall``, of ties the lowest threshold, moved to the margin.

    Raises if ``recall`` > 1, and in the query where no threshold reaches it (no positives).  ``curve`` is the table's
    ``pr_curve``, if it is at hand.
    """
    if recall > 1:
        raise ValueError("no threshold reaches a recall above 1")
    c = (pr_curve(df) if curve is None else curve).where((F.col("recall") >= recall) & (F.col("recall") > 0))
    c = c.agg(F.max(F.struct("precision", (-F.col("threshold")).alias("t"))).alias("s"))
    return margin_threshold(df, c.select(_reached(-F.col("s.t"), f"a recall of {recall}").alias("candidate")))


def f1_optimal_threshold(df: DataFrame, curve: DataFrame | None = None) -> DataFrame:
    """The threshold of the largest F1, of ties the lowest."""
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    return (pr_curve(df) if curve is None else curve).agg(F.max_by("threshold", F.struct(f1.alias("f1"), -F.col("threshold"))).alias("threshold"))


def threshold_for_precision(df: DataFrame, precision: float, floor: float, curve: DataFrame | None = None) -> DataFrame:
    """The lowest threshold of at least ``floor`` with the precision, else the larger of floor and the highest score."""
    hit = (F.col("precision") >= precision) & (F.col("threshold") >= floor)
    return (pr_curve(df) if curve is None else curve).agg(F.coalesce(F.min(F.when(hit, F.col("threshold"))), F.greatest(F.max("threshold"), F.lit(floor))).alias("threshold"))


def max_threshold_with_recall(df: DataFrame, recall: float, curve: DataFrame | None = None) -> DataFrame:
    """The highest threshold with at least ``recall``, moved to the margin; raises in the query where none reaches it."""
    c = (pr_curve(df) if curve is None else curve).where(F.col("recall") > 0)
    c = c.agg(F.max(F.when(F.col("recall") >= recall, F.col("threshold"))).alias("candidate"))
    return margin_threshold(df, c.select(_reached(F.col("candidate"), f"a recall of {recall}").alias("candidate")))


def review_band(df: DataFrame, threshold: float, low_recall: float, high_precision: float, curve: DataFrame | None = None) -> DataFrame:
    """One row: low and high of the band, which holds ``threshold``."""
    low = max_threshold_with_recall(df, low_recall, curve).select(F.least("threshold", F.lit(threshold)).alias("low"))
    high = threshold_for_precision(df, high_precision, threshold, curve).select(F.col("threshold").alias("high"))
    return low.crossJoin(F.broadcast(high))


def band_summary(df: DataFrame, threshold: float, low: float, high: float) -> DataFrame:
    """One row: rows, those in review, errors, errors in review, and errors decided without review by kind."""
    p, wrong = F.col("p"), (F.col("p") >= threshold).cast("int") != F.col("label")
    review = (p >= low) & (p < high)
    return df.agg(
        F.count("*").alias("n"), F.count_if(review).alias("reviewed"), (F.count_if(review) / F.count("*")).alias("review_share"), F.count_if(wrong).alias("errors"),
        F.count_if(wrong & review).alias("errors_caught"), F.count_if(wrong & ~review).alias("auto_errors"),
        F.count_if((F.col("label") == 1) & (p < low)).alias("missed_auto_passed"), F.count_if((F.col("label") == 0) & (p >= high)).alias("alarms_auto_rejected"),
    )


def cost_table(
    df: DataFrame, thresholds: dict[str, float], chosen: str, low: float, high: float, miss: float = 20.0, alarm: float = 1.0, review: float = 0.25
) -> DataFrame:
    """policy and cost for 1000 rows of each threshold alone, and of the ``chosen`` one with the review band (reviewed rows are decided rightly)."""
    p, pos = F.col("p"), F.col("label") == 1
    alone = lambda t: 1000 * (miss * F.count_if(pos & (p < t)) + alarm * F.count_if(~pos & (p >= t))) / F.count("*")
    review_n = F.count_if((p >= low) & (p < high))
    band = 1000 * (miss * F.count_if(pos & (p < low)) + alarm * F.count_if(~pos & (p >= high)) + review * review_n) / F.count("*")
    rows = [F.struct(F.lit(name).alias("policy"), F.col(f"c{i}").alias("cost")) for i, name in enumerate([*thresholds, f"{chosen}+review_band"])]
    costs = df.agg(*(alone(t).alias(f"c{i}") for i, t in enumerate(thresholds.values())), band.alias(f"c{len(thresholds)}"))
    return costs.select(F.inline(F.array(*rows)))


def point_table(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row for each named threshold: its operating point."""
    out = None
    for name, t in thresholds.items():
        one = operating_point(df, t).select(F.lit(name).alias("point"), F.lit(t).alias("threshold"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "false_alarm_rate")
        out = one if out is None else out.unionByName(one)
    return out


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    c = df.groupBy("label").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def feature_histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    index = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy("label", index.alias("bin")).agg(F.count("*").alias("n"))


def shortcut_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Class means, Cohen's d (unweighted mean of the sample variances) and the feature's own separability max(AUC, 1 - AUC)."""
    stacked = df.select("label", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("s")).select("label", "s.feature", "s.v")
    one = lambda agg, k: agg(F.when(F.col("label") == k, F.col("v")))
    moments = stacked.groupBy("feature").agg(one(F.avg, 1).alias("m1"), one(F.avg, 0).alias("m0"), one(F.var_samp, 1).alias("v1"), one(F.var_samp, 0).alias("v0"))
    ranked = stacked.join(average_ranks(stacked, "v", ["feature"]).hint("merge"), ["feature", "v"])
    n1, n0 = F.sum("label"), F.sum(1 - F.col("label"))
    auc = ranked.groupBy("feature").agg(((F.sum(F.when(F.col("label") == 1, F.col("rank"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))
    d = (F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return moments.join(F.broadcast(auc), "feature").select(
        "feature", F.round("m1", 3).alias("mean_defective"), F.round("m0", 3).alias("mean_normal"), F.round(d, 3).alias("cohens_d"), F.round(F.greatest("auc", 1 - F.col("auc")), 3).alias("separability")
    )


def error_table(df: DataFrame) -> DataFrame:
    """Misclassified rows tagged FN or FP, by split, kind and p."""
    kind = F.when(F.col("label") == 1, "FN").otherwise("FP")
    return df.where(~F.col("correct")).select("id", "split", kind.alias("error_type"), "p").orderBy("split", "error_type", "p", "id")


def sample_correct(df: DataFrame, k: int, seed: int) -> DataFrame:
    """At most k correct rows of each split and label, by the MD5 of seed and id."""
    order = Window.partitionBy("split", "label").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id")).cast("binary")), "id")
    return df.where("correct").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("split", "label", "id")


def explain_cases(df: DataFrame, k: int = 2) -> DataFrame:
    """The k worst misses of the test split and the k worst false alarms of the external one."""
    fn = df.where("not correct and label = 1 and split = 'test'").orderBy("p", "id").limit(k).select(F.lit("FN").alias("kind"), "split", "id", "p")
    fp = df.where("not correct and label = 0 and split = 'external_test'").orderBy(F.desc("p"), "id").limit(k).select(F.lit("FP").alias("kind"), "split", "id", "p")
    return fn.unionByName(fp)


def parity(a: DataFrame, b: DataFrame, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """One row: rows compared, largest difference, the share of atol + rtol * |a| that the worst one uses, and whether none uses more than all."""
    both = a.select("id", F.col("z").alias("x")).join(b.select("id", F.col("z").alias("y")), "id")
    off = F.abs(F.col("x") - F.col("y"))
    used = F.max(off / (atol + rtol * F.abs("x")))
    return both.agg(F.count("*").alias("n"), F.max(off).alias("max_abs"), used.alias("used"), (used <= 1).alias("passed"))


def compare_scorers(df: DataFrame, threshold: float) -> DataFrame:
    """A row for each scorer of a table of p and p_other: its metrics, its largest difference from p and the decisions that it changes."""
    other = df.withColumn("p", F.col("p_other"))
    off = df.agg(F.max(F.abs(F.col("p") - F.col("p_other"))).alias("max_dp"), F.count_if((F.col("p") >= threshold) != (F.col("p_other") >= threshold)).alias("decisions_changed"))
    none = off.select(F.lit(0.0).alias("max_dp"), F.lit(0).cast("long").alias("decisions_changed"))
    out = None
    for name, rows, change in (("p", df, none), ("p_other", other, off)):
        one = ranking_metrics(rows).crossJoin(F.broadcast(operating_point(rows, threshold).select("precision", "recall", "f1"))).crossJoin(F.broadcast(change))
        one = one.select(F.lit(name).alias("scorer"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def epoch_trace(history: DataFrame, patience: int) -> DataFrame:
    """Each epoch with whether it is the best so far (larger PR-AUC, then smaller loss), epochs since, and whether fine-tuning stops there."""
    order = Window.partitionBy("run").orderBy(F.desc("stage"), "epoch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct("val_pr_auc", (-F.col("val_loss")).alias("neg_loss"))
    rows = history.withColumn("better", F.coalesce(key > F.max(key).over(before), F.lit(True)))
    stage = Window.partitionBy("run", "stage").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("island", F.sum(F.col("better").cast("int")).over(stage))
    since = F.row_number().over(Window.partitionBy("run", "stage", "island").orderBy("epoch"))
    rows = rows.withColumn("since", F.when(F.col("island") == 0, since).otherwise(since - 1))
    return rows.select("run", "stage", "epoch", "better", "since", ((F.col("stage") == "finetune") & (F.col("since") >= patience)).alias("stop"))


def best_epochs(history: DataFrame) -> DataFrame:
    """Of each run the epoch with the largest (PR-AUC, -loss)."""
    key = F.struct("val_pr_auc", -F.col("val_loss"), F.col("stage"), F.col("epoch"))
    best = history.groupBy("run").agg(F.max_by(F.struct("stage", "epoch", "val_pr_auc"), key).alias("s"))
    return best.select("run", "s.stage", "s.epoch", "s.val_pr_auc")
