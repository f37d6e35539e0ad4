"""Anomaly baseline on separate splits: memory bank, threshold and one report.

The bank is a coreset of sampled patches of the normal *training* images; the
threshold is chosen on the validation images; test images are only scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import metrics as m
from gaugeframe.operators import similarity as sim
from gaugeframe.sources.scratch import materialize

TRAIN, VAL = "train", "val"


def fit_bank(images: DataFrame, *, patches_an_image: int, size: int, dims: int, seed: int) -> dict:
    """bank (id, patch, v), pool (sampled patches) and radius (how far a pool patch lies from the bank at most).

    ``images`` has id, fine, label and split; only rows of the training split with label 0 are read.  Distances of the choice are
    taken after a random projection to ``dims`` dimensions, the bank keeps whole vectors.
    """
    normal = images.where((F.col("split") == TRAIN) & (F.col("label") == 0)).select("id", "fine")
    pool = materialize(sim.sample_patches(sim.patches(normal), patches_an_image, seed), "sampled-patches")
    bank = materialize(sim.coreset(pool, size, dims=dims), "bank")
    return {"bank": bank, "pool": pool.count(), "radius": sim.covering_radius(pool, bank)}


def anomaly_report(images: DataFrame, fitted: dict, recall: float) -> DataFrame:
    """One row for the validation split and for each test split: n, threshold, metrics at it, ROC-AUC, average precision, and the fit's sizes.

    The threshold is the validation split's for ``recall``; scores s count as s / (1 + s), which keeps their order.
    """
    held = images.where(F.col("split") != TRAIN).select("id", "fine", F.col("label").cast("int").alias("label"), "split")
    scores = sim.anomaly_scores(held, fitted["bank"]).withColumn("p", F.col("score") / (1 + F.col("score")))
    rows = materialize(held.select("id", "label", "split").join(scores.hint("merge"), "id"), "anomaly-scores")
    threshold = m.threshold_for_recall(rows.where(F.col("split") == VAL), recall).first()[0]
    out = rows.groupBy("split").agg(F.count("*").alias("n")).join(F.broadcast(m.classification_metrics(rows, threshold, ["split"])), "split")
    names = [r[0] for r in rows.select("split").distinct().collect()]  # a few splits
    ranked = [m.ranking_metrics(rows.where(F.col("split") == s)).withColumn("split", F.lit(s)) for s in sorted(names)]
    together = ranked[0]
    for r in ranked[1:]:
        together = together.unionByName(r)
    fit = {"threshold": threshold, "patch_pool": fitted["pool"], "memory_bank": fitted["bank"].count(), "covering_radius": fitted["radius"]}
    return out.join(F.broadcast(together), "split").withColumns({k: F.lit(v) for k, v in fit.items()})
