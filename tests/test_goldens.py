"""Hand-computed results of single operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import arrays as ar
from gaugeframe.functions import scores as sc
from gaugeframe.operators import evaluation as ev, graph, inventory as inv, metrics as m, similarity as sim, splits as sp
from gaugeframe.operators.ranking import distributed_rank, exact_quantiles
from gaugeframe.sources import images as im
from gaugeframe.sources.scratch import materialize
from gaugeframe.streaming import monitor as mo
from gaugeframe.functions.arrays import orientation_maps

# A small scored table whose results are known by hand.
LABELS = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
SCORES = [0.9, 0.8, 0.7, 0.3, 0.6, 0.2, 0.1, 0.1, 0.05, 0.0]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(str(i), y, p) for i, (y, p) in enumerate(zip(LABELS, SCORES))], "id string, label int, p double")


def one(df):
    return df.first().asDict()


def test_exact_duplicates(spark):
    rows = [("a", "s1", 1, "train"), ("b", "s1", 1, "test"), ("c", "s2", 0, "train"), ("d", "s2", 1, "train")]
    df = spark.createDataFrame(rows, "rel_path string, sha256 string, label int, source_split string")
    got = {r.rel_path: r.exclude_reason for r in sp.exact_duplicate_reasons(df).collect()}
    assert got == {"a": sp.DUPLICATE, "b": "", "c": sp.CONFLICT, "d": sp.CONFLICT}


def test_allocation_shares(spark):
    df = spark.createDataFrame([(f"c{i}", 1, i % 2) for i in range(200)], "cluster_id string, n long, majority int")
    got = {(r.split, r.majority): r["count"] for r in sp.allocate_clusters(df, [("train", 0.8), ("val", 0.2)], 42).groupBy("split", "majority").count().collect()}
    assert got == {("train", 0): 80, ("val", 0): 20, ("train", 1): 80, ("val", 1): 20}


def test_paths(spark):
    df = spark.createDataFrame([("Validation/ok/a.png",), ("casting/train/ok/a.JPG",), ("ok/a",), ("b.txt",)], "p string")
    got = [tuple(r) for r in df.select(inv.detect_split(F.col("p")), inv.class_dir(F.col("p")), inv.is_image(F.col("p"))).collect()]
    assert got == [("val", "ok", True), ("train", "ok", True), ("(none)", "ok", False), ("(none)", "(none)", False)]


def test_strategy(spark):
    df = spark.createDataFrame([("train",), ("test",)], "source_split string")
    assert inv.resolve_strategy(df, "auto").first()[0] == "official"
    assert inv.resolve_strategy(df, "random").first()[0] == "random"
    assert inv.resolve_strategy(df.where("source_split = 'train'"), "auto").first()[0] == "random"
    with pytest.raises(Exception, match="no test folder"):
        inv.resolve_strategy(df.where("source_split = 'train'"), "official").collect()


def test_unmapped_classes_raise(spark):
    df = spark.createDataFrame([("x", "odd")], "rel_path string, class_dir string")
    known = spark.createDataFrame([("ok", "normal")], "class_dir string, class_name string")
    with pytest.raises(Exception, match="unmapped class folders: odd"):
        inv.resolve_classes(df, known).collect()
    assert inv.resolve_classes(df.limit(0), known).count() == 0 and inv.resolve_classes(df, known, strict=False).count() == 0


def test_set_fingerprint(spark):
    a = spark.createDataFrame([("b",), ("a",)], "sha256 string")
    b = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    assert inv.set_fingerprint(a).first() == inv.set_fingerprint(b).first()
    assert inv.set_fingerprint(a.limit(0)).first()[0] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_confusion_and_ranking(scored):
    c = one(m.confusion(scored, 0.5))
    assert (c["tn"], c["fp"], c["fn"], c["tp"], c["fn_rate"], c["tp_rate"]) == (5, 1, 1, 3, 0.25, 0.75)
    r = one(m.ranking_metrics(scored))
    assert r["average_precision"] == pytest.approx(0.95) and r["roc_auc"] == pytest.approx(23 / 24)
    k = one(m.classification_metrics(scored, 0.5))
    assert k["f1"] == pytest.approx(6 / 8) and k["macro_f1"] == pytest.approx((6 / 8 + 10 / 12) / 2)


def test_operating_point_without_flags(scored):
    p = one(m.operating_point(scored, 0.99))
    assert (p["precision"], p["recall"], p["f1"]) == (1.0, 0.0, 0.0)
    assert one(m.classification_metrics(scored, 0.99))["precision"] == 0.0


def test_one_class_raises(scored):
    with pytest.raises(Exception, match="both classes"):
        m.classification_metrics(scored.where("label = 1"), 0.5).collect()


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.8), ("c", 0, 0.3), ("d", 0, 0.2)], "id string, label int, p double")
    logit = lambda x: math.log(x / (1 - x))
    want = 1 / (1 + math.exp(-(logit(0.3) + logit(0.8)) / 2))
    assert m.threshold_for_recall(df, 0.99).first()[0] == pytest.approx(want)
    lone = spark.createDataFrame([(0.4,)], "candidate double")
    assert m.margin_threshold(spark.createDataFrame([(0.4,), (0.7,)], "p double"), lone).first()[0] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        m.threshold_for_recall(df, 1.01)
    for ask in (lambda d: m.threshold_for_recall(d, 0.9), lambda d: m.max_threshold_with_recall(d, 0.9)):
        with pytest.raises(Exception, match="no threshold reaches"):
            ask(df.where("label = 0")).collect()
    with pytest.raises(Exception, match="no threshold reaches"):
        m.max_threshold_with_recall(df, 1.5).collect()


def test_cost(spark):
    rows = [(str(i), int(i < 50), 0.9 if i < 49 else 0.05 if i == 49 else 0.95 if i < 53 else 0.45 if i < 57 else 0.1) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, label int, p double")
    got = {r.policy: r.cost for r in m.cost_table(df, {"chosen": 0.5}, "chosen", 0.4, 0.5).collect()}
    assert got["chosen+review_band"] == pytest.approx(240.0) and set(got) == {"chosen", "chosen+review_band"}


def test_decide(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.9,)], "p double")
    got = [tuple(r) for r in sc.decide(df, 0.4, 0.2, 0.7).select("predicted", "needs_review", F.round("confidence", 6)).collect()]
    assert got == [(0, False, 0.9), (0, True, 0.7), (1, True, 0.5), (1, False, 0.9)]


def test_calibrated_probability(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (1000.0, -1000.0)], "a double, b double")
    got = [r[0] for r in df.select(sc.calibrated_probability(F.col("a"), F.col("b"), 2.0)).collect()]
    assert got == pytest.approx([0.5, 1 / (1 + math.exp(-1)), 0.0])


def test_planted_temperature(spark):
    rng = np.random.default_rng(3)
    margin = rng.normal(0, 2, 20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-margin))).astype(int)
    df = spark.createDataFrame([(int(y), float(round(3 * x, 4))) for y, x in zip(label, margin)], "label int, margin double")
    t = m.fit_temperature(df)
    loss = lambda x: m.nll(df, x).first()[0]
    assert t == pytest.approx(3.0, rel=0.06) and loss(t) <= min(loss(t * 1.001), loss(t / 1.001))


def test_separable_keeps_one(spark):
    df = spark.createDataFrame([(1, 2.0), (0, -1.0)], "label int, margin double")
    assert tuple(m.choose_temperature(df).first()) == (1.0, "separable")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    assert {r.label: r.weight for r in m.class_weights(df).collect()} == pytest.approx({0: 40 / 60, 1: 40 / 20})


def test_bins_keep_empty(spark):
    df = spark.createDataFrame([(str(i), 1, p) for i, p in enumerate((0.05, 0.15, 0.5, 0.95, 0.99))], "id string, label int, p double")
    bins = {r.bin: r for r in m.reliability_bins(df, 10).collect()}
    assert sum(b.n for b in bins.values()) == 5 and len(bins) == 10 and bins[9].mean_p == pytest.approx(0.97)


def test_orientations_are_distinct():
    maps = orientation_maps(4)
    assert len({tuple(x) for x in maps}) == 8 and maps[0] == list(range(16))


def test_standardize_affine(spark):
    df = spark.createDataFrame([([float(i * i % 7) for i in range(16)],)], "a array<double>")
    b = F.transform("a", lambda x: x * 0.5 + 40)
    assert df.select(ar.dot(ar.standardize(F.col("a")), ar.standardize(b))).first()[0] > 0.9999


def test_turned_copies_are_found(spark):
    rng = np.random.default_rng(1)
    base = rng.random((12, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + k, base[0][mp].tolist()) for k, mp in enumerate(orientation_maps(8)) if k]
    df = spark.createDataFrame(rows, "id long, fine array<double>")
    got = sim.top_matches(df.where("id = 0"), df, 8, same_set=True).where("corr > 0.999").collect()
    assert {r.target for r in got} == {100 + k for k in range(1, 8)} and all(r.via_transform for r in got)


def test_nearest_without_targets(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(64)])], "id long, fine array<double>")
    assert sim.nearest_similarity(df, df, same_set=True).first().nearest == -1.0


def test_components_and_numbers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], "src long, dst long")
    found = graph.connected_components(edges)
    assert {(r.id, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    got = {r.id: r.cluster_id for r in sp.number_clusters(found).collect()}
    assert got == {1: "g00000", 2: "g00000", 3: "g00000", 8: "g00001", 9: "g00001"}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(edges).agg(F.count_distinct("component"), F.max("component"), F.count("*")).first() == (1, 0, 301)


def test_coreset_covers():
    points = np.array([[0.0], [0.1], [0.2], [5.0], [10.0]])
    keep = points[sim.farthest_first(points, 3)]
    assert np.abs(points - keep.T).min(axis=1).max() <= 0.2


def test_distributed_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = distributed_rank(df, ["g"], ["v"]).collect()
    assert all(r["rank"] == r.v // 3 for r in got) and len(got) == 500


def test_checksum_problems(spark):
    good = "a" * 64
    lines = spark.createDataFrame([(f"{good}  x",), (f"{'b' * 64}  y",), (f"{good}  gone",), ("nonsense",), (f"{good}  ../x",)], "line string")
    files = spark.createDataFrame([("x", good), ("y", good)], "rel_path string, sha256 string")
    got = {r.problem for r in inv.verify_checksums(lines, files).collect()}
    assert got == {"mismatch", "missing file", "malformed line", "unsafe name"}
    odd = spark.createDataFrame([(f"{good}  a\\b",), (f"{good}  .hidden",), (f"{good}  a/b",)], "line string")
    assert [r.problem for r in inv.verify_checksums(odd, files).collect()] == ["unsafe name"] * 3
    assert [r.problem for r in inv.verify_checksums(lines.limit(0), files).collect()] == ["missing manifest"]


def test_sniff(spark):
    magic = [("FFD8FFE0", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("424D00", "BMP"), ("52494646000000005745425056", "WEBP"), ("474946383961", None), ("", None)]
    df = spark.createDataFrame([(bytearray.fromhex(x),) for x, _ in magic], "c binary")
    assert [r[0] for r in df.select(inv.sniff_format(F.col("c"))).collect()] == [y for _, y in magic]


def test_bootstrap_against_a_plain_one(spark):
    rng = np.random.default_rng(8)
    label = (rng.random(600) < 0.4).astype(int)
    score = np.round(np.clip(0.35 + 0.3 * label + rng.normal(0, 0.2, 600), 0, 1), 2)
    df = spark.createDataFrame([(str(i), int(y), float(p)) for i, (y, p) in enumerate(zip(label, score))], "id string, label int, p double")
    got = {r.metric: r for r in m.bootstrap(df, 0.5, 400).collect()}
    assert set(got) == set(m.BOOTSTRAPPED) and all(r.resamples + r.skipped == 400 for r in got.values())

    def metrics(y, p):
        order = np.argsort(-p, kind="stable")
        values = np.unique(p)[::-1]
        tp, fp = (np.array([((p >= v) & (y == k)).sum() for v in values]) for k in (1, 0))
        step = np.diff(np.concatenate([[0], tp]))
        below = np.array([((p < v) & (y == 0)).sum() + ((p == v) & (y == 0)).sum() / 2 for v in values])
        hit = p >= 0.5
        a, b, c, d = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
        f1, f0 = 2 * a / (2 * a + b + c), 2 * d / (2 * d + b + c)
        del order
        return dict(average_precision=(step * tp / (tp + fp)).sum() / tp[-1], roc_auc=(step * below).sum() / tp[-1] / fp[-1], precision=a / (a + b), recall=a / (a + c), f1=f1, macro_f1=(f1 + f0) / 2, accuracy=(a + d) / len(y))

    point = metrics(label, score)
    plain = [metrics(label[i], score[i]) for i in (rng.integers(0, 600, 600) for _ in range(300))]
    for name, r in got.items():
        assert r.point == pytest.approx(point[name], abs=1e-9)
        low, high = np.quantile([x[name] for x in plain], [0.025, 0.975])
        assert abs(r.low - low) < 0.3 * (high - low) and abs(r.high - high) < 0.3 * (high - low)


def test_bootstrap_blocks_are_one_curve(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(str(i), int(i % 3 == 0), float(p)) for i, p in enumerate(rng.random(50))], "id string, label int, p double")
    monkeypatch.setattr(m, "CELLS", 7)
    rows = m.resampled_counts(df, 0.5, 3).toPandas()
    cells = sorted(((r.p, r.label) for r in df.collect()), reverse=True)
    paths = m._paths(spark.createDataFrame([(i // 7, 1, 0) for i in range(50)], "block long, pos long, neg long")).toPandas()
    dealt = [m._dealt(paths[paths.block == block], 3, 0) for block in range(8)]
    assert (np.sum(dealt, axis=0) == 50).all() and len({tuple(x) for x in dealt}) > 1
    assert (rows.tp + rows.fp + rows.tn + rows.fn == 50).all()  # as many draws as rows, in every resample
    for b in range(3):
        tp = fp = steps = below = 0.0
        for at in range(0, 50, 7):
            pdf = pd.DataFrame({"pos": [y for _, y in cells[at : at + 7]], "neg": [1 - y for _, y in cells[at : at + 7]]})
            pos, neg = (w[:, b] for w in m._drawn(pdf, at // 7, dealt[at // 7], 0))
            for x, y in zip(pos, neg):
                tp, fp = tp + x, fp + y
                steps += x * tp / (tp + fp) if tp + fp else 0
                below += x * (fp - y / 2)
        r = rows[rows.b == b].iloc[0]
        assert (r.tp + r.fn, r.fp + r.tn) == (tp, fp) and r.steps == pytest.approx(steps) and r.below == pytest.approx(below)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 101)] + [("b", float(x)) for x in rng.random(40)] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantiles for r in exact_quantiles(df, "v", [0.0, 0.33, 0.5, 0.95, 1.0], ["g"]).collect()}
    assert set(got) == {"a", "b", "d"}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for k, v in rows if k == g], [0.0, 0.33, 0.5, 0.95, 1.0]).tolist())
    every = exact_quantiles(df, "v", [0.5]).first()[0]
    assert every == pytest.approx([np.quantile([v for _, v in rows if v is not None], 0.5)])


def test_saturated_scores_and_scores_outside_the_unit_interval(spark):
    df = spark.createDataFrame([(str(i), int(i % 2), [0.0, 1.0, 1.0, -3.5, 7.25][i % 5]) for i in range(100)], "id string, label int, p double")
    curve = {r.threshold: r for r in m.pr_curve(df).collect()}
    assert set(curve) == {-3.5, 0.0, 1.0, 7.25} and curve[-3.5].recall == 1.0 and curve[-3.5].precision == 0.5


def test_one_evaluation(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", k % 2, 0.9 if k % 2 else 0.1, "test" if k < 20 else "external_test", 0.9 + k % 10 / 100) for k in range(40)], "id string, label int, p double, split string, similarity double")
    folder = f"file://{tmp_path}/run"
    audit = ev.store_audit(rows, folder)
    once = lambda r, a=audit, t=0.5, **more: ev.evaluate_once(r, a, folder, t, 0.3, 0.7, resamples=20, **more)
    with pytest.raises(ValueError, match="did not pass"):
        once(rows, ev.audit_of(rows, passed=False))
    with pytest.raises(ValueError, match="differ"):
        once(rows.where("id != 'i3'"))
    assert not list(tmp_path.glob("run/TEST_*"))  # a refusal claims nothing
    assert {r.split: r.f1 for r in once(rows).collect()} == {"test": 1.0, "external_test": 1.0}
    with pytest.raises(ValueError, match="used once"):
        once(rows, resume=True)
    results = {(r.split, r.part, r.key, r.metric): r for r in spark.read.parquet(f"{folder}/test_results").collect()}
    assert results["test", "size", "", "n"].value == 20 and results["test", "at_operating_threshold", "", "roc_auc"].low == 1.0
    assert results["test", "by_similarity_to_train", "0.95", "n"].value == 4 and results["test", "review_band", "", "reviewed"].value == 0
    assert spark.read.parquet(f"{folder}/test_predictions").where("correct").count() == 40


def test_an_evaluation_is_claimed_before_it_runs(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"i{k}", k % 2, k / 40, "test") for k in range(40)], "id string, label int, p double, split string")
    folder = f"file://{tmp_path}/run"
    audit = ev.store_audit(rows, folder)
    broken = monkeypatch.context()
    with broken as b:
        b.setattr(ev, "evaluation_parts", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ev.evaluate_once(rows, audit, folder, 0.5, 0.3, 0.7)
    with pytest.raises(ValueError, match="claimed"):
        ev.evaluate_once(rows, audit, folder, 0.5, 0.3, 0.7)  # as a second run meanwhile would find it
    with pytest.raises(ValueError, match="other"):
        ev.evaluate_once(rows, audit, folder, 0.6, 0.3, 0.7, resume=True)
    assert ev.evaluate_once(rows, audit, folder, 0.5, 0.3, 0.7, resamples=20, resume=True).first().n == 40


def test_stored_audit_finds_what_is_wrong(spark, tmp_path):
    rows = [("a", 0, 0.1, "test"), ("b", 1, 0.9, "test"), ("c", 0, 0.2, "external_test"), ("d", 1, 0.8, "external_test")]
    kinds = "id string, label int, p double, split string"
    good = ev.store_audit(spark.createDataFrame(rows, kinds), f"file://{tmp_path}/1").collect()
    twice = ev.store_audit(spark.createDataFrame([*rows, ("a", 0, 0.1, "external_test")], kinds), f"file://{tmp_path}/2").collect()
    single = ev.store_audit(spark.createDataFrame(rows[:3], kinds), f"file://{tmp_path}/3").collect()
    assert all(r.passed for r in good) and not any(r.passed for r in (*twice, *single))


def test_release_is_written_once(spark, tmp_path):
    z = spark.createDataFrame([("a", 1.0), ("b", -30.0)], "id string, z double")
    off = spark.createDataFrame([("a", 1.0), ("b", -30.002)], "id string, z double")
    metrics = spark.createDataFrame([("test", 0.9)], "split string, f1 double")
    models = f"file://{tmp_path}/models"
    assert ev.release(z, off, metrics, models, "v1").first()["model_version"] == "v1"
    with pytest.raises(Exception, match="(?i)exist"):
        ev.release(z, off, metrics, models, "v1")
    with pytest.raises(ValueError, match="differs"):
        ev.release(z, off.withColumn("z", F.col("z") + 1), metrics, models, "v2")


def test_rate_limit_rules(spark):
    ok, retry = mo._limited(np.arange(5), np.array([0.0, 1.0, 2.5, 10.0, 10.2]), [], 10, 2)
    assert ok.tolist() == [True, True, False, True, False] and retry.tolist() == [0, 0, 8, 0, 1]


def test_coarse_shortlist_against_brute_force(spark):
    rng = np.random.default_rng(12)
    x = rng.random((40, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, fine array<double>")
    standard = lambda a: (a - a.mean()) / (np.linalg.norm(a - a.mean()) + 1e-6)
    pool = lambda a: a.reshape(4, 2, 4, 2).mean(axis=(1, 3)).reshape(-1)
    fine, coarse = [standard(v) for v in x], [standard(pool(v.reshape(8, 8))) for v in x]
    want = {}
    for i in range(40):
        c = sorted((-round(max(float(coarse[i][mp] @ coarse[j]) for mp in orientation_maps(4)), 9), j) for j in range(40) if j != i)[:5]
        want[i] = {j: max(float(fine[i][mp] @ fine[j]) for mp in orientation_maps(8)) for _, j in c}
    got: dict = {}
    for r in sim.top_matches(df, df, 5, same_set=True).collect():
        got.setdefault(r["query"], {})[r.target] = r["corr"]
    assert {i: set(v) for i, v in got.items()} == {i: set(v) for i, v in want.items()}
    assert all(abs(got[i][j] - want[i][j]) < 1e-8 for i in want for j in want[i])


@pytest.mark.parametrize("threshold", [0.99, 0.6])
def test_threshold_search_loses_no_pair(spark, threshold):
    rng = np.random.default_rng(2)
    base = rng.random((30, 64))
    near = [base[i % 30][orientation_maps(8)[i % 8]] + rng.normal(0, 0.06 * (i % 7), 64) for i in range(150)]
    x = np.concatenate([base, near])
    standard = lambda a: (a - a.mean()) / (np.linalg.norm(a - a.mean()) + 1e-6)
    s = np.stack([standard(v) for v in x])
    best = np.max([s[:, mp] @ s.T for mp in orientation_maps(8)], axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, fine array<double>")
    near_ids = {r.id for r in sim.threshold_pairs(df.where("id < 60"), df.where("id >= 60"), threshold).collect()}
    assert near_ids == {i for i in range(60) if (best[i, 60:] >= threshold).any()}
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(best >= threshold, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.connected_components(sim.threshold_links(df, threshold), "query", "target").collect()}
    assert {i: got.get(i, i) for i in range(len(x))} == {i: find(i) for i in range(len(x))}


def test_bank_distances_against_brute_force(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.random((9, 64)))], "id long, fine array<double>")
    rows, bank = sim.patches(df), sim.coreset(sim.patches(df.where("id < 4")), 25)
    points = np.array([r.v for r in bank.collect()])
    assert len(points) == 25
    v = {(r.id, r.patch): np.array(r.v) for r in rows.collect()}
    for r in sim.bank_distances(rows, bank).collect():
        assert r.distance == pytest.approx(np.sqrt(((points - v[r.id, r.patch]) ** 2).sum(1)).min(), abs=1e-9)
    with pytest.raises(ValueError, match="empty"):
        sim.bank_distances(rows, bank.limit(0))


def test_split_table_and_audit(spark):
    """Planted: a turned copy of a test image in the pool, near copies in the pool, a copy of a training image outside, exact copies."""
    rng = np.random.default_rng(4)
    maps = orientation_maps(8)
    base = rng.random((60, 64))
    rows = [(i, base[i], f"site/{'test' if i < 12 else 'train'}/{i:03d}.png", i % 2, "test" if i < 12 else "train", False) for i in range(48)]
    rows += [(i, base[i], f"other/{i:03d}.png", i % 2, "(none)", True) for i in range(48, 60)]
    rows += [(100, base[0][maps[3]] * 0.5 + 0.1, "site/train/100.png", 0, "train", False)]  # like a test image
    rows += [(101 + k, base[20][maps[k]], f"site/train/{101 + k}.png", 0, "train", False) for k in (1, 5)]  # a cluster with 20
    rows += [(110, base[30][maps[6]], "other/110.png", 0, "(none)", True), (111, base[31], "site/train/111.png", 1, "train", False), (112, base[32], "site/train/112.png", 1, "train", False)]
    df = spark.createDataFrame([(i, v.tolist(), p, y, s, e) for i, v, p, y, s, e in rows], "id long, fine array<double>, rel_path string, label int, source_split string, is_external boolean")
    df = df.withColumn("sha256", F.sha2(F.col("fine").cast("string"), 256))
    table = materialize(sp.make_splits(df, shares=[("train", 0.8), ("val", 0.2)], threshold=0.99, seed=42), "split-table")
    got = {r.rel_path: r for r in table.collect()}
    why = lambda p: (got[p].split, got[p].exclude_reason)
    assert len(got) == len(rows) and why("site/train/100.png") == ("excluded", sp.NEAR_TEST) and why("other/110.png") == ("excluded", sp.NEAR_TRAIN)
    assert why("site/train/111.png") == ("excluded", sp.DUPLICATE) and why("site/train/031.png")[1] == ""
    assert why("site/train/112.png")[1] == why("site/train/032.png")[1] == sp.CONFLICT
    assert len({got[f"site/train/{p}.png"].cluster_id for p in ("020", "102", "106")}) == 1
    assert all((r.nearest_train_similarity is not None) == (r.split in ("test", "external_test")) for r in got.values())
    checks = lambda t: {r.name: r.ok for r in sp.run_audit(df, t, 0.99, 0.9)[0].collect()}
    assert all(checks(table).values())
    dropped = checks(table.where("rel_path != 'site/train/020.png'"))
    assert not dropped["all_rows_accounted_for"] and not dropped["passed"] and dropped["no_near_duplicates_across_splits"]
    leaked = materialize(table.withColumn("split", F.when(F.col("rel_path") == "site/train/100.png", "train").otherwise(F.col("split"))), "leaked")
    assert not checks(leaked)["no_near_duplicates_across_splits"]
    other = F.when(F.col("rel_path") == "site/train/102.png", F.when(F.col("split") == "train", "val").otherwise("train")).otherwise(F.col("split"))
    moved = checks(materialize(table.withColumn("split", other), "moved"))
    assert not moved["no_cluster_in_two_splits"] and not moved["no_near_duplicates_across_splits"]
    wiped = checks(materialize(table.withColumn("exclude_reason", F.lit("")), "wiped"))
    assert not wiped["all_rows_accounted_for"]
    one_class = checks(materialize(table.withColumn("label", F.when(F.col("split") == "val", 1).otherwise(F.col("label"))), "one-class"))
    assert not one_class["every_split_has_both_classes"]
    prints = {r.split: r for r in sp.split_fingerprints(table).collect()}
    assert prints["test"].n == 12 and prints["test"].fingerprint != prints["external_test"].fingerprint


def test_triangle_filter():
    w = im._triangle(8, 4)
    assert np.allclose(w.sum(1), 1) and np.allclose(w @ np.ones(8), 1) and np.allclose(im._triangle(5, 5), np.eye(5))
    assert np.allclose(im._resize(np.full((9, 7), 3.0), 4), 3.0)


def test_augmentation_steps():
    x = np.random.default_rng(0).random((8, 8))
    assert np.allclose(im._moved(x, 0, (0, 0), 1), x) and np.allclose(im._moved(x, 90, (0, 0), 1), np.rot90(x, 1)) or np.allclose(im._moved(x, 90, (0, 0), 1), np.rot90(x, -1))
    assert np.allclose(im._blurred(np.full((8, 8), 2.0), 1.0), 2.0)


def test_hub_joins_are_two_plain_shuffles(spark):
    """Both sides of the component join are sorted shuffles, so adaptive execution can split a hub."""
    edges = spark.range(2000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    plan = graph._pointed(edges, edges.groupBy("u").agg(F.min("v").alias("m")))._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning(k#") == 2


def test_bootstrap_draws_are_those_with_replacement(spark, monkeypatch):
    """Over many resamples a row is drawn once on average with the variance of n draws, and two rows of far blocks exclude each other a little."""
    monkeypatch.setattr(m, "CELLS", 4)
    paths = m._paths(spark.createDataFrame([(i // 4, int(i % 3 == 0), int(i % 3 > 0)) for i in range(30)], "block long, pos long, neg long")).toPandas()
    drawn = []
    for block in range(8):
        own = pd.DataFrame({"pos": [int(i % 3 == 0) for i in range(30) if i // 4 == block], "neg": [int(i % 3 > 0) for i in range(30) if i // 4 == block]})
        pos, neg = m._drawn(own, block, m._dealt(paths[paths.block == block], 20_000, 5), 5)
        drawn.extend(pos + neg)
    drawn = np.array(drawn)
    assert (drawn.sum(0) == 30).all() and np.abs(drawn.mean(1) - 1).max() < 0.05
    cov = np.cov(drawn)
    assert np.abs(np.diag(cov) - 29 / 30).max() < 0.06 and np.abs(cov - np.diag(np.diag(cov)) + (1 - np.eye(30)) / 30).max() < 0.05


def test_bootstrap_of_no_rows(spark):
    assert m.resampled_counts(spark.createDataFrame([], "id string, label int, p double"), 0.5, 3).count() == 0


def test_the_bins_of_the_calibration_error_compute_a_score_once(spark):
    from gaugeframe.plans.registry import QUERIES
    from gaugeframe.plans import queries_scores  # noqa: F401

    plan = QUERIES["d25_ece"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1
