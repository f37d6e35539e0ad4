"""Queries over the thumbnail view (embeddings with planted copies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import arrays as ar
from gaugeframe.functions.scores import sigmoid
from gaugeframe.operators import anomaly as an
from gaugeframe.operators import similarity as sim
from gaugeframe.operators.graph import connected_components
from gaugeframe.operators.ranking import exact_quantiles
from gaugeframe.operators.splits import number_clusters
from gaugeframe.plans.bindings import SIDE, THUMBS, hash32, thumbs
from gaugeframe.plans.registry import query
from gaugeframe.sources.scratch import materialize

W = f"WITH {THUMBS}"
_HALF = SIDE // 2
_BLOCKS = [[(2 * r + i) * SIDE + 2 * c + j + 1 for i in (0, 1) for j in (0, 1)] for r in range(_HALF) for c in range(_HALF)]


def matching_sql(table: str) -> str:
    """CTEs over a table of id and fine: ``std`` (standardised fine and coarse arrays), both in all orientations, and ``allpairs``
    (query, target, corr, via_transform, coarse of all ordered pairs)."""
    unit = "list_transform({c}, lambda x: x / (sqrt(list_sum(list_transform({c}, lambda y: y * y))) + 1e-6))"
    coarse_maps = ", ".join(f"({k}, {m})" for k, m in enumerate(ar.orientation_maps(_HALF)))
    return f"""pooled AS (SELECT id, fine, list_transform({_BLOCKS}, lambda p: (fine[p[1]] + fine[p[2]] + fine[p[3]] + fine[p[4]]) / 4e0) AS coarse FROM {table}),
cmaps AS (SELECT * FROM (VALUES {coarse_maps}) AS t(k, cm)),
std AS (SELECT id, {unit.format(c='f')} AS s, {unit.format(c='c')} AS cs
  FROM (SELECT id, list_transform(fine, lambda x: x - list_avg(fine)) AS f, list_transform(coarse, lambda x: x - list_avg(coarse)) AS c FROM pooled)),
turned AS (SELECT id, k, list_transform(m, lambda i: s[i + 1]) AS s, list_transform(cm, lambda i: cs[i + 1]) AS cs FROM std, maps JOIN cmaps USING (k)),
allpairs AS (SELECT a.id AS query, b.id AS target, round(max(list_dot_product(a.s, b.s)), 9) AS corr, round(max(list_dot_product(a.cs, b.cs)), 9) AS coarse,
  round(max(list_dot_product(a.s, b.s)) FILTER (a.k = 0), 9) < round(max(list_dot_product(a.s, b.s)), 9) AS via_transform FROM turned a JOIN std b ON a.id <> b.id GROUP BY a.id, b.id)"""


_STD = matching_sql("thumbs")
_SHORT = f"{W}, {_STD}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coarse DESC, target) AS k FROM allpairs) WHERE k <= {sim.SHORTLIST})"


@query("h1_orientations", f"{W} SELECT id, k AS orientation, round(list_sum(list_transform(range(1, 65), lambda i: i * (fine[m[i] + 1]))), 6) AS checksum FROM thumbs, maps")
def _(s, d):
    rows = sim.with_orientations(thumbs(s, d))
    weight = F.array(*(F.lit(float(i)) for i in range(1, 65)))
    return rows.select("id", "orientation", F.round(ar.dot(F.col("fine"), weight), 6).alias("checksum"))


@query("h2_standardize", f"{W}, {_STD} SELECT id, round(list_sum(s), 6) AS total, round(s[1], 6) AS first, round(list_sum(list_transform(s, lambda x: x * x)), 4) AS square FROM std")
def _(s, d):
    rows = thumbs(s, d).select("id", ar.standardize(F.col("fine")).alias("s"))
    return rows.select("id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("s")[0], 6).alias("first"), F.round(ar.dot(F.col("s"), F.col("s")), 4).alias("square"))


@query("h3_dot_l2", f"{W} SELECT a.id, round(list_dot_product(a.fine, b.fine), 6) AS dot, round(list_distance(a.fine, b.fine), 6) AS l2 FROM thumbs a JOIN thumbs b ON b.id = a.id + 1000000")
def _(s, d):
    t = thumbs(s, d)
    b = t.select((F.col("id") - 1_000_000).alias("id"), F.col("fine").alias("other"))
    return t.join(b, "id").select("id", F.round(ar.dot(F.col("fine"), F.col("other")), 6).alias("dot"), F.round(ar.l2(F.col("fine"), F.col("other")), 6).alias("l2"))


@query("c3_top_matches", f"{_SHORT} SELECT query, target, round(corr, 6) AS corr, via_transform FROM top")
def _(s, d):
    t = thumbs(s, d)
    return sim.top_matches(t, t, sim.SHORTLIST, same_set=True).withColumn("corr", F.round("corr", 6))


@query("c4_nearest_similarity", f"{_SHORT} SELECT query AS id, round(max(corr), 6) AS nearest FROM top GROUP BY query")
def _(s, d):
    t = thumbs(s, d)
    return sim.nearest_similarity(t, t, same_set=True).withColumn("nearest", F.round("nearest", 6))


_EDGES = [0.0, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999]


@query("d10_similarity_histogram", f"{_SHORT}, n AS (SELECT query, max(corr) AS c FROM top GROUP BY query) SELECT {' + '.join(f'({e}e0 <= c)::INTEGER' for e in _EDGES)} AS bin, count(*) AS n FROM n GROUP BY 1")
def _(s, d):
    t = thumbs(s, d)
    return sim.nearest_similarity(t, t, same_set=True).groupBy(ar.bin_index(F.col("nearest"), _EDGES).alias("bin")).agg(F.count("*").alias("n"))


_CC = f"""{W}, {_STD}, e AS (SELECT query AS a, target AS b FROM allpairs WHERE corr >= 0.99e0)"""


def _clusters(s, d):
    t = thumbs(s, d)
    found = connected_components(sim.threshold_links(t, 0.99), "query", "target")
    return t.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("i1_connected_components", _CC.replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT id, id AS c FROM thumbs UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c) SELECT id, min(c) AS component FROM r GROUP BY id")
def _(s, d):
    return _clusters(s, d)


@query("i1_cluster_ids", _CC.replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT id, id AS c FROM thumbs UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c), k AS (SELECT id, min(c) AS component FROM r GROUP BY id) SELECT id, printf('g%05d', dense_rank() OVER (ORDER BY component) - 1) AS cluster_id FROM k")
def _(s, d):
    return number_clusters(_clusters(s, d))


@query("d22_image_stats", f"{W} SELECT id, round(list_avg(fine), 6) AS brightness, round(list_stddev_pop(fine), 6) AS contrast FROM thumbs")
def _(s, d):
    return sim.image_stats(thumbs(s, d)).select("id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))


_PLACES = [(r, c) for r in range(1, 7) for c in range(1, 7)]
_AROUND = "around AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {[(r + i) * 8 + c + j for i in (-1, 0, 1) for j in (-1, 0, 1)]})" for k, (r, c) in enumerate(_PLACES)) + ") t(patch, pos))"
_PATCHES = f"{W}, {_AROUND}, nine AS (SELECT id, patch, list_transform(pos, lambda i: fine[i + 1]) AS n FROM thumbs, around), patches AS (SELECT id, patch, list_append(n, list_avg(n)) AS v FROM nine)"


@query("h8_patches", f"{_PATCHES} SELECT id, patch, round(list_sum(v), 6) AS total, round(v[10], 6) AS mean FROM patches")
def _(s, d):
    p = sim.patches(thumbs(s, d))
    return p.select("id", "patch", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("v")[9], 6).alias("mean"))


@query("e11_patch_sample", f"{_PATCHES}, r AS (SELECT id, patch, row_number() OVER (PARTITION BY id ORDER BY md5('9|' || id || '|' || patch), patch) AS k FROM patches) SELECT id, patch FROM r WHERE k <= 4")
def _(s, d):
    return sim.sample_patches(sim.patches(thumbs(s, d)), 4, 9).select("id", "patch")


#: Patches have 10 numbers here, so the choice is made in 6 of them; the sample takes 16 of an image's 36 patches.
PATCHES_AN_IMAGE, BANK, DIMS = 16, 5000, 6


def _placed(s, d):
    """Thumbnails with a 0/1 label and a split by their number; a planted copy is in its original's split."""
    h = hash32(F.col("id") % 1_000_000) % 20
    split = F.when(h < 12, "train").when(h < 15, "val").when(h < 18, "test").otherwise("external_test")
    return thumbs(s, d).select("id", "fine", (F.col("label") % 2).cast("int").alias("label"), split.alias("split"))


def _fitted(s, d):
    return an.fit_bank(_placed(s, d), patches_an_image=PATCHES_AN_IMAGE, size=BANK, dims=DIMS, seed=42)


def _bank(s, d):
    """The fitted memory bank: a coreset of the sampled patches of the normal training rows."""
    return _fitted(s, d)["bank"]


@query("c13_bank_distance")
def _(s, d):
    """The distance of every patch to the fitted bank."""
    return sim.bank_distances(sim.patches(thumbs(s, d)), _bank(s, d))


@query("i17_coreset")
def _(s, d):
    return _bank(s, d).select("id", "patch")


@query("i18_memory_bank")
def _(s, d):
    return _bank(s, d)


@query("i19_anomaly_scores")
def _(s, d):
    return sim.anomaly_scores(thumbs(s, d), _bank(s, d))


@query("i19_sampled_bank", f"""{_PATCHES}, r AS (SELECT v, row_number() OVER (PARTITION BY id ORDER BY md5('9|' || id || '|' || patch), patch) AS k FROM patches JOIN thumbs USING (id) WHERE label % 2 = 0),
  bank AS (SELECT v FROM r WHERE k = 1)
  SELECT id, round(max(near), 6) AS score FROM (SELECT p.id, p.patch, min(list_distance(p.v, b.v)) AS near FROM patches p, bank b GROUP BY p.id, p.patch) GROUP BY id""")
def _(s, d):
    """Scores against a bank that SQL can say: one patch of each normal image."""
    t = thumbs(s, d)
    bank = materialize(sim.sample_patches(sim.patches(t.where("label % 2 = 0")), 1, 9), "sampled-bank")
    return sim.anomaly_scores(t, bank).withColumn("score", F.round("score", 6))


@query("i20_anomaly_evaluation")
def _(s, d):
    """Bank of normal training rows, threshold for recall on the validation rows, one row for it and for each test set."""
    return an.anomaly_report(_placed(s, d), _fitted(s, d), 0.9)


_SIGNS = [[f"{x}e0" for x in row] for row in sim.projection_signs(8, SIDE * SIDE, 42)]
_PROJECTED = ", ".join(f"round(list_dot_product(fine, {row}::DOUBLE[]), 6) AS d{i}" for i, row in enumerate(_SIGNS)).replace("'", "")


@query("h7_random_projection", f"{W} SELECT id, {_PROJECTED} FROM thumbs")
def _(s, d):
    projected = sim.sign_projection(F.col("fine"), 8, SIDE * SIDE, 42)
    return thumbs(s, d).select("id", projected.alias("p")).select("id", *(F.round(F.col("p")[i], 6).alias(f"d{i}") for i in range(8)))


_WEIGHTS = [round(((7 * i) % 13 - 6) / 10, 1) for i in range(64)]


@query("i12_linear_scores", f"{W} SELECT id, round(list_dot_product(fine, {[f'{w}e0' for w in _WEIGHTS]}::DOUBLE[]) + 0.25e0, 6) AS z FROM thumbs".replace("'", ""))
def _(s, d):
    return sim.linear_scores(thumbs(s, d), _WEIGHTS, 0.25).withColumn("z", F.round("z", 6))


@query("i12_batch_scoring", f"{W} SELECT id, round(list_dot_product(fine, {[f'{w}e0' for w in _WEIGHTS]}::DOUBLE[]), 6) AS z FROM thumbs".replace("'", ""))
def _(s, d):
    import numpy as np

    weights = np.array(_WEIGHTS)
    return sim.score_with(thumbs(s, d), lambda x: x @ weights).withColumn("z", F.round("z", 6))


@query("i13_head_training")
def _(s, d):
    """The head's probability of every row, by its weights as native columns; the training rows are written first."""
    rows = materialize(thumbs(s, d).withColumn("label", (F.col("label") % 2).cast("int")), "head-rows")
    weights, bias = sim.train_head(rows)
    z = sim.linear_scores(rows, weights, bias)
    return rows.select("id", "label").join(z.hint("merge"), "id").select("id", "label", sigmoid(F.col("z")).alias("p"))


@query("d34_image_summary", f"""{W}, st AS (SELECT list_avg(fine) AS brightness, list_stddev_pop(fine) AS contrast FROM thumbs),
  u AS (SELECT 'brightness' AS feature, brightness AS v FROM st UNION ALL SELECT 'contrast', contrast FROM st)
  SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, round(min(v), 6) AS min, round(quantile_cont(v, 0.25e0), 6) AS q25, round(quantile_cont(v, 0.5e0), 6) AS q50,
    round(quantile_cont(v, 0.75e0), 6) AS q75, round(max(v), 6) AS max FROM u GROUP BY feature""")
def _(s, d):
    """Numeric description of the image statistics."""
    stats = materialize(sim.image_stats(thumbs(s, d)), "stats")
    long = stats.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("brightness", "contrast"))))).alias("feature", "v"))
    one = lambda f, name: F.round(f("v"), 6).alias(name)
    rows = long.groupBy("feature").agg(F.count("*").alias("n"), one(F.avg, "mean"), one(F.stddev_samp, "stddev"), one(F.min, "min"), one(F.max, "max"))
    cuts = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["feature"])
    return rows.join(F.broadcast(cuts), "feature").select("feature", "n", "mean", "stddev", "min", *(F.round(F.col("quantiles")[i], 6).alias(q) for i, q in enumerate(("q25", "q50", "q75"))), "max")
