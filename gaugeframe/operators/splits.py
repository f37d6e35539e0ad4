"""Exact copies, group-aware splits and the leakage audit.

An inventory with pixels has the columns id, rel_path, sha256, label, source_split,
is_external and fine (a thumbnail as an array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.operators import similarity as sim
from gaugeframe.operators.graph import connected_components
from gaugeframe.operators.ranking import distributed_rank, running_totals
from gaugeframe.sources.scratch import materialize, scratch_scope

# Reasons of excluded rows, names of splits, and the ordered pairs of splits that must not resemble each other.
CONFLICT, DUPLICATE = "exact_duplicate_label_conflict", "exact_duplicate"
NEAR_TEST, NEAR_TRAIN = "near_duplicate_of_official_test", "near_duplicate_of_train_or_val"
EXTERNAL_TEST, EXCLUDED = "external_test", "excluded"
CROSS_CHECKS = [("val", "train"), ("test", "train"), ("test", "val"), ("external_test", "train"), ("external_test", "val")]


def exact_duplicate_reasons(df: DataFrame) -> DataFrame:
    """Add exclude_reason: of equal hashes a test copy stays, else the first path; with conflicting labels none stays.

    A plain aggregate and a join on a turned hash: the aggregate's side gets an exchange of its own, so that both sides of the join
    are plain shuffles and adaptive execution can split a hash that many rows share.
    """
    test_first = F.struct((F.col("source_split") != "test").cast("int").alias("late"), F.col("rel_path"))
    joined = _with_group(df, "sha256", F.min(test_first).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
    reason = F.when(F.col("low") != F.col("high"), CONFLICT).when(F.col("rel_path") != F.col("first.rel_path"), DUPLICATE).otherwise("")
    return joined.withColumn("exclude_reason", reason).drop("first", "low", "high")


def _with_group(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``df`` with aggregates of the rows of equal ``key``, by a join whose hot keys can be split."""
    groups = df.groupBy(key).agg(*aggregates)
    turned = F.reverse(F.col(key).cast("string"))
    right = groups.withColumn("_turned", turned).drop(key)
    return df.withColumn("_turned", turned).join(right.hint("merge"), "_turned").drop("_turned")


def hash_edges(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Star links from every copy to the first path of its hash."""
    return _with_group(df, "sha256", F.min(path).alias("target")).where(F.col(path) != F.col("target")).select(F.col(path).alias("query"), "target")


def duplicate_edges(df: DataFrame, threshold: float) -> DataFrame:
    """query, target (ids): links between equal hashes, and links that join all pairs of thumbnails at the threshold."""
    return hash_edges(df, "id").unionByName(sim.threshold_links(df, threshold))


def cluster_images(df: DataFrame, threshold: float) -> DataFrame:
    """id and cluster_id (``g00000`` and so on by each cluster's first path) of every row of an inventory with pixels."""
    found = materialize(connected_components(duplicate_edges(df, threshold), "query", "target"), "image-components")
    rows = df.select("id", "rel_path").join(found.hint("merge"), "id", "left").select("id", "rel_path", F.coalesce("component", "id").alias("component"))
    numbers = number_clusters(rows, "rel_path", "component")
    return rows.select("id", "rel_path").join(numbers.hint("merge"), "rel_path").select("id", "cluster_id")


def seeded(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the key, equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def majority_label(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Size and majority label of each cluster; ties are defective."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), (F.avg("label") >= 0.5).cast("int").alias("majority"))


def allocate_clusters(clusters: DataFrame, shares: list[tuple[str, float]], seed: int, cluster: str = "cluster_id") -> DataFrame:
    """Whole clusters to splits within each label: by seeded order, the split is where the running share before the cluster falls."""
    rows = clusters.select(cluster, "majority", "n", seeded(F.col(cluster), seed).alias("u"))
    placed = materialize(running_totals(rows, ["majority"], ["u", cluster], {"ahead": "n"}), "clusters-in-order")
    total = placed.groupBy("majority").agg(F.sum("n").alias("total"))
    before = F.col("ahead") / F.col("total")
    bounds, at = [], 0.0
    for _, share in shares[:-1]:
        at += share
        bounds.append(at)
    index = sum((F.lit(b) <= before).cast("int") for b in bounds) if bounds else F.lit(0)
    names = F.array(*(F.lit(s) for s, _ in shares))
    return placed.join(F.broadcast(total), "majority").select(cluster, "majority", "n", F.element_at(names, index + 1).alias("split"))


def number_clusters(df: DataFrame, member: str = "id", component: str = "component", prefix: str = "g") -> DataFrame:
    """cluster_id ``g00000`` and so on by each component's first member, numbered without one task seeing all members."""
    first = df.groupBy(component).agg(F.min(member).alias("first"))
    numbered = distributed_rank(first, [], ["first"], "number")
    named = numbered.select(F.reverse(F.col(component).cast("string")).alias("_turned"), F.format_string(prefix + "%05d", F.col("number")).alias("cluster_id"))
    return df.withColumn("_turned", F.reverse(F.col(component).cast("string"))).join(named.hint("merge"), "_turned").select(member, "cluster_id")


def cluster_report(df: DataFrame, threshold: float, cluster: str = "cluster_id") -> DataFrame:
    """One row: clusters, those of several images, images in them, the largest, clusters with more than one label, groups of equal
    hashes and their extra copies, and of all ordered pairs of images at the threshold their number, that of those which need a turned or
    flipped orientation, and the smallest correlation."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_multi"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("images_in_multi"),
        F.max("n").alias("largest"), F.count_if(F.col("labels") > 1).alias("n_conflicts"),
    )
    exact = df.groupBy("sha256").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("exact_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"))
    return sizes.crossJoin(F.broadcast(exact)).crossJoin(F.broadcast(sim.link_counts(df, threshold)))


def cluster_size_histogram(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def keys_in_two_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split (none is the check's success)."""
    return df.groupBy(key).agg(F.min(split).alias("low"), F.max(split).alias("high")).where("low != high").select(key)


def same_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: paths of ``a`` missing in ``b`` and the reverse, and whether both are none."""
    x = a.select("rel_path").join(b.select("rel_path"), "rel_path", "left_anti").agg(F.count("*").alias("missing"))
    y = b.select("rel_path").join(a.select("rel_path"), "rel_path", "left_anti").agg(F.count("*").alias("extra"))
    return x.crossJoin(F.broadcast(y)).withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0))


def audit_checks(manifest: DataFrame, splits: DataFrame, cross: DataFrame) -> DataFrame:
    """Check rows (name, ok, detail), the last one ``passed``.

    ``splits`` is the written split table, ``cross`` the rows of ``cross_split_matrix`` over it.  Checked are the accounting (every
    path once, a reason on every excluded row), hashes and clusters in one split only, no near duplicates across splits, and both
    classes in train, val, test and, where it has rows, the external test.
    """
    kept = splits.where(F.col("split") != EXCLUDED)
    row = lambda df, name, ok: df.select(F.lit(name).alias("name"), ok.alias("ok"), F.col("detail").cast("long").alias("detail"))
    none = F.col("detail") == 0
    silent = splits.agg(F.count_if((F.col("split") == EXCLUDED) & (F.col("exclude_reason") == "")).alias("silent"))
    account = same_paths(manifest, splits).crossJoin(F.broadcast(silent)).select((F.col("missing") + F.col("extra") + F.col("silent")).alias("detail"))
    parts = [row(account, "all_rows_accounted_for", none)]
    for key, name in (("sha256", "no_sha256_in_two_splits"), ("cluster_id", "no_cluster_in_two_splits")):
        parts.append(row(keys_in_two_splits(kept, key).agg(F.count("*").alias("detail")), name, none))
    parts.append(row(cross.agg(F.coalesce(F.sum("n_threshold"), F.lit(0)).alias("detail")), "no_near_duplicates_across_splits", none))
    have = kept.select("split", "label").distinct().agg(F.sort_array(F.collect_set(F.concat_ws("|", "split", "label"))).alias("have"), F.bool_or(F.col("split") == EXTERNAL_TEST).alias("external"))
    want = lambda names: F.array(*(F.lit(f"{s}|{y}") for s in names for y in (0, 1)))
    needed = F.when(F.coalesce("external", F.lit(False)), want(["train", "val", "test", EXTERNAL_TEST])).otherwise(want(["train", "val", "test"]))
    parts.append(row(have.select(F.size(F.array_except(needed, "have")).alias("detail")), "every_split_has_both_classes", none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out, "audit")
    return out.unionByName(row(out.agg(F.count_if(~F.col("ok")).alias("detail")), "passed", none))


def split_fingerprints(splits: DataFrame, names: tuple[str, ...] = ("test", EXTERNAL_TEST)) -> DataFrame:
    """split, n and fingerprint (of the sorted hashes) of the held-out splits; an empty split has the fingerprint of no hashes."""
    from gaugeframe.operators.inventory import set_fingerprint

    rows = splits.where(F.col("split").isin(*names)).select("split", "sha256")
    every = splits.sparkSession.createDataFrame([(n,) for n in names], "split string")
    return set_fingerprint(rows, "split", every=every)


def run_audit(manifest: DataFrame, splits: DataFrame, threshold: float, info: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The checks, the cross-split similarity rows and the fingerprints of the held-out splits.

    ``manifest`` is an inventory with pixels: similarity is computed anew from it, not taken from the split table's clusters, and the
    search for near duplicates across splits is lossless.
    """
    pixels = manifest.select("rel_path", "id", "fine")
    placed = splits.where(F.col("split") != EXCLUDED).select("rel_path", "split").join(pixels.hint("merge"), "rel_path")
    cross = materialize(sim.cross_split_matrix(placed, CROSS_CHECKS, threshold, info), "cross-splits")
    return audit_checks(manifest, splits, cross), cross, split_fingerprints(splits)


def _excluded(rows: DataFrame, candidates: Column, reference: Column, threshold: float, reason: str) -> DataFrame:
    """``rows`` with ``reason`` on candidates that some reference row is like (a semi-join on the threshold search)."""
    hit = sim.threshold_pairs(rows.where(candidates), rows.where(reference), threshold).select("id", F.lit(True).alias("_hit"))
    marked = rows.join(hit.hint("merge"), "id", "left")
    return marked.withColumn("exclude_reason", F.when(F.col("_hit"), reason).otherwise(F.col("exclude_reason"))).drop("_hit")


def make_splits(images: DataFrame, *, strategy: str = "auto", shares: list[tuple[str, float]], threshold: float, seed: int, nearest: bool = True) -> DataFrame:
    """The split table of an inventory with pixels: rel_path, sha256, label, cluster_id, split, exclude_reason, nearest_train_similarity.

    Exact copies go first, over all rows.  ``official`` keeps the test folder as the test split and excludes pool rows that are
    turned, flipped or plain near copies of it; ``random`` splits all rows that aren't external; ``auto`` is official where there
    is a test folder.  The pool is clustered by equal hashes and near copies and allotted by whole clusters with ``shares`` (name,
    share).  External rows too like a train or val row are excluded, the others are the external test.  Rows outside the pool are
    clusters of their own (``s`` and the path).  The last column takes a search of its own over all held-out and train rows and nothing
    else depends on it; without ``nearest`` the table has all rows but not that column.  The table is written; what was written on the way
    is deleted.
    """
    with scratch_scope(images.sparkSession) as keep:
        return keep(materialize(_split_rows(images, strategy, shares, threshold, seed, nearest), "splits"))


def _split_rows(images: DataFrame, strategy: str, shares: list[tuple[str, float]], threshold: float, seed: int, nearest: bool) -> DataFrame:
    """The rows of the split table; see ``make_splits``."""
    from gaugeframe.operators.inventory import resolve_strategy

    images = materialize(images.select("id", "rel_path", "sha256", "label", "source_split", "is_external", "fine"), "images")  # read twice, hashed once
    rows = materialize(exact_duplicate_reasons(images), "collapsed")
    chosen = resolve_strategy(rows.where("not is_external"), strategy).first()[0]
    kept, held = F.col("exclude_reason") == "", F.col("source_split") == "test"
    if chosen == "official":
        test = kept & ~F.col("is_external") & held
        rows = materialize(_excluded(rows, kept & ~F.col("is_external") & ~held, test, threshold, NEAR_TEST), "without-test-copies")
        pool = kept & ~F.col("is_external") & ~held
    else:
        test, pool = F.lit(False), kept & ~F.col("is_external")
    clusters = materialize(cluster_images(rows.where(pool), threshold), "pool-clusters")
    members = rows.where(pool).select("id", "label").join(clusters.hint("merge"), "id")
    placed = allocate_clusters(majority_label(members), shares, seed).select("cluster_id", F.col("split").alias("_split"))
    placed = clusters.join(placed.hint("merge"), "cluster_id")
    rows = rows.join(placed.hint("merge"), "id", "left")
    rows = rows.withColumn("split", F.when(F.col("_split").isNotNull(), F.col("_split")).when(test, "test").otherwise(F.lit(""))).drop("_split")
    rows = materialize(rows.withColumn("cluster_id", F.coalesce("cluster_id", F.concat(F.lit("s"), F.col("rel_path")))), "pool-splits")
    rows = _excluded(rows, kept & F.col("is_external"), F.col("split").isin("train", "val"), threshold, NEAR_TRAIN)
    split = F.when(F.col("exclude_reason") != "", EXCLUDED).when(F.col("is_external"), EXTERNAL_TEST).otherwise(F.col("split"))
    rows, columns = rows.withColumn("split", split), ["rel_path", "sha256", "label", "cluster_id", "split", "exclude_reason"]
    if not nearest:
        return rows.select(*columns)
    rows = materialize(rows, "all-splits")
    train = rows.where("split = 'train'").select("id", "fine", F.lit("train").alias("grp"))
    near = sim.nearest_by_group(rows.where(F.col("split").isin("test", EXTERNAL_TEST)).select("id", "fine"), train)
    near = near.select(F.col("query").alias("id"), F.col("nearest").alias("nearest_train_similarity"))
    return rows.join(near.hint("merge"), "id", "left").select(*columns, "nearest_train_similarity")
