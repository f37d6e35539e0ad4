"""Queries over the inventory view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators import inventory as inv
from gaugeframe.operators import splits as sp
from gaugeframe.operators.graph import connected_components
from gaugeframe.operators.similarity import SHORTLIST
from gaugeframe.plans.bindings import CLASSES, EXTERNAL, PARTS, STILLS, hash32, parts, stills
from gaugeframe.plans.queries_thumbs import matching_sql
from gaugeframe.plans.registry import query
from gaugeframe.sources.scratch import materialize

W = f"WITH {PARTS}"
_IMAGES = "('jpg', 'jpeg', 'png', 'bmp', 'webp', 'tif', 'tiff')"
_EXT = r"lower(regexp_extract(rel_path, '\.([^./]+)$', 1))"
_FIRST = "split_part(rel_path, '/', 1)"
_OUT = "('" + "', '".join(EXTERNAL) + "')"


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "class_dir string, class_name string")


@query("a2_image_split", f"{W} SELECT rel_path, {_EXT} IN {_IMAGES} AS is_image FROM parts")
def _(s, d):
    return parts(s, d).select("rel_path", inv.is_image(F.col("rel_path")).alias("is_image"))


@query("a3_detect_split", f"{W} SELECT rel_path, source_split AS split FROM parts")
def _(s, d):
    return parts(s, d).select("rel_path", inv.detect_split(F.col("rel_path")).alias("split"))


@query("a4_class_dir", f"{W} SELECT rel_path, class_dir FROM parts")
def _(s, d):
    return parts(s, d).select("rel_path", inv.class_dir(F.col("rel_path")).alias("class_dir"))


_MANIFEST = "SELECT rel_path, class_dir, CASE class_dir WHEN 'def_front' THEN 'defective' ELSE 'normal' END AS class_name, label, source_split, sha256, width, height, mode, size_bytes FROM parts WHERE error IS NULL"


@query("a6_build_manifest", f"{W} {_MANIFEST}")
def _(s, d):
    return inv.build_manifest(parts(s, d), aliases(s))


@query("a7_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("a8_checksum_lines", f"{W} SELECT sha256 || '  ' || rel_path AS line FROM parts")
def _(s, d):
    return inv.checksum_lines(parts(s, d))


@query(
    "a9_verify_checksums",
    f"""{W}, l AS (SELECT *, CASE WHEN h % 29 = 0 THEN 'broken ' || rel_path WHEN h % 31 = 0 THEN '../' || rel_path WHEN h % 37 = 0 THEN rel_path || '.gone' WHEN h % 53 = 0 THEN 'a' || chr(92) || rel_path
        WHEN h % 59 = 0 THEN '.' || rel_path ELSE rel_path END AS name FROM parts)
    SELECT name, CASE WHEN h % 29 = 0 THEN 'malformed line' WHEN h % 31 = 0 THEN 'unsafe name' WHEN h % 37 = 0 THEN 'missing file' WHEN h % 53 = 0 OR h % 59 = 0 THEN 'unsafe name' ELSE 'mismatch' END AS problem
    FROM l WHERE h % 29 = 0 OR h % 31 = 0 OR h % 37 = 0 OR h % 53 = 0 OR h % 59 = 0 OR h % 43 = 0""",
)
def _(s, d):
    p, h = parts(s, d), F.col("h")
    name = F.when(h % 31 == 0, F.concat(F.lit("../"), F.col("rel_path"))).when(h % 37 == 0, F.concat("rel_path", F.lit(".gone")))
    name = name.when(h % 53 == 0, F.concat(F.lit("a\\"), F.col("rel_path"))).when(h % 59 == 0, F.concat(F.lit("."), F.col("rel_path"))).otherwise(F.col("rel_path"))
    sha = F.when(h % 43 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))
    lines = p.select(F.when(h % 29 == 0, F.concat(F.lit("broken "), F.col("rel_path"))).otherwise(F.concat(sha, F.lit("  "), name)).alias("line"))
    return inv.verify_checksums(lines, p, flat=False)


@query("a10_tree_fingerprint", f"""{W}, e AS (SELECT source_split, sha256 AS h, count(*) AS n FROM parts GROUP BY ALL),
  p AS (SELECT source_split, substr(h, 1, 3) AS part, sum(n) AS n, sha256(string_agg(h || '*' || n, chr(10) ORDER BY h || '*' || n)) AS d FROM e GROUP BY ALL)
  SELECT source_split, sum(n)::BIGINT AS n, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part || ':' || d)) AS fingerprint FROM p GROUP BY source_split""")
def _(s, d):
    """The fingerprint in parts, which spreads a split over many tasks."""
    return inv.tree_fingerprint(parts(s, d), "source_split")


@query("a10_set_fingerprint", f"{W} SELECT source_split, count(*) AS n, sha256(string_agg(sha256, chr(10) ORDER BY sha256)) AS fingerprint FROM parts GROUP BY source_split")
def _(s, d):
    return inv.set_fingerprint(parts(s, d), "source_split")


@query(
    "a13_manifest_report",
    f"""{W}, c AS (SELECT source_split AS key, count(*) FILTER (class_dir = 'def_front') AS x, count(*) FILTER (class_dir = 'ok_front') AS y FROM parts WHERE error IS NULL GROUP BY 1)
    SELECT 'n' AS part, '' AS key, '' AS detail, count(*) AS n FROM parts UNION ALL SELECT 'corrupt', rel_path, error, 1 FROM parts WHERE error IS NOT NULL
    UNION ALL SELECT 'count', key, 'def_front', x FROM c UNION ALL SELECT 'count', key, 'ok_front', y FROM c""",
)
def _(s, d):
    return inv.manifest_report(parts(s, d), ["def_front", "ok_front"])


@query("a14_read_split", f"{W} SELECT rel_path, label FROM parts WHERE source_split = 'val'")
def _(s, d):
    return inv.read_split(parts(s, d), "val").select("rel_path", "label")


@query("b1_class_alias", f"{W} SELECT rel_path, CASE class_dir WHEN 'def_front' THEN 'defective' ELSE 'normal' END AS class_name FROM parts")
def _(s, d):
    return inv.resolve_classes(parts(s, d), aliases(s)).select("rel_path", "class_name")


@query("b2_is_external", f"{W} SELECT rel_path, {_FIRST} IN {_OUT} AS is_external FROM parts")
def _(s, d):
    return parts(s, d).select("rel_path", inv.is_external(F.col("rel_path"), EXTERNAL).alias("is_external"))


@query("b3_resolve_strategy", f"{W} SELECT CASE WHEN bool_or(source_split = 'test') THEN 'official' ELSE 'random' END AS strategy FROM parts WHERE {_FIRST} NOT IN {_OUT}")
def _(s, d):
    p = parts(s, d)
    return inv.resolve_strategy(p.where(~inv.is_external(F.col("rel_path"), EXTERNAL)), "auto")


@query(
    "b8_sniff_format",
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'JPEG' WHEN page_id % 6 = 1 THEN 'PNG' WHEN page_id % 6 = 2 THEN 'BMP' WHEN page_id % 6 = 3 THEN 'WEBP' END AS format FROM pages""",
)
def _(s, d):
    i = F.col("page_id") % 6
    magic = F.when(i == 0, "FFD8FFE0").when(i == 1, "89504E470D0A1A0A").when(i == 2, "424D9A00").when(i == 3, "524946460000000057454250").when(i == 4, "474946383961").otherwise("")
    body = F.concat(F.unhex(magic), F.col("html").cast("binary"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", inv.sniff_format(body).alias("format"))


@query(
    "b9_file_verdict",
    f"""{W}, v AS (SELECT rel_path, CASE WHEN size_bytes * 300 > 5242880 THEN 'payload_too_large' WHEN h % 23 = 0 THEN 'unsupported_media_type' WHEN h % 19 = 0 THEN 'too_many_pixels' WHEN h % 11 = 0 THEN 'multi_frame'
      WHEN h % 17 = 0 THEN 'bad_dimensions' WHEN h % 13 = 0 THEN 'bad_aspect' WHEN error IS NOT NULL THEN 'invalid_image' ELSE 'ok' END AS verdict FROM parts)
    SELECT rel_path, verdict, CASE verdict WHEN 'ok' THEN 200 WHEN 'payload_too_large' THEN 413 WHEN 'unsupported_media_type' THEN 415 ELSE 400 END AS status FROM v""",
)
def _(s, d):
    h = F.col("h")
    p = parts(s, d).withColumns({
        "size_bytes": F.col("size_bytes") * 300,
        "format": F.when(h % 23 != 0, F.col("format")),
        "n_frames": F.when(h % 11 == 0, 12).otherwise(1),
        "width": F.when(h % 19 == 0, 5000).when(h % 17 == 0, 8).when(h % 13 == 0, 2000).otherwise(512),
        "height": F.when(h % 19 == 0, 5000).when(h % 17 == 0, 8).when(h % 13 == 0, 400).otherwise(512),
    })
    return inv.file_verdict(p).select("rel_path", "verdict", "status")


@query("b15_format_mismatch", f"{W} SELECT rel_path, format FROM parts WHERE CASE {_EXT} WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' ELSE {_EXT} END <> lower(format)")
def _(s, d):
    return inv.format_mismatch(parts(s, d)).select("rel_path", "format")


@query("d1_split_class_counts", f"{W} SELECT source_split, class_dir, count(*) AS count FROM parts GROUP BY ALL")
def _(s, d):
    return inv.split_class_counts(parts(s, d))


_SINGLE = {
    "n_images": "count(*)", "n_valid": "count(*) FILTER (error IS NULL)", "n_corrupt": "count(*) FILTER (error IS NOT NULL)", "bytes_total": "sum(size_bytes)::BIGINT",
    "bytes_min": "min(size_bytes)", "bytes_max": "max(size_bytes)", "width_min": "min(width) FILTER (error IS NULL)", "width_max": "max(width) FILTER (error IS NULL)",
    "height_min": "min(height) FILTER (error IS NULL)", "height_max": "max(height) FILTER (error IS NULL)",
}
_PROFILE = " UNION ALL ".join(f"SELECT '{k}' AS facet, '' AS value, {v} AS n FROM parts" for k, v in _SINGLE.items())


@query(
    "d2_inventory_profile",
    f"""{W} {_PROFILE} UNION ALL SELECT 'format', format, count(*) FROM parts WHERE error IS NULL GROUP BY format UNION ALL SELECT 'mode', mode, count(*) FROM parts WHERE error IS NULL GROUP BY mode
    UNION ALL SELECT 'channels', CASE mode WHEN 'L' THEN '1' ELSE '3' END, count(*) FROM parts WHERE error IS NULL GROUP BY 2""",
)
def _(s, d):
    return inv.inventory_profile(parts(s, d))


@query(
    "d3_directory_rollup",
    f"""{W}, f AS (SELECT string_split(rel_path, '/') AS fs FROM parts), e AS (SELECT fs, unnest(range(0, least(len(fs) - 1, 2) + 1)) AS k FROM f)
    SELECT CASE WHEN k = 0 THEN '.' ELSE array_to_string(fs[1:k], '/') END AS dir, count(*) FILTER (k = len(fs) - 1) AS direct_files, count(*) AS files FROM e GROUP BY 1""",
)
def _(s, d):
    return inv.directory_rollup(parts(s, d), 2)


_SIGNATURE = """, c AS (SELECT width, height FROM {t} WHERE error IS NULL GROUP BY ALL ORDER BY count(*) DESC, width DESC, height DESC LIMIT 1),
  n AS (SELECT source_split, class_dir, count(*) AS n FROM {t} WHERE source_split IN ('train', 'test') GROUP BY ALL), r(source_split, class_dir, want) AS ({want}),
  o AS (SELECT count(*) AS n_off FROM n FULL JOIN r USING (source_split, class_dir) WHERE n IS DISTINCT FROM want)
  SELECT 'casting' AS dataset, CASE WHEN (width, height) IN ((300, 300), (512, 512)) AND n_off = 0 THEN 'high' ELSE 'medium' END AS confidence, width, height, n_off FROM c, o"""
_PUBLISHED = "VALUES " + ", ".join(f"('{a}', '{b}', {n})" for (a, b), n in inv.CASTING_COUNTS.items())


@query("d4_dataset_signature", f"{W}{_SIGNATURE.format(t='parts', want=_PUBLISHED)}")
def _(s, d):
    return inv.dataset_signature(parts(s, d))


_AGAINST = "SELECT '{t}' AS release, * FROM (WITH " + _SIGNATURE[2:].replace("{want}", "SELECT * FROM k") + ")"


@query("d4_dataset_signature_exact", f"""{W}, k AS (SELECT source_split, class_dir, count(*) AS n FROM parts WHERE source_split IN ('train', 'test') GROUP BY ALL), lost AS (SELECT * FROM parts WHERE h % 97 <> 0)
  {_AGAINST.format(t='parts')} UNION ALL {_AGAINST.format(t='lost')}""")
def _(s, d):
    """The same match against the counts recorded of this release: of the release itself, and of one that lost some files on the way."""
    whole = materialize(parts(s, d), "release")
    recorded = inv.split_class_counts(whole.where("source_split in ('train', 'test')")).collect()  # at most two splits times the class folders
    counts = {(r["source_split"], r["class_dir"]): r["count"] for r in recorded}
    match = lambda rows, name: inv.dataset_signature(rows, counts).withColumn("release", F.lit(name))
    return match(whole, "parts").unionByName(match(whole.where("h % 97 != 0"), "lost"))


@query(
    "d5_class_counts",
    f"""{W}, e AS (SELECT * FROM (VALUES ('train'), ('val'), ('test'), ('external_test')) a(source_split), (VALUES ('def_front'), ('ok_front')) b(class_dir))
    SELECT source_split, class_dir, count(rel_path) AS n FROM e LEFT JOIN parts USING (source_split, class_dir) GROUP BY ALL""",
)
def _(s, d):
    return inv.class_counts(parts(s, d), ["train", "val", "test", "external_test"], ["def_front", "ok_front"])


_REASONS = f"""{W}, g AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY (source_split <> 'test')::INT, rel_path) AS k, min(label) OVER (PARTITION BY sha256) AS lo,
  max(label) OVER (PARTITION BY sha256) AS hi, {_FIRST} IN {_OUT} AS is_external FROM parts),
reasons AS (SELECT *, CASE WHEN lo <> hi THEN 'exact_duplicate_label_conflict' WHEN k > 1 THEN 'exact_duplicate' ELSE '' END AS exclude_reason,
  CASE class_dir WHEN 'def_front' THEN 'defective' ELSE 'normal' END AS class_name FROM g)"""


def reasons(s: SparkSession, d: str) -> DataFrame:
    p = parts(s, d).withColumn("is_external", inv.is_external(F.col("rel_path"), EXTERNAL))
    return inv.resolve_classes(sp.exact_duplicate_reasons(p), aliases(s), strict=False)


@query("e1_exact_duplicates", f"{_REASONS} SELECT rel_path, sha256, exclude_reason FROM reasons")
def _(s, d):
    return reasons(s, d).select("rel_path", "sha256", "exclude_reason")


_CROSSTAB = """SELECT coalesce(k, 'All') AS split_key, coalesce(class_name, 'All') AS class_name, count(*) AS n
FROM (SELECT CASE WHEN exclude_reason <> '' THEN 'excluded:' || exclude_reason ELSE source_split END AS k, class_name FROM reasons) GROUP BY CUBE (k, class_name)"""


@query("d6_split_crosstab", f"{_REASONS} {_CROSSTAB}")
def split_crosstab(s, d):
    return inv.split_crosstab(reasons(s, d), "source_split")


@query(
    "d7_split_report",
    f"""{_REASONS}, c AS (SELECT source_split AS split, count(*) AS n, sum(label) AS defects FROM reasons WHERE exclude_reason = '' GROUP BY 1)
    SELECT 'split' AS part, split AS key, n, round(n / sum(n) OVER ()::DOUBLE, 4) AS share, round(defects / n::DOUBLE, 4) AS defect_rate FROM c
    UNION ALL SELECT 'excluded', exclude_reason, count(*), NULL, NULL FROM reasons WHERE exclude_reason <> '' GROUP BY 2""",
)
def _(s, d):
    return inv.split_report(reasons(s, d).withColumnRenamed("source_split", "split"))


@query("f1_top_sizes", f"{W} SELECT width, height, count(*) AS count FROM parts GROUP BY ALL ORDER BY count DESC, width, height LIMIT 10")
def _(s, d):
    return inv.top_sizes(parts(s, d))


NEAR = 0.99
SHARES = [("train", 0.85), ("val", 0.15)]
_NEAR = f"{NEAR}e0"


def _reach(name: str, ids: str) -> str:
    """CTEs (recursive): ``<name>(id, component)`` over the near pairs and equal hashes of the stills in ``ids``."""
    return f"""{name}_e AS (SELECT query AS a, target AS b FROM allpairs WHERE corr >= {_NEAR} AND query IN (SELECT id FROM {ids}) AND target IN (SELECT id FROM {ids})
  UNION SELECT x.id, y.id FROM {ids} x JOIN {ids} y ON x.sha256 = y.sha256 AND x.id <> y.id),
{name}_r AS (SELECT id, id AS c FROM {ids} UNION SELECT {name}_r.id, b FROM {name}_r JOIN {name}_e ON a = c),
{name}_k AS (SELECT id, min(c) AS component FROM {name}_r GROUP BY id),
{name}_n AS (SELECT component, printf('g%05d', row_number() OVER (ORDER BY min(rel_path)) - 1) AS cluster_id FROM {name}_k JOIN {ids} USING (id) GROUP BY component),
{name} AS (SELECT id, cluster_id FROM {name}_k JOIN {name}_n USING (component))"""


def _alloc(name: str, members: str) -> str:
    """CTE ``<name>(cluster_id, majority, n, split)`` by the seeded order of clusters within a label."""
    return f"""{name}_c AS (SELECT cluster_id, count(*) AS n, (avg(label) >= 0.5)::INTEGER AS majority, ('0x' || substr(md5('42|' || cluster_id), 1, 8))::BIGINT / 4294967296e0 AS u FROM {members} GROUP BY cluster_id),
{name}_b AS (SELECT *, (sum(n) OVER (PARTITION BY majority ORDER BY u, cluster_id ROWS UNBOUNDED PRECEDING) - n) / (sum(n) OVER (PARTITION BY majority))::DOUBLE AS before FROM {name}_c),
{name} AS (SELECT cluster_id, majority, n, CASE WHEN before < 0.85e0 THEN 'train' ELSE 'val' END AS split FROM {name}_b)"""


_STILLS = f"WITH RECURSIVE {STILLS}, {matching_sql('stills')}"
_CLUSTERS = f"{_STILLS}, {_reach('cl', 'stills')}, members AS (SELECT stills.*, cluster_id FROM stills JOIN cl USING (id))"
_SPLITS = f"""{_STILLS}, g AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY (source_split <> 'test')::INT, rel_path) AS k, min(label) OVER (PARTITION BY sha256) AS lo,
  max(label) OVER (PARTITION BY sha256) AS hi FROM stills),
r0 AS (SELECT id, rel_path, sha256, label, source_split, is_external, CASE WHEN lo <> hi THEN 'exact_duplicate_label_conflict' WHEN k > 1 THEN 'exact_duplicate' ELSE '' END AS why FROM g),
te AS (SELECT id FROM r0 WHERE why = '' AND NOT is_external AND source_split = 'test'),
r1 AS (SELECT * REPLACE (CASE WHEN why = '' AND NOT is_external AND source_split <> 'test' AND id IN (SELECT query FROM allpairs WHERE corr >= {_NEAR} AND target IN (SELECT id FROM te))
  THEN 'near_duplicate_of_official_test' ELSE why END AS why) FROM r0),
pool AS (SELECT * FROM r1 WHERE why = '' AND NOT is_external AND source_split <> 'test'),
{_reach('pc', 'pool')}, pm AS (SELECT cluster_id, label FROM pool JOIN pc USING (id)), {_alloc('al', 'pm')},
r2 AS (SELECT r1.*, coalesce(pc.cluster_id, 's' || rel_path) AS cluster_id, coalesce(al.split, CASE WHEN r1.id IN (SELECT id FROM te) THEN 'test' ELSE '' END) AS place
  FROM r1 LEFT JOIN pc ON pc.id = r1.id LEFT JOIN al ON al.cluster_id = pc.cluster_id),
r3 AS (SELECT * REPLACE (CASE WHEN why = '' AND is_external AND id IN (SELECT query FROM allpairs WHERE corr >= {_NEAR} AND target IN (SELECT id FROM r2 WHERE place IN ('train', 'val')))
  THEN 'near_duplicate_of_train_or_val' ELSE why END AS why) FROM r2),
r4 AS (SELECT *, CASE WHEN why <> '' THEN 'excluded' WHEN is_external THEN 'external_test' ELSE place END AS split FROM r3),
sh AS (SELECT p.query, p.corr, b.split AS grp, a.split AS own, row_number() OVER (PARTITION BY p.query, b.split ORDER BY p.coarse DESC, p.target) AS k FROM allpairs p JOIN r4 a ON a.id = p.query JOIN r4 b ON b.id = p.target
  WHERE b.split IN ('train', 'val') AND a.split IN ('val', 'test', 'external_test')),
near AS (SELECT query, own, grp, max(corr) AS nearest FROM sh WHERE k <= {SHORTLIST} GROUP BY ALL),
splits AS (SELECT r4.id, rel_path, sha256, label, cluster_id, split, why AS exclude_reason, nearest AS nearest_train_similarity FROM r4 LEFT JOIN near ON near.query = r4.id AND grp = 'train' AND own <> 'val')"""


def splits(s: SparkSession, d: str, nearest: bool = False) -> DataFrame:
    """The written split table of the stills, with the nearest train similarity only where it is asked for."""
    return sp.make_splits(stills(s, d), strategy="auto", shares=SHARES, threshold=NEAR, seed=42, nearest=nearest)


def members(s: SparkSession, d: str) -> DataFrame:
    """The stills with their clusters."""
    images = materialize(stills(s, d), "stills")
    return images.join(sp.cluster_images(images, NEAR).hint("merge"), "id")


@query("c5_duplicate_edges", f"{_CLUSTERS} SELECT id, component FROM cl_k")
def _(s, d):
    """All links (equal hash or near copy) by what they join: the component of every still."""
    images = materialize(stills(s, d), "stills")
    found = connected_components(sp.duplicate_edges(images, NEAR), "query", "target")
    return images.select("id").join(found.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("c5_hash_edges", f"{W}, f AS (SELECT sha256, min(rel_path) AS target FROM parts GROUP BY sha256) SELECT rel_path AS query, target FROM parts JOIN f USING (sha256) WHERE rel_path <> target")
def _(s, d):
    return sp.hash_edges(parts(s, d))


@query("e2_allocate_clusters", f"{_CLUSTERS}, {_alloc('al', 'members')} SELECT cluster_id, majority, n, split FROM al")
def _(s, d):
    return sp.allocate_clusters(sp.majority_label(members(s, d)), SHARES, 42)


@query("e3_majority_label", f"{_CLUSTERS} SELECT cluster_id, count(*) AS n, (avg(label) >= 0.5)::INTEGER AS majority FROM members GROUP BY cluster_id")
def _(s, d):
    return sp.majority_label(members(s, d))


@query("i2_make_splits", f"{_SPLITS} SELECT rel_path, sha256, label, cluster_id, split, exclude_reason, round(nearest_train_similarity, 6) AS nearest_train_similarity FROM splits")
def _(s, d):
    return splits(s, d, nearest=True).withColumn("nearest_train_similarity", F.round("nearest_train_similarity", 6))


@query("i2_random_splits", f"""{_STILLS}, g AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY (source_split <> 'test')::INT, rel_path) AS k, min(label) OVER (PARTITION BY sha256) AS lo,
  max(label) OVER (PARTITION BY sha256) AS hi FROM stills), pool AS (SELECT * FROM g WHERE lo = hi AND k = 1 AND NOT is_external), {_reach('pc', 'pool')}, pm AS (SELECT cluster_id, label FROM pool JOIN pc USING (id)),
  {_alloc('al', 'pm').replace("CASE WHEN before < 0.85e0 THEN 'train' ELSE 'val' END", "CASE WHEN before < 0.7e0 THEN 'train' WHEN before < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END")}
  SELECT rel_path, cluster_id, al.split FROM pool JOIN pc USING (id) JOIN al USING (cluster_id)""")
def _(s, d):
    """The random strategy: whole clusters of all rows that aren't external, in three shares."""
    shares = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
    out = sp.make_splits(stills(s, d), strategy="random", shares=shares, threshold=NEAR, seed=42, nearest=False)
    return out.where("split in ('train', 'val', 'test')").select("rel_path", "cluster_id", "split")


@query("c12_cluster_split_map", f"{_SPLITS} SELECT rel_path, split FROM splits WHERE split IN ('train', 'val')")
def _(s, d):
    return splits(s, d).where("split in ('train', 'val')").select("rel_path", "split")


@query("c6_exclude_near_duplicates", f"{_SPLITS} SELECT rel_path, exclude_reason FROM splits WHERE exclude_reason LIKE 'near%'")
def _(s, d):
    return splits(s, d).where(F.col("exclude_reason").startswith("near")).select("rel_path", "exclude_reason")


_PAIRS = "(" + " OR ".join(f"own = '{a}' AND grp = '{b}'" for a, b in sp.CROSS_CHECKS) + ")"


def _cross(near: str, placed: str) -> str:
    """CTE ``cross_rows``: information from the shortlisted ``near``, and the rows at the threshold from all pairs of the rows ``placed``."""
    return f"""hit_rows AS (SELECT a.split AS own, b.split AS grp, count(DISTINCT p.query) AS n_threshold FROM allpairs p JOIN {placed} a ON a.id = p.query JOIN {placed} b ON b.id = p.target
  WHERE p.corr >= {_NEAR} GROUP BY ALL),
cross_rows AS (SELECT own AS eval_split, grp AS train_side, n, coalesce(n_threshold, 0) AS n_threshold, n_info, max, median
  FROM (SELECT own, grp, count(*) AS n, count(*) FILTER (nearest >= 0.5e0) AS n_info, round(max(nearest), 5) AS max, round(median(nearest), 5) AS median FROM {near} WHERE {_PAIRS} GROUP BY ALL)
  LEFT JOIN hit_rows USING (own, grp))"""


_CROSS = _cross("near", "splits")


@query("c8_cross_split_matrix", f"{_SPLITS}, {_CROSS} SELECT * FROM cross_rows")
def _(s, d):
    return sp.run_audit(stills(s, d), splits(s, d), NEAR, 0.5)[1]


_CHECKS = """kept AS (SELECT * FROM sp WHERE split <> 'excluded'),
  needed AS (SELECT s, y FROM (VALUES ('train', 0), ('train', 1), ('val', 0), ('val', 1), ('test', 0), ('test', 1), ('external_test', 0), ('external_test', 1)) v(s, y)),
  have AS (SELECT DISTINCT split, label FROM kept), outside AS (SELECT count(*) AS n FROM kept WHERE split = 'external_test'),
  account AS (SELECT (SELECT count(*) FROM stills WHERE rel_path NOT IN (SELECT rel_path FROM sp)) + (SELECT count(*) FROM sp WHERE rel_path NOT IN (SELECT rel_path FROM stills))
      + (SELECT count(*) FROM sp WHERE split = 'excluded' AND exclude_reason = '') AS d1),
  hashes AS (SELECT count(*) AS d2 FROM (SELECT sha256 FROM kept GROUP BY 1 HAVING count(DISTINCT split) > 1)),
  groups AS (SELECT count(*) AS d3 FROM (SELECT cluster_id FROM kept GROUP BY 1 HAVING count(DISTINCT split) > 1)),
  alike AS (SELECT coalesce(sum(n_threshold), 0)::BIGINT AS d4 FROM cross_rows),
  classes AS (SELECT count(*) FILTER (label IS NULL AND (s <> 'external_test' OR n > 0)) AS d5 FROM needed CROSS JOIN outside LEFT JOIN have ON split = s AND label = y),
  one AS (SELECT * FROM account, hashes, groups, alike, classes),
  listed AS (SELECT unnest(['all_rows_accounted_for', 'no_sha256_in_two_splits', 'no_cluster_in_two_splits', 'no_near_duplicates_across_splits', 'every_split_has_both_classes', 'passed']) AS name,
    unnest([d1, d2, d3, d4, d5, (d1 > 0)::INTEGER + (d2 > 0)::INTEGER + (d3 > 0)::INTEGER + (d4 > 0)::INTEGER + (d5 > 0)::INTEGER]) AS detail FROM one)
  SELECT name, detail = 0 AS ok, detail FROM listed"""


@query("i3_leakage_audit", f"{_SPLITS}, {_CROSS}, sp AS (SELECT * FROM splits), {_CHECKS}")
def _(s, d):
    return sp.run_audit(stills(s, d), splits(s, d), NEAR, 0.5)[0]


def _tampered(split_table: DataFrame) -> DataFrame:
    """The split table with some rows dropped, some reasons wiped and some training rows called test."""
    h = hash32(F.col("rel_path"))
    rows = split_table.where(h % 29 != 0)
    rows = rows.withColumn("exclude_reason", F.when(h % 3 == 0, "").otherwise(F.col("exclude_reason")))
    return rows.withColumn("split", F.when((F.col("split") == "train") & (h % 5 == 0), "test").otherwise(F.col("split")))


_TAMPERED = """sp AS (SELECT * REPLACE (CASE WHEN h % 3 = 0 THEN '' ELSE exclude_reason END AS exclude_reason, CASE WHEN split = 'train' AND h % 5 = 0 THEN 'test' ELSE split END AS split)
  FROM (SELECT *, ('0x' || substr(md5(rel_path), 1, 8))::BIGINT AS h FROM splits) WHERE h % 29 <> 0)"""


@query(
    "i3_tampered_audit",
    f"""{_SPLITS}, {_TAMPERED}, sh2 AS (SELECT p.query, p.corr, b.split AS grp, a.split AS own, row_number() OVER (PARTITION BY p.query, b.split ORDER BY p.coarse DESC, p.target) AS k FROM allpairs p
      JOIN sp a ON a.id = p.query JOIN sp b ON b.id = p.target WHERE b.split IN ('train', 'val') AND a.split IN ('val', 'test', 'external_test')),
    near2 AS (SELECT query, own, grp, max(corr) AS nearest FROM sh2 WHERE k <= {SHORTLIST} GROUP BY ALL), {_cross('near2', 'sp')}, {_CHECKS}""",
)
def _(s, d):
    """The audit of a split table that was tampered with: it fails, and says where."""
    return sp.run_audit(stills(s, d), materialize(_tampered(splits(s, d)), "tampered"), NEAR, 0.5)[0]


@query("i3_fingerprints", f"""{_SPLITS}, n AS (SELECT * FROM (VALUES ('test'), ('external_test')) t(split)), k AS (SELECT split, sha256 FROM splits WHERE split IN ('test', 'external_test'))
  SELECT n.split, count(sha256) AS n, sha256(coalesce(string_agg(sha256, chr(10) ORDER BY sha256), '')) AS fingerprint FROM n LEFT JOIN k ON k.split = n.split GROUP BY n.split""")
def _(s, d):
    return sp.split_fingerprints(splits(s, d))


@query("c7_accounting", f"""{_SPLITS}, {_TAMPERED} SELECT (SELECT count(*) FROM stills WHERE rel_path NOT IN (SELECT rel_path FROM sp)) AS missing, (SELECT count(*) FROM sp WHERE rel_path NOT IN (SELECT rel_path FROM stills)) AS extra,
  (SELECT count(*) FROM stills WHERE rel_path NOT IN (SELECT rel_path FROM sp)) + (SELECT count(*) FROM sp WHERE rel_path NOT IN (SELECT rel_path FROM stills)) = 0 AS ok""")
def _(s, d):
    """The accounting check of a split table that has lost rows."""
    return sp.same_paths(stills(s, d), _tampered(splits(s, d)))


@query("d11_key_in_two_splits", f"{W} SELECT sha256 FROM parts GROUP BY sha256 HAVING count(DISTINCT source_split) > 1")
def _(s, d):
    return sp.keys_in_two_splits(parts(s, d), "sha256", "source_split")


@query("d12_both_classes", f"{_SPLITS} SELECT split, count(DISTINCT label) = 2 AS both_classes FROM splits WHERE exclude_reason = '' GROUP BY split")
def _(s, d):
    rows = splits(s, d).where("exclude_reason = ''")
    return rows.groupBy("split").agg((F.count_distinct("label") == 2).alias("both_classes"))


@query(
    "d8_cluster_report",
    f"""{_CLUSTERS}, c AS (SELECT cluster_id, count(*) AS n, count(DISTINCT label) AS labels FROM members GROUP BY cluster_id), e AS (SELECT count(*) AS n FROM stills GROUP BY sha256),
    l AS (SELECT * FROM allpairs WHERE corr >= {_NEAR})
    SELECT count(*) AS n_clusters, count(*) FILTER (n > 1) AS n_multi, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS images_in_multi, max(n) AS largest, count(*) FILTER (labels > 1) AS n_conflicts,
      (SELECT count(*) FILTER (n > 1) FROM e) AS exact_groups, (SELECT sum(n - 1)::BIGINT FROM e) AS extra_copies, (SELECT count(*) FROM l) AS n_links,
      (SELECT count(*) FILTER (via_transform) FROM l) AS links_via_transform, (SELECT round(min(corr), 6) FROM l) AS min_link FROM c""",
)
def _(s, d):
    rows = materialize(members(s, d), "members")
    return sp.cluster_report(rows, NEAR).withColumn("min_link", F.round("min_link", 6))


@query("d8_cluster_sizes", f"{_CLUSTERS} SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM members GROUP BY cluster_id) GROUP BY size")
def _(s, d):
    return sp.cluster_size_histogram(members(s, d))


@query("d9_label_conflicts", f"{_CLUSTERS} SELECT cluster_id FROM members GROUP BY cluster_id HAVING count(DISTINCT label) > 1")
def _(s, d):
    return members(s, d).groupBy("cluster_id").agg(F.count_distinct("label").alias("n")).where("n > 1").select("cluster_id")


@query("e4_cluster_numbers", f"{_CLUSTERS} SELECT rel_path, cluster_id FROM members")
def _(s, d):
    return members(s, d).select("rel_path", "cluster_id")


@query("c1_eda_frame", f"{_SPLITS} SELECT s.rel_path, s.split, s.label, p.width, p.height, p.mode, p.size_bytes FROM splits s JOIN stills p USING (rel_path) WHERE s.split IN ('train', 'val')")
def eda_frame(s, d):
    meta = stills(s, d).select("rel_path", "width", "height", "mode", "size_bytes")
    return splits(s, d).where("split in ('train', 'val')").select("rel_path", "split", "label").join(meta.hint("merge"), "rel_path")


@query("d34_class_balance", f"{_SPLITS} SELECT coalesce(split, 'All') AS split, count(*) AS n, sum(label)::BIGINT AS defects FROM splits WHERE exclude_reason = '' GROUP BY ROLLUP (split)")
def _(s, d):
    rows = splits(s, d).where("exclude_reason = ''").rollup("split").agg(F.count("*").alias("n"), F.sum("label").alias("defects"))
    return rows.select(F.coalesce("split", F.lit("All")).alias("split"), "n", "defects")


@query("d34_size_facets", f"{_SPLITS} SELECT p.width, p.height, p.mode, count(*) AS n FROM splits s JOIN stills p USING (rel_path) WHERE s.split IN ('train', 'val') GROUP BY ALL")
def _(s, d):
    return eda_frame(s, d).groupBy("width", "height", "mode").agg(F.count("*").alias("n"))


@query(
    "f2_largest_clusters",
    f"""{_CLUSTERS}, c AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 6)
    SELECT cluster_id, n, rel_path, k FROM (SELECT c.cluster_id, n, rel_path, row_number() OVER (PARTITION BY c.cluster_id ORDER BY rel_path) AS k FROM members JOIN c ON c.cluster_id = members.cluster_id) WHERE k <= 8""",
)
def _(s, d):
    from pyspark.sql import Window

    p = materialize(members(s, d).select("cluster_id", "rel_path"), "members")
    top = p.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(6)
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rel_path"))
    return p.join(F.broadcast(top), "cluster_id").withColumn("k", k).where("k <= 8").select("cluster_id", "n", "rel_path", "k")


@query("f5_sample_per_class", f"{W}, r AS (SELECT rel_path, class_dir, row_number() OVER (PARTITION BY class_dir ORDER BY md5('7|' || rel_path), rel_path) AS k FROM parts) SELECT rel_path, class_dir, k FROM r WHERE k <= 5")
def _(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("class_dir").orderBy(F.md5(F.concat(F.lit("7|"), F.col("rel_path")).cast("binary")), "rel_path")
    return parts(s, d).select("rel_path", "class_dir", F.row_number().over(order).alias("k")).where("k <= 5")


@query("f7_global_sort", f"{W} SELECT rel_path, source_split, size_bytes FROM parts ORDER BY rel_path")
def _(s, d):
    return parts(s, d).select("rel_path", "source_split", "size_bytes").orderBy("rel_path")


@query("g1_union_splits", f"{W} SELECT rel_path, 'held' AS kind FROM parts WHERE source_split = 'test' UNION ALL SELECT rel_path, 'pool' FROM parts WHERE source_split <> 'test'")
def _(s, d):
    p = parts(s, d)
    held = p.where("source_split = 'test'").select("rel_path", F.lit("held").alias("kind"))
    return held.unionByName(p.where("source_split != 'test'").select("rel_path", F.lit("pool").alias("kind")))


@query("g2_difference", f"{W} SELECT sha256 FROM parts WHERE source_split <> 'test' EXCEPT SELECT sha256 FROM parts WHERE source_split = 'test'")
def _(s, d):
    p = parts(s, d)
    return p.where("source_split != 'test'").select("sha256").subtract(p.where("source_split = 'test'").select("sha256"))


@query("g3_set_equality", f"{W}, a AS (SELECT rel_path FROM parts WHERE error IS NULL), b AS (SELECT rel_path FROM parts) SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS extra, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS missing")
def _(s, d):
    p = parts(s, d)
    return sp.same_paths(p.where("error is null"), p).select("extra", "missing")


@query("g4_intersection", f"{W} SELECT sha256 FROM parts WHERE source_split = 'train' INTERSECT SELECT sha256 FROM parts WHERE source_split = 'test'")
def _(s, d):
    p = parts(s, d)
    return p.where("source_split = 'train'").select("sha256").intersect(p.where("source_split = 'test'").select("sha256"))


@query("g5_distinct_hashes", f"{W} SELECT DISTINCT sha256 FROM parts")
def _(s, d):
    return parts(s, d).select("sha256").distinct()


@query("h9_path_parts", rf"{W} SELECT rel_path, {_FIRST} AS top, regexp_extract(rel_path, '([^/]+)\.[^./]+$', 1) AS stem, {_EXT} AS ext FROM parts")
def _(s, d):
    return parts(s, d).select("rel_path", F.split("rel_path", "/")[0].alias("top"), F.regexp_extract("rel_path", r"([^/]+)\.[^./]+$", 1).alias("stem"), inv.extension(F.col("rel_path")).alias("ext"))
