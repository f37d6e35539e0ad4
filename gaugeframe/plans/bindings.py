"""Views over the given tables that stand for the engine's inputs, as DataFrames and as DuckDB SQL.

``parts`` (an inventory of files) comes from documents and labels, ``thumbs``
(thumbnails with planted copies) from embeddings, ``logits`` (a scored split)
from lineitem, ``history`` (training epochs) from orders and ``request_log`` (a
serving log) from events.  Each pair of definitions gives equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.arrays import orientation_maps

CLASSES = {"def_front": "defective", "ok_front": "normal"}
EXTERNAL = ("src3", "src11")
TEMPERATURE, THRESHOLD, BAND = 1.3, 0.6, (0.35, 0.8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash32(c: Column) -> Column:
    """The first 32 bits of the MD5 of a value's text, as a number."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def _h(sql: str) -> str:
    return f"('0x' || substr(md5(({sql})::VARCHAR), 1, 8))::BIGINT"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path, doc_id, label, class_dir, source_split, sha256, size_bytes, width, height, mode, format, error, brightness, similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    h, t = F.col("h"), F.col("t")
    rows = docs.join(labels, "doc_id", "left").withColumns({"h": hash32(F.col("doc_id")), "t": hash32(F.col("text"))})
    split = F.when(h % 20 < 12, "train").when(h % 20 < 15, "Test").when(h % 20 < 17, "val")
    label = F.coalesce("quality", t % 2).cast("int")
    ext = F.when(h % 50 == 0, "txt").when(h % 3 == 0, "jpg").otherwise("png")
    rows = rows.select(
        "doc_id", "h", "t", label.alias("label"), F.when(label == 1, "def_front").otherwise("ok_front").alias("class_dir"),
        F.coalesce(F.lower(split), F.lit("(none)")).alias("source_split"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"),
        F.when(h % 5 == 0, 300).otherwise(512).alias("width"), F.when(h % 41 == 0, 480).otherwise(F.when(h % 5 == 0, 300).otherwise(512)).alias("height"),
        F.when(h % 7 < 5, "L").otherwise("RGB").alias("mode"), F.when((ext == "jpg") | (h % 37 == 0), "JPEG").otherwise("PNG").alias("format"),
        F.when(h % 101 == 0, "truncated").alias("error"), (60 + (t % 1000) / 10).alias("brightness"), (0.9 + (h % 1000) / 10000).alias("similarity"),
        F.concat_ws("/", "source", split, F.when(label == 1, "def_front").otherwise("ok_front"), F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)).alias("rel_path"),
    )
    return rows


PARTS = f"""
parts AS (
  SELECT doc_id, h, t, label, class_dir, coalesce(lower(split), '(none)') AS source_split, sha256(text) AS sha256, n_chars AS size_bytes, width,
    CASE WHEN h % 41 = 0 THEN 480 ELSE width END AS height, CASE WHEN h % 7 < 5 THEN 'L' ELSE 'RGB' END AS mode,
    CASE WHEN ext = 'jpg' OR h % 37 = 0 THEN 'JPEG' ELSE 'PNG' END AS format, CASE WHEN h % 101 = 0 THEN 'truncated' END AS error,
    60 + (t % 1000) / 10e0 AS brightness, 0.9e0 + (h % 1000) / 10000e0 AS similarity,
    concat_ws('/', source, split, class_dir, doc_id::VARCHAR || '.' || ext) AS rel_path
  FROM (SELECT *, CASE WHEN label = 1 THEN 'def_front' ELSE 'ok_front' END AS class_dir, CASE WHEN h % 5 = 0 THEN 300 ELSE 512 END AS width,
          CASE WHEN h % 50 = 0 THEN 'txt' WHEN h % 3 = 0 THEN 'jpg' ELSE 'png' END AS ext,
          CASE WHEN h % 20 < 12 THEN 'train' WHEN h % 20 < 15 THEN 'Test' WHEN h % 20 < 17 THEN 'val' END AS split
        FROM (SELECT d.*, {_h('d.doc_id')} AS h, {_h('d.text')} AS t, coalesce(l.quality, {_h('d.text')} % 2)::INTEGER AS label
              FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, split, margin (rounded to 3 places, so with ties), p, similarity, brightness."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")))
    rows = table(spark, sf_dir, "lineitem").select(key.alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_quantity").withColumn("h", hash32(F.col("id")))
    margin = F.round(F.when(F.col("label") == 1, 1.0).otherwise(-1.0) + 4 * ((F.col("h") % 100003) / 100003.0 - 0.5), 3)
    split = F.when(F.col("h") % 10 < 4, "val").when(F.col("h") % 10 < 7, "test").otherwise("external_test")
    rows = rows.withColumn("margin", margin).withColumn("split", split)
    return rows.select(
        "id", "h", "label", "split", "margin", F.round(1 / (1 + F.exp(-F.col("margin") / TEMPERATURE)), 9).alias("p"),
        (0.9 + (F.col("h") % 1000) / 10000).alias("similarity"), (50 + (F.col("h") % 1709) / 10 - 5 * F.col("margin")).alias("brightness"),
    )


LOGITS = f"""
logits AS (
  SELECT id, h, label, split, margin, round(1e0 / (1e0 + exp(-margin / {TEMPERATURE}e0)), 9) AS p, 0.9e0 + (h % 1000) / 10000e0 AS similarity,
    50 + (h % 1709) / 10e0 - 5 * margin AS brightness
  FROM (SELECT *, round(CASE WHEN label = 1 THEN 1e0 ELSE -1e0 END + 4 * ((h % 100003) / 100003e0 - 0.5e0), 3) AS margin,
          CASE WHEN h % 10 < 4 THEN 'val' WHEN h % 10 < 7 THEN 'test' ELSE 'external_test' END AS split
        FROM (SELECT *, {_h('id')} AS h FROM (
          SELECT concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_shipdate::VARCHAR) AS id,
            (l_returnflag = 'R')::INTEGER AS label FROM lineitem))))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logits with predicted, correct and needs_review at the fixed operating point."""
    from gaugeframe.functions.scores import decide

    return decide(logits(spark, sf_dir), THRESHOLD, *BAND).withColumn("correct", F.col("predicted") == F.col("label"))


PREDICTIONS = (
    LOGITS
    + f""",
predictions AS (
  SELECT *, (p >= {THRESHOLD}e0)::INTEGER AS predicted, CASE WHEN p >= {THRESHOLD}e0 THEN p ELSE 1 - p END AS confidence,
    p >= {BAND[0]}e0 AND p < {BAND[1]}e0 AS needs_review, (p >= {THRESHOLD}e0)::INTEGER = label AS correct FROM logits)"""
)

SIDE = 8

PLANT_EVERY = 25


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fine (64 numbers) and label: all embeddings, and for each 25th a turned or flipped copy, half as bright plus 0.1."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("fine"), "label")
    maps = F.array(*(F.array(*(F.lit(i) for i in m)) for m in orientation_maps(SIDE)))
    turn = F.element_at(maps, ((F.col("id") / PLANT_EVERY).cast("int") % 8) + 1)
    planted = base.where(F.col("id") % PLANT_EVERY == 0).select(
        (F.col("id") + 1_000_000).alias("id"), F.transform(turn, lambda i: F.element_at("fine", i + 1) * 0.5 + 0.1).alias("fine"), "label"
    )
    return base.unionByName(planted)


THUMBS = f"""
maps AS (SELECT * FROM (VALUES {', '.join(f'({k}, {m})' for k, m in enumerate(orientation_maps(SIDE)))}) AS t(k, m)),
thumbs AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS fine, label FROM embeddings
  UNION ALL
  SELECT vec_id + 1000000, list_transform(m, lambda i: (embedding[i + 1])::DOUBLE * 0.5e0 + 0.1e0), label
  FROM embeddings JOIN maps ON k = (vec_id // {PLANT_EVERY}) % 8 WHERE vec_id % {PLANT_EVERY} = 0)"""


def stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails as an inventory with pixels: those of ``thumbs``, and for each 40th row an equal copy elsewhere.

    Columns: id, fine, sha256 (of the pixels in millionths), label, source_split, rel_path, is_external, width, height, mode, size_bytes.
    """
    rows = thumbs(spark, sf_dir)
    copies = rows.where("id < 1000000 and id % 40 = 3").withColumn("id", F.col("id") + 2_000_000)
    rows = rows.unionByName(copies).withColumn("h", hash32(F.col("id")))
    pixels = F.array_join(F.transform("fine", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    h, label = F.col("h"), (F.col("label") % 2).cast("int")
    split = F.when(h % 20 < 12, "train").when(h % 20 < 15, "test").when(h % 20 < 17, "val").otherwise("(none)")
    top = F.when(h % 9 == 4, "other_site").otherwise("casting")
    path = F.concat_ws("/", top, split, F.when(label == 1, "def_front").otherwise("ok_front"), F.concat(F.col("id").cast("string"), F.lit(".png")))
    side = F.when(h % 5 == 0, 300).otherwise(512)
    return rows.select(
        "id", "fine", F.sha2(pixels, 256).alias("sha256"), label.alias("label"), split.alias("source_split"), path.alias("rel_path"), (top == "other_site").alias("is_external"),
        side.alias("width"), F.when(h % 41 == 0, 480).otherwise(side).alias("height"), F.when(h % 7 < 5, "L").otherwise("RGB").alias("mode"), (1000 + h % 90_000).alias("size_bytes"),
    )


STILLS = f"""{THUMBS},
stills AS (
  SELECT id, fine, sha256(list_aggregate(list_transform(fine, lambda x: round(x * 1000000)::BIGINT::VARCHAR), 'string_agg', ',')) AS sha256, (label % 2)::INTEGER AS label,
    split AS source_split, concat_ws('/', top, split, CASE WHEN label % 2 = 1 THEN 'def_front' ELSE 'ok_front' END, id::VARCHAR || '.png') AS rel_path, top = 'other_site' AS is_external,
    CASE WHEN h % 5 = 0 THEN 300 ELSE 512 END AS width, CASE WHEN h % 41 = 0 THEN 480 WHEN h % 5 = 0 THEN 300 ELSE 512 END AS height, CASE WHEN h % 7 < 5 THEN 'L' ELSE 'RGB' END AS mode, 1000 + h % 90000 AS size_bytes
  FROM (SELECT *, CASE WHEN h % 20 < 12 THEN 'train' WHEN h % 20 < 15 THEN 'test' WHEN h % 20 < 17 THEN 'val' ELSE '(none)' END AS split,
          CASE WHEN h % 9 = 4 THEN 'other_site' ELSE 'casting' END AS top
        FROM (SELECT *, {_h('id')} AS h FROM (SELECT * FROM thumbs UNION ALL SELECT id + 2000000, fine, label FROM thumbs WHERE id < 1000000 AND id % 40 = 3))))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, stage, epoch, val_pr_auc, val_loss, train_pr_auc: one pseudo-epoch for each clerk group and month of orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "MM").cast("int").alias("m"))
    o = o.withColumn("h", hash32(F.col("o_orderkey")))
    epoch = F.when(F.col("m") <= 3, F.col("m")).otherwise(F.col("m") - 3)
    g = o.groupBy(F.concat(F.lit("run"), F.col("y")).alias("run"), F.when(F.col("m") <= 3, "head").otherwise("finetune").alias("stage"), epoch.alias("epoch"))
    score = F.sum("h") % 1000
    return g.agg(F.count("*").alias("n"), (0.8 + score / 10000).alias("val_pr_auc"), (0.5 - score / 5000 + F.count("*") % 7 / 100).alias("val_loss"), (0.85 + F.sum("h") % 777 / 10000).alias("train_pr_auc"))


HISTORY = f"""
history AS (
  SELECT 'run' || y AS run, CASE WHEN m <= 3 THEN 'head' ELSE 'finetune' END AS stage, CASE WHEN m <= 3 THEN m ELSE m - 3 END AS epoch, count(*) AS n,
    0.8e0 + (sum(h) % 1000)::BIGINT / 10000e0 AS val_pr_auc, 0.5e0 - (sum(h) % 1000)::BIGINT / 5000e0 + (count(*) % 7) / 100e0 AS val_loss,
    0.85e0 + (sum(h) % 777)::BIGINT / 10000e0 AS train_pr_auc
  FROM (SELECT year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::INTEGER AS m, {_h('o_orderkey')} AS h FROM orders) GROUP BY 1, 2, 3)"""

ROUTES = ("/v1/predict", "/v1/predict/batch", "/v1/model")


def with_request_columns(events: DataFrame) -> DataFrame:
    """A row of events as a row of the serving log; works on a stream too."""
    h = hash32(F.col("event_id"))
    route = F.when(F.col("event_type") == "view", ROUTES[0]).when(F.col("event_type") == "click", ROUTES[1]).otherwise(ROUTES[2])
    status = F.when(F.col("event_type") != "error", 200).when(h % 4 == 0, 401).when(h % 4 == 1, 415).when(h % 4 == 2, 429).otherwise(503)
    p = F.round((h % 1000) / 1000.0, 3)
    return events.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("caller"), F.when(h % 9 == 0, "GET").otherwise("POST").alias("method"),
        route.alias("route"), status.alias("status"), (F.col("value") / 100).alias("seconds"), p.alias("p"), (p >= 0.6).cast("int").alias("predicted"),
        ((p >= 0.35) & (p < 0.8)).alias("needs_review"), F.when(h % 3 == 0, "v2").otherwise("v1").alias("model_version"), "props",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_request_columns(table(spark, sf_dir, "events"))


REQUEST_LOG = f"""
request_log AS (
  SELECT event_id AS request_id, ts, user_id AS caller, CASE WHEN h % 9 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CASE event_type WHEN 'view' THEN '{ROUTES[0]}' WHEN 'click' THEN '{ROUTES[1]}' ELSE '{ROUTES[2]}' END AS route,
    CASE WHEN event_type <> 'error' THEN 200 WHEN h % 4 = 0 THEN 401 WHEN h % 4 = 1 THEN 415 WHEN h % 4 = 2 THEN 429 ELSE 503 END AS status,
    value / 100 AS seconds, round((h % 1000) / 1000e0, 3) AS p, (round((h % 1000) / 1000e0, 3) >= 0.6e0)::INTEGER AS predicted,
    round((h % 1000) / 1000e0, 3) >= 0.35e0 AND round((h % 1000) / 1000e0, 3) < 0.8e0 AS needs_review, CASE WHEN h % 3 = 0 THEN 'v2' ELSE 'v1' END AS model_version, props
  FROM (SELECT *, {_h('event_id')} AS h FROM events))"""
