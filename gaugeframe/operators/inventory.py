"""Inventory and manifest operators over a table of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File kinds, folder names that mean a split, magic numbers, limits and statuses of the service.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
SPLIT_ALIASES = {
    "train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test",
}
NONE = "(none)"
LIMITS = {"bytes": 5 * 1024 * 1024, "side_min": 32, "side_max": 4096, "pixels": 16_000_000, "aspect": 4.0}
#: Published counts and sizes of the casting data set.
CASTING_COUNTS = {("train", "def_front"): 3758, ("train", "ok_front"): 2875, ("test", "def_front"): 453, ("test", "ok_front"): 262}
CASTING_SIZES = ((300, 300), (512, 512))
CLASS_NAMES, POSITIVE_CLASS = ("normal", "defective"), "defective"
CHANNELS = {"1": 1, "L": 1, "I": 1, "F": 1, "P": 1, "I;16": 1, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4, "RGBX": 4, "HSV": 3, "LAB": 3, "YCbCr": 3}
ERROR_STATUS = {"unauthorized": 401, "unsupported_media_type": 415, "rate_limited": 429, "overloaded": 503}


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def detect_split(path: Column) -> Column:
    """The first folder (the file name left out) whose lower-cased name means a split, else ``(none)``."""
    known = F.create_map(*(F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv))
    folders = F.split(path, "/")
    found = F.filter(F.transform(F.slice(folders, 1, F.size(folders) - 1), lambda f: F.try_element_at(known, F.lower(f))), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(NONE))


def class_dir(path: Column) -> Column:
    """The parent folder's name, ``(none)`` at the root."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(NONE))


def resolve_classes(df: DataFrame, aliases: DataFrame, *, strict: bool = True) -> DataFrame:
    """Inner join to the alias table (class_dir, class_name); with ``strict`` unmapped folders raise, all of them listed in order.

    The error is raised by the query itself, from a row that Spark joins, so nothing is collected before.
    """
    if not strict:
        return df.join(aliases, "class_dir")
    missing = df.select("class_dir").distinct().join(aliases, "class_dir", "left_anti").agg(F.sort_array(F.collect_set("class_dir")).alias("names"))
    text = F.concat(F.lit("unmapped class folders: "), F.array_join("names", ", "))
    checked = missing.select(F.when(F.size("names") == 0, True).otherwise(F.raise_error(text).cast("boolean")).alias("_mapped"))
    return df.crossJoin(F.broadcast(checked)).where("_mapped").drop("_mapped").join(aliases, "class_dir")


def is_external(path: Column, folders: tuple[str, ...]) -> Column:
    return F.split(path, "/")[0].isin(*folders)


def resolve_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """One row: ``official`` or ``random``; ``official`` without test rows raises in the query."""
    has_test = F.coalesce(F.bool_or(F.col("source_split") == "test"), F.lit(False))
    chosen = F.when(F.lit(strategy) == "random", "random").when(has_test, "official").when(F.lit(strategy) == "auto", "random")
    return df.agg(F.coalesce(chosen, F.raise_error(F.lit("official split asked for, but there is no test folder"))).alias("strategy"))


def build_manifest(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Decodable rows with class and label in the manifest's columns, ordered by path."""
    rows = resolve_classes(df.where("error is null"), aliases)
    rows = rows.withColumn("label", (F.col("class_name") == "defective").cast("int"))
    return rows.select("rel_path", "class_dir", "class_name", "label", "source_split", "sha256", "width", "height", "mode", "size_bytes").orderBy("rel_path")


def checksum_lines(df: DataFrame, name: str = "rel_path") -> DataFrame:
    """Lines of a checksum file, ordered by name."""
    return df.select(F.format_string("%s  %s", F.col("sha256"), F.col(name)).alias("line"), F.col(name)).orderBy(name).select("line")


def verify_checksums(lines: DataFrame, files: DataFrame, *, flat: bool = True) -> DataFrame:
    """Problem rows (name, problem): malformed lines, unsafe names, missing files, other contents.

    A name is unsafe with a backslash or a part that starts with a dot, and where it holds a slash (``flat``, files of one folder)
    or, for trees, begins with one.

    Without any line the manifest itself is missing: one row.
    """
    parsed = lines.select("line", F.regexp_extract("line", r"^([0-9a-f]{64})  (.+)$", 1).alias("want"), F.regexp_extract("line", r"^([0-9a-f]{64})  (.+)$", 2).alias("name"))
    joined = parsed.join(files.select(F.col("rel_path").alias("name"), "sha256"), "name", "left")
    unsafe = F.col("name").contains("/") if flat else F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    unsafe = unsafe | F.col("name").contains("\\") | F.exists(F.split("name", "/"), lambda x: x.startswith("."))
    problem = F.when(F.col("want") == "", "malformed line").when(unsafe, "unsafe name").when(F.col("sha256").isNull(), "missing file").when(F.col("sha256") != F.col("want"), "mismatch")
    found = joined.select(F.when(F.col("want") == "", F.col("line")).otherwise(F.col("name")).alias("name"), problem.alias("problem")).where("problem is not null")
    none = lines.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("SHA256SUMS").alias("name"), F.lit("missing manifest").alias("problem"))
    return found.unionByName(none)


def tree_fingerprint(df: DataFrame, by: str, hash_col: str = "sha256", digits: int = 3) -> DataFrame:
    """by, n and fingerprint of the multiset of hashes, in parts: no task sees all of a group, and any partitioning gives the same digest.

    Equal hashes become one entry ``hash*count``; the entries that share their first ``digits`` digits are sorted and hashed, and the hashes
    of these parts in order give the group's.  ``set_fingerprint`` is the flat digest of the same rows.
    """
    each = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(by).alias("k"), F.col(hash_col).cast("string").alias("h")).agg(F.count("*").alias("n"))
    entry = F.concat("h", F.lit("*"), F.col("n").cast("string"))
    digest = lambda entries: F.sha2(F.array_join(F.sort_array(F.collect_list(entries)), "\n"), 256)
    parts = each.groupBy("k", F.substring("h", 1, digits).alias("part")).agg(F.sum("n").alias("n"), digest(entry).alias("d"))
    return parts.groupBy(F.col("k").alias(by)).agg(F.sum("n").alias("n"), digest(F.concat("part", F.lit(":"), F.col("d"))).alias("fingerprint"))


def set_fingerprint(df: DataFrame, by: str | None = None, hash_col: str = "sha256", every: DataFrame | None = None) -> DataFrame:
    """SHA-256 of the sorted hashes joined by line feeds, repeats kept: independent of row order.

    With ``by`` a row (by, n, fingerprint) for each of its values, and for those of ``every`` that have no rows; else one row.  One
    digest is sequential by definition: Spark sorts the hashes of a group outside memory and one task streams them through it.
    """
    rows = df.select((F.col(by).cast("string") if by else F.lit("")).alias("k"), F.col(hash_col).cast("string").alias("h")).where("h is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        schema = pa.schema([("k", pa.string()), ("n", pa.int64()), ("fingerprint", pa.string())])
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([n]), pa.array([digest.hexdigest()])], schema=schema)
        for batch in batches:
            keys, hashes = batch.column("k").to_pylist(), batch.column("h").to_pylist()
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if digest is None or keys[at] != key:
                    if digest is not None:
                        yield done()
                    key, digest, n = keys[at], hashlib.sha256(), 0
                digest.update((("\n" if n else "") + "\n".join(hashes[at:end])).encode())
                n += end - at
                at = end
        if digest is not None:
            yield done()

    found = rows.repartition("k").sortWithinPartitions("k", "h").mapInArrow(run, "k string, n long, fingerprint string")
    empty = hashlib.sha256(b"").hexdigest()
    if by is None:
        one = df.sparkSession.range(1).select(F.lit("").alias("k"))
        return one.join(found.hint("merge"), "k", "left").select(F.coalesce("fingerprint", F.lit(empty)).alias("fingerprint"))
    if every is None:
        return found.select(F.col("k").alias(by), "n", "fingerprint")
    named = every.select(F.col(by).cast("string").alias("k")).join(found.hint("merge"), "k", "left")
    return named.select(F.col("k").alias(by), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("fingerprint", F.lit(empty)).alias("fingerprint"))


def manifest_report(df: DataFrame, classes: list[str]) -> DataFrame:
    """Rows (part, key, detail, n) of the report: the number of files, each corrupt file with its error, and the rows of each source
    split and class folder, zero where there are none."""
    total = df.agg(F.count("*").alias("n")).select(F.lit("n").alias("part"), F.lit("").alias("key"), F.lit("").alias("detail"), "n")
    corrupt = df.where("error is not null").select(F.lit("corrupt").alias("part"), F.col("rel_path").alias("key"), F.col("error").alias("detail"), F.lit(1).cast("long").alias("n"))
    wide = df.where("error is null").groupBy("source_split").pivot("class_dir", classes).count().na.fill(0)
    counts = wide.select(F.col("source_split").alias("key"), F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in classes)))).alias("detail", "n"))
    return total.unionByName(corrupt).unionByName(counts.select(F.lit("count").alias("part"), "key", "detail", "n"))


def read_split(df: DataFrame, split: str) -> DataFrame:
    """One split's rows by path; an unknown or empty split raises."""
    rows = df.where(F.col("source_split") == split)
    if rows.isEmpty():
        raise ValueError(f"no rows in split {split!r}")
    return rows.orderBy("rel_path")


def sniff_format(content: Column) -> Column:
    """JPEG, PNG, BMP or WEBP by magic bytes, else null."""
    at = lambda pos, n: F.hex(F.substring(content, pos, n))
    return (
        F.when(at(1, 3) == "FFD8FF", "JPEG").when(at(1, 8) == "89504E470D0A1A0A", "PNG").when(at(1, 2) == "424D", "BMP")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "WEBP")
    )


def file_verdict(df: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Add verdict and status: the first rule that a file breaks, in the service's order (size, type, pixels, frames, sides, shape, decoding).

    ``n_frames`` is optional; a file of several frames is refused, and so is one without a size.
    """
    w, h = F.col("width"), F.col("height")
    rules = [
        (F.col("size_bytes") > limits["bytes"], "payload_too_large", 413),
        (F.col("format").isNull(), "unsupported_media_type", 415),
        (w.cast("long") * h > limits["pixels"], "too_many_pixels", 400),
        (F.col("n_frames") > 1 if "n_frames" in df.columns else F.lit(False), "multi_frame", 400),
        ((F.least(w, h) < limits["side_min"]) | (F.greatest(w, h) > limits["side_max"]), "bad_dimensions", 400),
        (F.greatest(w, h) > limits["aspect"] * F.least(w, h), "bad_aspect", 400),
        (F.col("error").isNotNull() | w.isNull() | h.isNull(), "invalid_image", 400),
    ]
    verdict, status = F.lit("ok"), F.lit(200)
    for broken, name, code in reversed(rules):
        hit = F.coalesce(broken, F.lit(False))
        verdict, status = F.when(hit, name).otherwise(verdict), F.when(hit, code).otherwise(status)
    return df.withColumns({"verdict": verdict, "status": status})


def format_mismatch(df: DataFrame) -> DataFrame:
    """Files whose extension names another format than their content (jpg is jpeg, tif is tiff)."""
    known = F.regexp_replace(F.regexp_replace(extension(F.col("rel_path")), "^jpg$", "jpeg"), "^tif$", "tiff")
    return df.where(F.col("format").isNotNull() & (known != F.lower("format")))


def safe_request_id(c: Column) -> Column:
    """The id where it is harmless, else one made from its MD5."""
    return F.when(c.rlike(r"^[A-Za-z0-9._-]{1,64}$"), c).otherwise(F.concat(F.lit("gen-"), F.substring(F.md5(c.cast("binary")), 1, 16)))


def caller_fingerprint(key: Column, ip: Column) -> Column:
    """``key:`` and 12 digits of the key's SHA-256, else ``ip:`` and the address."""
    return F.coalesce(F.concat(F.lit("key:"), F.substring(F.sha2(key, 256), 1, 12)), F.concat(F.lit("ip:"), ip))


def registry_problems(df: DataFrame) -> DataFrame:
    """Problems of model rows, one row each.

    Columns: model_version, schema_version, threshold, low, high, temperature, class_names (array), positive_class and the struct
    ``onnx`` (opset, input_name, output_name), which is null for a candidate; a served model needs it.
    """
    checks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.length("model_version"), F.lit(0)) == 0, "no model version"),
            F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "unknown schema version"),
            F.when(~((F.col("threshold") > 0) & (F.col("threshold") < 1)), "threshold outside (0, 1)"),
            F.when((F.col("threshold") < F.col("low")) | (F.col("threshold") > F.col("high")), "threshold outside the review band"),
            F.when(F.col("temperature") <= 0, "temperature not positive"),
            F.when(~F.col("class_names").eqNullSafe(F.array(*(F.lit(c) for c in CLASS_NAMES))), "unexpected class names"),
            F.when(~F.col("positive_class").eqNullSafe(F.lit(POSITIVE_CLASS)), "unexpected positive class"),
            F.when(F.col("onnx").isNull(), "no exported model"),
            F.when(F.col("onnx").isNotNull() & ~F.coalesce(F.col("onnx.opset") >= 13, F.lit(False)), "opset below 13"),
            F.when(F.col("onnx").isNotNull() & (F.col("onnx.input_name").isNull() | F.col("onnx.output_name").isNull()), "input or output without a name"),
        )
    )
    return df.select("model_version", F.explode(checks).alias("problem"))


def split_class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_split", "class_dir").count()


def inventory_profile(df: DataFrame) -> DataFrame:
    """Rows (facet, value, n): files, valid and corrupt ones, byte and side ranges, and the valid files of each format, mode and number of channels."""
    ok = F.col("error").isNull()
    one = {
        "n_images": F.count("*"), "n_valid": F.count_if(ok), "n_corrupt": F.count_if(~ok), "bytes_total": F.sum("size_bytes"), "bytes_min": F.min("size_bytes"),
        "bytes_max": F.max("size_bytes"), **{f"{c}_{n}": f(F.when(ok, F.col(c))) for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))},
    }
    single = df.agg(*(v.cast("long").alias(k) for k, v in one.items()))
    single = single.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in one)))).alias("facet", "n")).select("facet", F.lit("").alias("value"), "n")
    channels = F.create_map(*(F.lit(x) for kv in CHANNELS.items() for x in kv))[F.col("mode")].cast("string")
    facets = F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in (("format", F.col("format")), ("mode", F.col("mode")), ("channels", channels))))
    each = df.where(ok).select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return single.unionByName(each)


def directory_rollup(df: DataFrame, depth: int) -> DataFrame:
    """dir, files directly in it and below it, for every folder to ``depth`` levels (the root is ``.``)."""
    folders = F.split("rel_path", "/")
    n = F.size(folders) - 1
    names = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(depth))), lambda k: F.struct(F.when(k == 0, ".").otherwise(F.array_join(F.slice(folders, 1, k), "/")).alias("dir"), (k == n).alias("direct")))
    return df.select(F.inline(names)).groupBy("dir").agg(F.count_if("direct").alias("direct_files"), F.count("*").alias("files"))


def dataset_signature(df: DataFrame, counts: dict[tuple[str, str], int] = CASTING_COUNTS, sizes: tuple = CASTING_SIZES) -> DataFrame:
    """One row: data set (null: unknown), confidence, commonest size of valid files and the counts that differ from the published ones.

    Casting: both its class folders occur; ``high`` if the size is a published one and train and test counts are equal, else
    ``medium``.  MVTec AD: a class folder ``good`` and some path with ``ground_truth``.
    """
    valid = df.where("error is null")
    size = valid.groupBy("width", "height").count().orderBy(F.desc("count"), F.desc("width"), F.desc("height")).limit(1)
    want = df.sparkSession.createDataFrame([(s, c, n) for (s, c), n in counts.items()], "source_split string, class_dir string, want long")
    have = split_class_counts(df.where(F.col("source_split").isin(*{s for s, _ in counts})))
    off = have.join(want.hint("merge"), ["source_split", "class_dir"], "full_outer").where(~F.col("count").eqNullSafe(F.col("want"))).agg(F.count("*").alias("n_off"))
    dirs = sorted({c for _, c in counts})
    seen = df.agg(*(F.coalesce(F.bool_or(F.col("class_dir") == c), F.lit(False)).alias(f"has_{i}") for i, c in enumerate([*dirs, "good"])), F.coalesce(F.bool_or(F.col("rel_path").contains("ground_truth")), F.lit(False)).alias("masks"))
    casting, mvtec = F.col("has_0") & F.col("has_1"), F.col("has_2") & F.col("masks")
    right = F.lit(False)
    for w, h in sizes:
        right = right | ((F.col("width") == w) & (F.col("height") == h))
    name = F.when(casting, "casting").when(mvtec, "mvtec_ad")
    sure = F.when(casting & right & (F.col("n_off") == 0), "high").when(casting | mvtec, "medium")
    return seen.crossJoin(F.broadcast(off)).join(F.broadcast(size), F.lit(True), "left").select(name.alias("dataset"), sure.alias("confidence"), "width", "height", "n_off")


def class_counts(df: DataFrame, splits: list[str], classes: list[str]) -> DataFrame:
    """Rows of every split and class, zeros too."""
    spark = df.sparkSession
    every = spark.createDataFrame([(s, c) for s in splits for c in classes], "source_split string, class_dir string")
    counts = split_class_counts(df.where(F.col("source_split").isin(*splits) & F.col("class_dir").isin(*classes)))  # no more rows than ``every``
    return every.join(F.broadcast(counts), ["source_split", "class_dir"], "left").select("source_split", "class_dir", F.coalesce("count", F.lit(0)).alias("n"))


def split_crosstab(df: DataFrame, split: str = "split", kind: str = "class_name") -> DataFrame:
    """Counts of split and class with ``All`` margins; excluded rows are keyed by their reason."""
    key = F.when(F.col("exclude_reason") != "", F.concat(F.lit("excluded:"), F.col("exclude_reason"))).otherwise(F.col(split))
    rows = df.select(key.alias("split_key"), F.col(kind).alias("class_name"))
    out = rows.cube("split_key", "class_name").agg(F.count("*").alias("n"), F.grouping("split_key").alias("g1"), F.grouping("class_name").alias("g2"))
    return out.select(F.when(F.col("g1") == 1, "All").otherwise(F.col("split_key")).alias("split_key"), F.when(F.col("g2") == 1, "All").otherwise(F.col("class_name")).alias("class_name"), "n")


def split_report(df: DataFrame) -> DataFrame:
    """Rows (part, key, n, share, defect_rate): kept rows of each split with their share of the kept and defect rate (4 places), and
    the excluded rows of each reason."""
    kept = F.col("exclude_reason") == ""
    counts = df.where(kept).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("defects"))
    total = counts.agg(F.sum("n").alias("t"))
    used = counts.crossJoin(F.broadcast(total)).select(
        F.lit("split").alias("part"), F.col("split").alias("key"), "n", F.round(F.col("n") / F.col("t"), 4).alias("share"), F.round(F.col("defects") / F.col("n"), 4).alias("defect_rate")
    )
    none = F.lit(None).cast("double")
    gone = df.where(~kept).groupBy(F.col("exclude_reason").alias("key")).agg(F.count("*").alias("n"))
    return used.unionByName(gone.select(F.lit("excluded").alias("part"), "key", "n", none.alias("share"), none.alias("defect_rate")))


def top_sizes(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("width", "height").count().orderBy(F.desc("count"), "width", "height").limit(k)
