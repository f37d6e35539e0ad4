"""Image files as tables (A1, A5, A15, A16, B16) and table sinks.

Files are read through Spark's ``binaryFile`` and ``image`` sources; pixels are
worked on in Arrow batches inside the tasks.
"""

from __future__ import annotations

import hashlib
import json
import subprocess
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.inventory import LIMITS, file_verdict, sniff_format
from gaugeframe.sources.pixels import ImageError, decode, read_header

# Channel statistics of the model's input.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

# What Spark's binaryFile source gives for a file.
FILE = "path string, modificationTime timestamp, length long, content binary"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, size_bytes of every file below the folder (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(rel_path(folder), F.col("length").alias("size_bytes"))


def stream_files(spark: SparkSession, folder: str, max_files: int = 50_000) -> DataFrame:
    """The files below the folder as a stream of at most ``max_files`` files a micro-batch.

    A micro-batch costs a listing, a plan and three logs whatever it holds, so it must hold many files; tasks read at most 128 MB each, so its
    size does not show in their memory.  All names that are listed are kept for the batches after, else each batch goes through them again.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", max_files).option("maxCachedFiles", 2**31 - 1).load(folder)


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark checks a stream's files in four tasks a core instead of one task a file (up to 10,000 for each micro-batch), and reads up
    to 512 files or 128 MB in a task instead of 32 files."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": str(256 << 10)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rel_path(folder: str, column: str = "path"):
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_extract(column, f"/{tail}/(.*)$", 1).alias("rel_path")


def decode_files(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, size_bytes, sha256, format, width, height, mode and error (null for a file that decodes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(rel_path(folder), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), sniff_format(F.col("content")).alias("format"))
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    images = images.select(rel_path(folder, "image.origin"), "image.width", "image.height", "image.nChannels")
    bad = F.col("height").isNull() | (F.col("height") < 0)
    joined = files.join(images, "rel_path", "left")
    return joined.select(
        "rel_path", "size_bytes", "sha256", "format", F.when(~bad, F.col("width")).alias("width"), F.when(~bad, F.col("height")).alias("height"),
        F.when(~bad, F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 4, "RGBA").otherwise("RGB")).alias("mode"), F.when(bad, "cannot be decoded").alias("error"),
    )


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels (height x width x 3) of an image row's bytes (blue first)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def _triangle(n: int, side: int) -> np.ndarray:
    """Weights (side x n) of a triangle filter that is as wide as the step when it shrinks (bilinear with antialiasing)."""
    step = n / side
    reach = max(step, 1.0)
    centre = (np.arange(side) + 0.5) * step
    w = np.maximum(0.0, 1 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def _resize(x: np.ndarray, side: int) -> np.ndarray:
    """A matrix resampled to side x side by the triangle filter, rows and columns apart."""
    return _triangle(x.shape[0], side) @ x @ _triangle(x.shape[1], side).T


def normalised(values: Column, channel: int) -> Column:
    """An array of values from 0 to 1 by the channel's statistics."""
    return F.transform(values, lambda v: (v - MEAN[channel]) / STD[channel])


def _images(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder)
    return rows.where("image.height > 0").select(rel_path(folder, "image.origin"), "image.height", "image.width", "image.nChannels", "image.data")


def _per_image(rows: DataFrame, schema: str, work) -> DataFrame:
    """One or more result tuples of each image row, by ``work(rel_path, pixels)``; 16 images are held at a time."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16).to_pydict()
                out = [t for p, h, w, c, data in zip(*(part[k] for k in ("rel_path", "height", "width", "nChannels", "data")), strict=True) for t in work(p, _pixels(h, w, c, data))]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return rows.mapInArrow(run, schema)


def thumbnails(spark: SparkSession, folder: str, coarse: int, fine: int) -> DataFrame:
    """rel_path and two grayscale thumbnails as arrays of numbers."""

    def work(path, rgb):
        gray = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
        yield path, _resize(gray, coarse).reshape(-1).tolist(), _resize(gray, fine).reshape(-1).tolist()

    return _per_image(_images(spark, folder), "rel_path string, coarse array<double>, fine array<double>", work)


def model_input(spark: SparkSession, folder: str, side: int) -> DataFrame:
    """rel_path and the model's input: resized RGB, scaled, normalised by channel, channel first."""

    def work(path, rgb):
        yield path, input_tensor(rgb, side).reshape(-1).tolist()

    return _per_image(_images(spark, folder), "rel_path string, tensor array<double>", work)


def _moved(x: np.ndarray, turn: float, shift: tuple[float, float], scale: float) -> np.ndarray:
    """A square matrix turned (degrees), scaled and shifted (shares of the side) about its centre, bilinear, black outside."""
    side = len(x)
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    r, q = np.meshgrid(np.arange(side) - (side - 1) / 2, np.arange(side) - (side - 1) / 2, indexing="ij")
    r, q = (r - shift[0] * side) / scale, (q - shift[1] * side) / scale
    row, col = c * r - s * q + (side - 1) / 2, s * r + c * q + (side - 1) / 2
    wide = np.pad(x, 1)
    low_r, low_c = np.floor(row).astype(int), np.floor(col).astype(int)
    at = lambda i, j: wide[np.clip(i + 1, 0, side + 1), np.clip(j + 1, 0, side + 1)]
    fr, fc = row - low_r, col - low_c
    return (1 - fr) * ((1 - fc) * at(low_r, low_c) + fc * at(low_r, low_c + 1)) + fr * ((1 - fc) * at(low_r + 1, low_c) + fc * at(low_r + 1, low_c + 1))


def _blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """A matrix blurred by a Gaussian kernel of five places, edges mirrored."""
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for _ in range(2):
        wide = np.pad(x, ((2, 2), (0, 0)), mode="reflect")
        x = sum(w * wide[i : i + len(x)] for i, w in enumerate(k)).T
    return x


def augment(spark: SparkSession, folder: str, side: int, variants: int, seed: int) -> DataFrame:
    """rel_path, variant and a changed grayscale thumbnail of each training image; the changes follow from seed, path and variant.

    In order: flips, one step of turn, shift and scale, brightness and contrast, a blur for some, noise for some.
    """

    def work(path, rgb):
        gray = _resize(rgb.astype(float).mean(axis=2), side) / 255
        for v in range(variants):
            rng = np.random.Generator(np.random.PCG64(zlib.crc32(f"{seed}|{path}|{v}".encode())))
            x = gray[:, ::-1] if rng.random() < 0.5 else gray
            x = x[::-1] if rng.random() < 0.5 else x
            x = _moved(x, rng.uniform(-15, 15), (rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05)), rng.uniform(0.95, 1.05))
            x = (x - x.mean()) * rng.uniform(0.8, 1.2) + x.mean() * rng.uniform(0.8, 1.2)
            x = _blurred(x, rng.uniform(0.1, 1.5)) if rng.random() < 0.2 else x
            x = x + rng.normal(0, 0.02, x.shape) if rng.random() < 0.2 else x
            yield path, v, np.clip(x, 0, 1).reshape(-1).tolist()

    rows = _images(spark, folder).where(F.col("rel_path").startswith("train/"))
    return _per_image(rows, "rel_path string, variant long, fine array<double>", work)


def _each_file(rows: DataFrame, added: str, work, keep_content: bool, files: int = 16) -> DataFrame:
    """``rows`` with the columns ``added`` that ``work`` gives for slices of rows, ``files`` files at a time."""
    names = [c for c in rows.columns if keep_content or c != "content"]
    fields = [(c.split(" ")[0], c.split(" ")[1]) for c in added.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, files):
                part = batch.slice(at, files)
                out = list(zip(*work(part), strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(v, kinds[k]) for v, (_, k) in zip(out, fields, strict=True))], [*names, *(n for n, _ in fields)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kept}, {added}")


def image_headers(files: DataFrame) -> DataFrame:
    """``files`` (content and others) with size_bytes, format, width, height, n_frames, mode and error (of the container), from the bytes alone: no pixel is decoded."""

    def work(part: pa.RecordBatch):
        return [read_header(c) for c in part.column("content").to_pylist()]

    rows = files.drop("size_bytes", "format", "width", "height", "n_frames", "mode", "error")
    rows = rows.withColumns({"size_bytes": F.coalesce(F.length("content"), F.lit(0)).cast("long"), "format": sniff_format(F.col("content"))})
    return _each_file(rows, "width int, height int, n_frames long, mode string, error string", work, keep_content=True)


def input_tensor(rgb: np.ndarray, side: int) -> np.ndarray:
    """The model's input of RGB pixels: resized, scaled to 0..1, normalised by channel, channel first (3 x side x side)."""
    return np.stack([(_resize(rgb[:, :, c].astype(float), side) / 255 - MEAN[c]) / STD[c] for c in range(3)])


def judge_files(files: DataFrame, scorer, side: int, limits: dict = LIMITS) -> DataFrame:
    """``files`` (rel_path, content and others) with size_bytes, verdict, status and, for a sound file, z: the scorer's value of the model's input.

    The header decides first (``file_verdict``); only files that pass are decoded, in the tasks, one at a time.  A file that can't be
    decoded gets ``invalid_image``; no file's bytes make a task fail.  ``scorer`` maps inputs (n x 3 x side x side) to n numbers.
    """

    def work(part: pa.RecordBatch):
        out = []
        for content, verdict, status in zip(*(part.column(c).to_pylist() for c in ("content", "_verdict", "_status")), strict=True):
            z = None
            if verdict == "ok":
                try:
                    z = float(np.asarray(scorer(input_tensor(decode(content), side)[None])).reshape(-1)[0])
                except ImageError:
                    verdict, status = "invalid_image", 400
            out.append((verdict, status, z))
        return out

    rows = file_verdict(image_headers(files), limits).drop("format", "width", "height", "n_frames", "mode", "error")
    rows = rows.withColumnsRenamed({"verdict": "_verdict", "status": "_status"})
    return _each_file(rows, "verdict string, status int, z double", work, keep_content=False).drop("_verdict", "_status")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write as Parquet and read back with the same schema."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def provenance(config: dict) -> dict[str, Column]:
    """commit (``unknown`` outside a checkout), config_hash (12 digits of the SHA-256 of the sorted JSON) and created_at (UTC)."""
    here = Path(__file__).resolve().parent  # the library's own checkout, wherever the caller stands
    asked = subprocess.run(["git", "-C", str(here), "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
    return {"commit": F.lit(asked.stdout.strip() or "unknown"), "config_hash": F.lit(digest), "created_at": F.to_timestamp(stamp)}


def write_report(df: DataFrame, path: str, config: dict) -> DataFrame:
    """Write rows as JSON lines with their provenance, and read them back."""
    stamped = df.withColumns(provenance(config))
    stamped.write.mode("errorifexists").json(path)
    return df.sparkSession.read.schema(stamped.schema).json(path)


def write_csv(df: DataFrame, path: str, drop: list[str]) -> DataFrame:
    """Write as CSV with a header, without some columns, and read back; empty strings stay empty."""
    kept = df.drop(*drop)
    kept.write.mode("errorifexists").csv(path, header=True, emptyValue="", nullValue="\\N")
    return df.sparkSession.read.schema(kept.schema).csv(path, header=True, emptyValue="", nullValue="\\N")
