"""Image files made from the thumbnails view, the input of the queries over files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import materialize


def png(pixels: np.ndarray, kind: int = 0) -> bytes:
    """A PNG of a matrix of bytes (grayscale) or height x width x 3 bytes, all rows filtered in one way (0 none, 1 left, 2 up, 3 mean, 4 Paeth)."""
    h, w = pixels.shape[:2]
    step = pixels.size // (h * w)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    x = pixels.astype(np.uint8).reshape(h, -1).astype(int)
    left = np.pad(x, ((0, 0), (step, 0)))[:, :-step]
    up = np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(up, ((0, 0), (step, 0)))[:, :-step]
    near = [np.abs(left + up - corner - v) for v in (left, up, corner)]
    paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
    x = (x - [0, left, up, (left + up) // 2, paeth][kind]) % 256
    rows = b"".join(bytes([kind]) + r.astype(np.uint8).tobytes() for r in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if step == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(rgb: np.ndarray) -> bytes:
    """A 24-bit BMP of height x width x 3 bytes."""
    h, w, _ = rgb.shape
    rows = np.pad(rgb.astype(np.uint8)[::-1, :, ::-1].reshape(h, -1), ((0, 0), (0, -3 * w % 4)))
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def write_images(df: DataFrame, folder: str, scale: int = 8) -> DataFrame:
    """Write each thumbnail (id, fine) as an enlarged image below ``folder`` and return the written table of id and name.

    Most are grayscale PNGs, with every row filter, every third is in colour, every tenth a BMP.  A file is written under a name of its own and moved to its final name when whole, so a repeated task replaces it; each 40th
    is cut short, as a damaged upload is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for i, fine in zip(batch.column("id").to_pylist(), batch.column("fine").to_pylist(), strict=True):
                x = np.array(fine)
                side = int(len(x) ** 0.5)
                x = (255 * (x - x.min()) / (x.max() - x.min() + 1e-12)).reshape(side, side)
                x = np.kron(x, np.ones((scale, scale)))
                rgb = np.stack([x, x * 0.75, 255 - x], axis=2)
                body = bmp(rgb) if i % 10 == 6 else png(rgb if i % 3 == 1 else x, i % 5)
                body = body[: len(body) // 2] if i % 40 == 7 else body
                name = f"{'train' if i % 5 else 'test'}/{'def_front' if i % 2 else 'ok_front'}/{i}.{'bmp' if i % 10 == 6 else 'png'}"
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                part = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(body)
                fs.move(part, f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string())], ["id", "name"])

    rows = df.select("id", F.col("fine").cast("array<double>"))
    rows = rows.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "id")  # drawing takes longer than reading, and a table may lie in one file
    return materialize(rows.mapInArrow(run, "id long, name string"), "images")
