"""Headers, pixels and verdicts of image files, and whole requests of them as a stream."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.plans import queries_log
from gaugeframe.plans.fixtures import bmp, png, write_images
from gaugeframe.sources import images as im
from gaugeframe.sources import pixels as px
from gaugeframe.sources.scratch import scratch_path
from gaugeframe.streaming import monitor as mo


def picture(h, w, colour=True, seed=0):
    r, c = np.mgrid[0:h, 0:w]
    x = np.stack([r * 3 % 256, c * 5 % 256, (r + c) * 2 % 256], axis=2)[:, :, : 3 if colour else 1]
    return (x + np.random.default_rng(seed).integers(0, 6, x.shape)).clip(0, 255).astype(np.uint8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def raw_png(w, h, depth, colour, rows, laced=0, extra=b""):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))
    return b"\x89PNG\r\n\x1a\n" + head + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def java_image(spark, rgb, kind, gray=False):
    """The bytes of an image as the JVM writes it."""
    j = spark._jvm
    h, w = rgb.shape[:2]
    image = j.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    if gray:
        raster = image.getRaster()
        for r in range(h):
            for c in range(w):
                raster.setSample(c, r, 0, int(rgb[r, c, 0]))
    else:
        for r in range(h):
            for c in range(w):
                image.setRGB(c, r, int.from_bytes(bytes(rgb[r, c])))
    out = j.java.io.ByteArrayOutputStream()
    assert j.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


VP8 = b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 64, 48) + b"\0" * 20
LOSSLESS = b"\x2f" + ((63) | (47 << 14)).to_bytes(4, "little") + b"\0" * 8
EXTENDED = lambda flags: bytes([flags, 0, 0, 0]) + (63).to_bytes(3, "little") + (47).to_bytes(3, "little")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour", [True, False])
def test_every_row_filter(kind, colour):
    x = picture(37, 41, colour)
    file = png(x if colour else x[:, :, 0], kind)
    assert px.read_header(file) == (41, 37, 1, "RGB" if colour else "L", None)
    assert (px.decode(file) == (x if colour else np.repeat(x, 3, axis=2))).all()


def test_depths_palettes_and_alpha():
    r = random.Random(1)
    h, w = 9, 13
    for depth in (1, 2, 4, 8):
        values = [[r.randrange(1 << depth) for _ in range(w)] for _ in range(h)]
        bits = ["".join(f"{v:0{depth}b}" for v in row) for row in values]
        rows = b"".join(b"\0" + int(b.ljust(-(-len(b) // 8) * 8, "0"), 2).to_bytes(-(-len(b) // 8)) for b in bits)
        gray = px.decode(raw_png(w, h, depth, 0, rows))
        assert (gray[:, :, 1] == np.array(values) * 255 // ((1 << depth) - 1)).all()
        colours = np.array([[r.randrange(256) for _ in range(3)] for _ in range(1 << depth)], np.uint8)
        assert (px.decode(raw_png(w, h, depth, 3, rows, extra=chunk(b"PLTE", colours.tobytes()))) == colours[np.array(values)]).all()
    deep = np.random.default_rng(2).integers(0, 65536, (h, w, 4))
    rows = b"".join(b"\0" + row.astype(">u2").tobytes() for row in deep)
    assert (px.decode(raw_png(w, h, 16, 6, rows)) == deep[:, :, :3] >> 8).all()
    both = np.random.default_rng(3).integers(0, 256, (h, w, 2)).astype(np.uint8)
    assert (px.decode(raw_png(w, h, 8, 4, b"".join(b"\0" + row.tobytes() for row in both))) == both[:, :, :1]).all()


@pytest.mark.parametrize("size", [(1, 1), (5, 3), (16, 21)])
def test_interlaced_rows(size):
    h, w = size
    x = picture(h, w)
    rows = b""
    for top, left, down, right in px.PASSES:
        part = x[top::down, left::right]
        if part.size:
            rows += b"".join(b"\0" + row.tobytes() for row in part)
    assert (px.decode(raw_png(w, h, 8, 2, rows, laced=1)) == x).all()


def test_files_of_the_jvm(spark):
    x = picture(45, 70)
    assert (px.decode(java_image(spark, x, "png")) == x).all()
    assert (px.decode(java_image(spark, x, "bmp")) == x).all() and (px.decode(bmp(x)) == x).all()
    gray = java_image(spark, np.repeat(x[:, :, :1], 3, axis=2), "jpg", gray=True)
    assert px.read_header(gray) == (70, 45, 1, "L", None)
    smooth = np.stack([np.add.outer(np.arange(45), np.arange(70))] * 3, axis=2).astype(np.uint8)
    for rgb, most in ((smooth, 3), (np.where(np.arange(70)[None, :, None] < 32, [200, 30, 60], [20, 90, 220]) * np.ones((45, 1, 1)), 12)):
        file = java_image(spark, rgb.astype(np.uint8), "jpg")
        got = px.decode(file)
        back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(file))
        want = np.array([[list(struct.pack(">i", back.getRGB(c, r))[1:]) for c in range(70)] for r in range(45)])
        assert got.shape == (45, 70, 3) and np.abs(got.astype(int) - want).mean() < most / 2 and np.abs(got.astype(int) - rgb).mean() < most


def test_jpeg_pixels_with_restarts_against_the_jvm(spark):
    x = np.repeat(picture(64, 80)[:, :, :1], 3, axis=2)
    file = java_image(spark, x, "jpg", gray=True)
    back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(file))
    want = np.array([[back.getRaster().getSample(c, r, 0) for c in range(80)] for r in range(64)])
    assert np.abs(px.decode(file)[:, :, 0].astype(int) - want).max() <= 2


HOSTILE = {
    "gif": (b"GIF89a" + b"\0" * 50, "unsupported_media_type"),
    "pdf": (b"%PDF-1.7", "unsupported_media_type"),
    "empty": (b"", "unsupported_media_type"),
    "null": (None, "unsupported_media_type"),
    "html_in_jpeg": (b"\xff\xd8\xff\xe0<html>", "invalid_image"),
    "png_magic": (b"\x89PNG\r\n\x1a\n", "invalid_image"),
    "bmp_magic": (b"BM12", "invalid_image"),
    "huge_png": (raw_png(30000, 30000, 8, 0, b""), "too_many_pixels"),
    "huge_webp": (webp((b"VP8X", EXTENDED(0)[:4] + (16000).to_bytes(3, "little") * 2), (b"VP8 ", VP8)), "too_many_pixels"),
    "animated_png": (raw_png(64, 64, 8, 0, b"".join(b"\0" + b"x" * 64 for _ in range(64)), extra=chunk(b"acTL", struct.pack(">II", 3, 0))), "multi_frame"),
    "animated_webp": (webp((b"VP8X", EXTENDED(2)), (b"ANMF", b"\0" * 24), (b"ANMF", b"\0" * 24)), "multi_frame"),
    "small": (png(np.zeros((8, 8))), "bad_dimensions"),
    "wide": (png(np.zeros((40, 400))), "bad_aspect"),
    "bad_sum": (png(np.zeros((64, 64)))[:-20] + b"\0" * 20, "invalid_image"),
    "bad_filter": (raw_png(64, 64, 8, 0, (b"\x07" + b"x" * 64) * 64), "invalid_image"),
    "few_rows": (raw_png(64, 64, 8, 0, (b"\0" + b"x" * 64) * 9), "invalid_image"),
    "bomb": (raw_png(64, 64, 8, 0, b"\0" * 50_000_000), "ok"),  # never unpacked beyond what the header announces
    "tail": (png(np.full((64, 64), 9)) + b"<script>", "ok"),
    "lossy_webp": (webp((b"VP8 ", VP8)), "invalid_image"),  # sound, but no library decodes it here
}


def test_verdicts(spark):
    x = picture(64, 64)
    jpeg = java_image(spark, x, "jpg")
    files = {k: (c, v) for k, (c, v) in HOSTILE.items()}
    files |= {"rgb": (png(x, 4), "ok"), "bmp": (bmp(x), "ok"), "jpeg": (jpeg, "ok"), "cut_jpeg": (jpeg[: len(jpeg) // 2], "invalid_image"), "cut_png": (png(x)[:-30], "invalid_image"), "cut_bmp": (bmp(x)[:-30], "invalid_image")}
    mpf = b"MPF\0" + b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHII", 0xB001, 4, 1, 2) + b"\0" * 4
    files["two_pictures"] = (jpeg[:2] + b"\xff\xe2" + struct.pack(">H", len(mpf) + 2) + mpf + jpeg[2:], "multi_frame")
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in files.items()], "rel_path string, content binary").withColumn("error", F.lit("clash"))
    got = {r.rel_path: r for r in im.judge_files(df, lambda t: t.reshape(len(t), -1).sum(1), side=8).collect()}
    assert {k: r.verdict for k, r in got.items()} == {k: v for k, (_, v) in files.items()}
    assert all((r.z is not None) == (r.verdict == "ok") and (r.status == 200) == (r.verdict == "ok") for r in got.values())
    rgb = x.astype(float) / 255
    mean = [im._resize(rgb[:, :, c], 8).mean() for c in range(3)]
    want = 64 * sum((m - a) / b for m, a, b in zip(mean, im.MEAN, im.STD))
    assert abs(got["rgb"].z - want) < 1e-9 and abs(got["bmp"].z - want) < 1e-9 and abs(got["jpeg"].z - want) < 12
    assert im.judge_files(df.limit(0), lambda t: t, side=8).count() == 0


def test_webp_headers():
    for file, mode in ((webp((b"VP8 ", VP8)), "RGB"), (webp((b"VP8L", LOSSLESS)), "RGB"), (webp((b"VP8X", EXTENDED(16)), (b"VP8 ", VP8)), "RGBA")):
        assert px.read_header(file) == (64, 48, 1, mode, None)
        assert px.read_header(file[:-9]).error == "truncated"


def test_any_bytes_are_answered():
    r = random.Random(5)
    starts = [png(picture(40, 40)), bmp(picture(40, 40)), webp((b"VP8X", EXTENDED(2)), (b"VP8 ", VP8)), b"\xff\xd8\xff\xe0\0\x10JFIF\0" + b"\0" * 9 + b"\xff\xc0\0\x0b\x08\0\x40\0\x40\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0ab\xff\xd9"]
    for _ in range(1500):
        file = bytearray(r.choice(starts))
        for _ in range(r.randrange(1, 4)):
            file[r.randrange(3, len(file))] = r.randrange(256)
        file = bytes(file[: r.randrange(len(file) // 2, len(file) + 1)])
        px.read_header(file)
        try:
            px.decode(file)
        except px.ImageError:
            pass


JUDGED = "rel_path string, size_bytes long, request int, verdict string, status int, z double"


def test_requests_count_whole(spark):
    rows = [("b", 9, 1, "ok", 200, -3.0), ("a", 9, 1, "ok", 200, 3.0), ("c", 9, 2, "ok", 200, 3.0), ("d", 9, 2, "invalid_image", 400, None), ("e", 99, 3, "ok", 200, 1.0)]
    rows += [(f"f{i}", 1, 4, "ok", 200, 1.0) for i in range(3)] + [("g", 1, 5, "ok", 200, 0.4)]
    got = {r.rel_path: r for r in mo.accept_whole(spark.createDataFrame(rows, JUDGED), "request", 0.5, 0.4, 0.7, max_files=2, max_bytes=50).collect()}
    assert {k: (r["index"], r.accepted, r.refusal, r.decision, r.needs_review) for k, r in got.items()} == {
        "a": (0, True, None, "defective", False), "b": (1, True, None, "normal", False), "c": (0, False, "invalid_image", None, None), "d": (1, False, "invalid_image", None, None),
        "e": (0, False, "payload_too_large", None, None), "f0": (0, False, "too_many_files", None, None), "f1": (1, False, "too_many_files", None, None), "f2": (2, False, "too_many_files", None, None),
        "g": (0, True, None, "defective", True),
    }


def test_a_corrupt_file_refuses_its_request_only(spark, tmp_path):
    """Files in three batches; what each batch wrote is what brute force says, one request is refused."""
    for i in range(9):
        x = picture(40, 40, seed=i)
        (tmp_path / f"{i}.png").write_bytes(png(x, i % 5) if i != 4 else png(x)[:99] + b"\0" * 400)
    schema = spark.read.format("binaryFile").load(str(tmp_path)).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 3).load(str(tmp_path))
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("rel_path"), "content").withColumn("request", F.substring("rel_path", 1, 1).cast("int") % 3)
    scorer = lambda t: t.mean(axis=(1, 2, 3))
    judged = mo.judge_stream(files, lambda rows: im.judge_files(rows, scorer, side=8), "test-arrived")
    assert judged.select("batch").distinct().count() == 3
    got = mo.accept_whole(judged, "request", 0.5, 0.4, 0.6).collect()
    assert len(got) == 9 and {r.request for r in got if not r.accepted} == {1} and {r.refusal for r in got} == {None, "invalid_image"}
    for r in got:
        if r.accepted:
            z = scorer(im.input_tensor(picture(40, 40, seed=int(r.rel_path[0])), 8)[None])[0]
            assert abs(r.p - 1 / (1 + np.exp(-z))) < 1e-9 and r["index"] == [x for x in range(9) if x % 3 == r.request].index(int(r.rel_path[0]))


def _last_job(spark):
    """The number of a job that is run now."""
    spark.sparkContext.setJobGroup("mark", "mark")
    spark.range(1).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup("mark"))


def test_arriving_files_share_batches_and_tasks(spark, tmp_path):
    """312 files come in one micro-batch, and neither their listing nor their reading takes a task for each; the session keeps its settings."""
    rows = [(i, [float((7 * i + k) % 11) for k in range(64)], i % 2) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    keys = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    _, files = queries_log.arriving(spark, str(tmp_path))
    first = _last_job(spark)
    judged = mo.judge_stream(files, lambda rows: rows.select("rel_path", F.length("content").alias("n")), "test-many")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in range(first + 1, _last_job(spark)) for s in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages) < 100
    assert judged.select("rel_path").distinct().count() == judged.count() == 312
    assert judged.select("batch").distinct().count() == 1 and len(judged.inputFiles()) == 1
    assert [spark.conf.get(k) for k in keys] == before


def test_the_settings_come_back_after_a_failure(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with pytest.raises(ZeroDivisionError), im.many_small_files(spark):
        assert spark.conf.get("spark.sql.files.openCostInBytes") != before
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_a_table_in_one_file_is_drawn_by_many_tasks(spark):
    rows = spark.createDataFrame([(i, [float((i + k) % 5) for k in range(64)]) for i in range(60)], "id long, fine array<double>").coalesce(1)
    written = write_images(rows, scratch_path(spark, "test-drawn"))
    assert len(written.inputFiles()) > 4 and written.select("id").distinct().count() == written.count() == 60
