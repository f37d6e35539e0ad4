"""Headers and pixels of PNG, JPEG, BMP and WebP files from their bytes.

``read_header`` reads sizes and frame counts without decoding a pixel, so that a
file can be refused before anything is unpacked.  ``decode`` gives RGB pixels of
PNG (every colour type, depth, row filter and interlacing), BMP (uncompressed)
and baseline JPEG files; other kinds go to an image library where one is
installed and are refused where none is.  Both run inside tasks, a file at a time.
"""

from __future__ import annotations

import io
import struct
import zlib
from typing import NamedTuple

import numpy as np


class Header(NamedTuple):
    """What a file's header says; ``error`` names what is wrong with the container."""

    width: int | None
    height: int | None
    n_frames: int
    mode: str | None
    error: str | None


class ImageError(ValueError):
    """The bytes are not a whole image of a kind that can be decoded."""


NONE = Header(None, None, 1, None, "not an image")


def read_header(content: bytes | None) -> Header:
    """Size, frames and mode of a file; any bytes are answered, never raised on."""
    content = content or b""
    for magic, read in ((b"\xff\xd8\xff", _jpeg_header), (b"\x89PNG\r\n\x1a\n", _png_header), (b"BM", _bmp_header), (b"RIFF", _webp_header)):
        if content.startswith(magic):
            try:
                return read(content)
            except (struct.error, IndexError):
                return Header(None, None, 1, None, "truncated")
    return NONE


def _png_chunks(content: bytes):
    at = 8
    while True:
        if at + 12 > len(content):
            raise IndexError
        (n,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if len(content) < at + 12 + n:
            raise IndexError
        yield kind, body, struct.unpack_from(">I", content, at + 8 + n)[0] == zlib.crc32(kind + body)
        if kind == b"IEND":  # what follows is not part of the image
            return
        at += n + 12


PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _png_header(content: bytes) -> Header:
    """The first chunk's sizes, the frame count of an animation, and whether all chunks are whole."""
    kind, n = content[12:16], struct.unpack_from(">I", content, 8)[0]
    if kind != b"IHDR" or n != 13:
        return Header(None, None, 1, None, "no header chunk")
    width, height, depth, colour = struct.unpack_from(">IIBB", content, 16)
    frames, error, data = 1, None, False
    if colour not in PNG_MODES or not width or not height or depth not in (1, 2, 4, 8, 16):
        error = "bad header"
    try:
        for kind, body, whole in _png_chunks(content):
            if not whole:
                error = error or "bad checksum"
            if kind == b"acTL" and not data and len(body) >= 4:
                frames = max(frames, struct.unpack(">I", body[:4])[0])
            data = data or kind == b"IDAT"
        error = error if data else error or "no pixels"
    except IndexError:
        error = error or "truncated"
    return Header(width, height, frames, PNG_MODES.get(colour), error)


def _jpeg_segments(content: bytes):
    """Marker, place and length of each segment; scans are passed over to the marker that ends them."""
    at = 2
    while True:
        while content[at] == 0xFF and content[at + 1] == 0xFF:
            at += 1
        if content[at] != 0xFF:
            raise IndexError
        marker = content[at + 1]
        if marker == 0xD9:
            yield marker, at + 2, 0
            return
        n = struct.unpack_from(">H", content, at + 2)[0]
        if n < 2 or at + 2 + n > len(content):
            raise IndexError
        yield marker, at + 4, n - 2
        at += 2 + n
        if marker == 0xDA:
            while True:
                at = content.find(b"\xff", at)
                if at < 0:
                    raise IndexError
                if content[at + 1] == 0 or 0xD0 <= content[at + 1] <= 0xD7:
                    at += 2
                else:
                    break


def _is_frame(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


def _jpeg_header(content: bytes) -> Header:
    """Sizes of the frame segment, the number of pictures of a multi-picture file, and whether the end marker is there."""
    width = height = mode = None
    frames, scans, error = 1, 0, None
    try:
        for marker, at, n in _jpeg_segments(content):
            if _is_frame(marker) and width is None:
                _, height, width, parts = struct.unpack_from(">BHHB", content, at)
                mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(parts)
            elif marker == 0xE2 and content[at : at + 4] == b"MPF\0":
                frames = max(frames, _pictures(content[at + 4 : at + n]))
            scans += marker == 0xDA
        if not scans:
            error = "no pixels"
    except (IndexError, struct.error):
        error = "truncated"
    if not width or not height or mode is None:
        return Header(width or None, height or None, frames, mode, error or "no frame header")
    return Header(width, height, frames, mode, error)


def _pictures(tiff: bytes) -> int:
    """The number of images of a multi-picture index."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return 1
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, _, _, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
        if tag == 0xB001:
            return value
    return 1


def _bmp_parts(content: bytes) -> tuple[int, int, int, int, int, int]:
    """offset of the pixels, header size, width, height (negative: top down), bits, compression."""
    offset, size = struct.unpack_from("<II", content, 10)
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", content, 18)
        return offset, size, width, height, bits, 0
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", content, 18)
    return offset, size, width, height, bits, packing


def _bmp_header(content: bytes) -> Header:
    offset, _, width, height, bits, packing = _bmp_parts(content)
    if width <= 0 or not height:
        return Header(None, None, 1, None, "bad header")
    row = (width * bits + 31) // 32 * 4
    short = packing == 0 and offset + row * abs(height) > len(content)
    return Header(width, abs(height), 1, "RGB" if bits > 8 else "P", "truncated" if short else None)


def _webp_header(content: bytes) -> Header:
    if content[8:12] != b"WEBP":
        return NONE
    width = height = mode = None
    moving, frames, pixels = False, 0, False
    end, at = struct.unpack_from("<I", content, 4)[0] + 8, 12
    error = "truncated" if end > len(content) else None
    while at + 8 <= min(end, len(content)):
        kind, n = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + min(n, 16)]
        if kind == b"VP8X":
            moving, mode = bool(body[0] & 2), "RGBA" if body[0] & 16 else "RGB"
            width, height = (1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7))
        elif kind == b"VP8 ":
            pixels = True
            if width is None and body[3:6] == b"\x9d\x01\x2a":
                width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
                mode = "RGB"
        elif kind == b"VP8L":
            pixels = True
            if width is None and body[:1] == b"\x2f":
                bits = int.from_bytes(body[1:5], "little")
                width, height, mode = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
        elif kind == b"ANMF":
            frames, pixels = frames + 1, True
        at += 8 + n + n % 2
    frames = max(frames, 2 if moving else 1)
    if not width or not height:
        return Header(None, None, frames, mode, error or "no frame header")
    return Header(width, height, frames, mode, error or (None if pixels else "no pixels"))


# --- pixels


def decode(content: bytes) -> np.ndarray:
    """RGB pixels (height x width x 3, bytes) of a whole file; ``ImageError`` where they can't be had."""
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png_pixels(content)
        if content.startswith(b"BM") and _bmp_parts(content)[5] == 0:
            return _bmp_pixels(content)
        if content.startswith(b"\xff\xd8\xff"):
            frame = next((content[at - 3] for m, at, _ in _jpeg_segments(content) if _is_frame(m)), None)
            if frame in (0xC0, 0xC1):
                return _Jpeg(content).pixels()
        return _by_library(content)
    except ImageError:
        raise
    except (struct.error, IndexError, KeyError, StopIteration, ValueError, zlib.error, TypeError) as e:
        raise ImageError(f"not a whole image: {e}") from e


def _by_library(content: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError:
        raise ImageError("no image library is installed for this kind of file") from None
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception as e:  # the library has many kinds of errors for broken files
        raise ImageError(str(e)) from e


def _samples(packed: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Rows of bytes as rows of samples (height x width x channels) at their depth."""
    if depth == 16:
        packed = packed[:, ::2]  # the upper byte is enough for 8 bits
    elif depth < 8:
        bits = np.unpackbits(packed, axis=1)[:, : width * channels * depth]
        packed = (bits.reshape(len(packed), -1, depth) * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    return packed[:, : width * channels].reshape(len(packed), width, channels)


def _unfilter(raw: bytes, height: int, row: int, step: int) -> tuple[np.ndarray, bytes]:
    """Rows (height x row bytes) without their filters, and what is left of the data."""
    if len(raw) < height * (row + 1):
        raise ImageError("too few pixels")
    data = np.frombuffer(raw, np.uint8, height * (row + 1)).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for i in range(height):
        kind, line = data[i, 0], data[i, 1:]
        if kind == 0:
            out[i] = line
        elif kind == 1:  # the sum of all bytes before at the same place of a pixel
            wide = np.zeros((-(-row // step), step), np.uint8)
            wide.reshape(-1)[:row] = line
            out[i] = np.cumsum(wide, axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif kind == 2:
            out[i] = line + above
        elif kind in (3, 4):
            left, corner, now, up, new = [0] * step, [0] * step, line.tolist(), above.tolist(), []
            for k in range(row):
                a, b, c = left[k % step], up[k], corner[k % step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                value = (now[k] + guess) & 255
                left[k % step], corner[k % step] = value, b
                new.append(value)
            out[i] = new
        else:
            raise ImageError("unknown row filter")
        above = out[i]
    return out, raw[height * (row + 1) :]


#: First row and column and steps of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _png_pixels(content: bytes) -> np.ndarray:
    width, height, depth, colour, _, _, laced = struct.unpack_from(">IIBBBBB", content, 16)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    palette, data = None, []
    for kind, body, whole in _png_chunks(content):
        if not whole:
            raise ImageError("bad checksum")
        if kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    unpack = zlib.decompressobj()
    most = (height + 7) * (width * channels * max(depth, 8) // 8 + 9) * 2  # never more than the header announced
    raw = unpack.decompress(b"".join(data), most)
    step = max(1, channels * depth // 8)
    row = lambda w: (w * channels * depth + 7) // 8
    if laced:
        x = np.zeros((height, width, channels), np.uint8)
        for top, left, down, right in PASSES:
            h, w = -(-(height - top) // down), -(-(width - left) // right)
            if h > 0 and w > 0:
                part, raw = _unfilter(raw, h, row(w), step)
                x[top::down, left::right] = _samples(part, w, depth, channels)
    else:
        x = _samples(_unfilter(raw, height, row(width), step)[0], width, depth, channels)
    if colour == 3:
        return palette[x[:, :, 0]]
    if depth < 8:
        x = (x.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(x[:, :, :1], 3, axis=2) if channels < 3 else x[:, :, :3]


def _bmp_pixels(content: bytes) -> np.ndarray:
    offset, size, width, height, bits, _ = _bmp_parts(content)
    row = (width * bits + 31) // 32 * 4
    x = np.frombuffer(content, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    x = x if height < 0 else x[::-1]
    if bits in (24, 32):
        return x[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    if bits not in (1, 4, 8):
        raise ImageError("unknown depth")
    entry = 3 if size == 12 else 4
    colours = np.frombuffer(content[14 + size : offset], np.uint8)
    colours = colours[: len(colours) // entry * entry].reshape(-1, entry)[:, 2::-1]
    return colours[_samples(x, width, bits, 1)[:, :, 0]]


#: Where the k-th coefficient of a JPEG block stands (row by row).
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]
COSINES = np.array([[(0.5**0.5 if k == 0 else 1) * np.cos((2 * x + 1) * k * np.pi / 16) / 2 for x in range(8)] for k in range(8)])


class _Jpeg:
    """A baseline JPEG: Huffman-coded blocks of one or several components in one or several scans."""

    def __init__(self, content: bytes):
        self.content, self.quant, self.codes, self.restart, self.adobe = content, {}, {}, 0, None
        self.parts: list[dict] = []
        for marker, at, n in _jpeg_segments(content):
            if marker == 0xDB:
                self.read_quant(content[at : at + n])
            elif marker == 0xC4:
                self.read_codes(content[at : at + n])
            elif marker == 0xDD:
                (self.restart,) = struct.unpack_from(">H", content, at)
            elif marker == 0xEE and content[at : at + 5] == b"Adobe":
                self.adobe = content[at + 11]
            elif _is_frame(marker):
                self.read_frame(at)
            elif marker == 0xDA:
                self.read_scan(at, n)

    def read_quant(self, body: bytes) -> None:
        while body:
            wide, name = body[0] >> 4, body[0] & 15
            n = 64 << wide
            table = np.zeros(64)
            table[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
            self.quant[name], body = table, body[1 + n :]

    def read_codes(self, body: bytes) -> None:
        """For each 16 bits that lie ahead the length of the code that they start with and its symbol."""
        while body:
            name, counts = body[0], body[1:17]
            ahead, at, code = [(0, 0)] * 65536, 17, 0
            for length, count in enumerate(counts, 1):
                for _ in range(count):
                    first, wide = code << (16 - length), 1 << (16 - length)
                    ahead[first : first + wide] = [(length, body[at])] * wide
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[name], body = ahead[:65536], body[at:]

    def read_frame(self, at: int) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", self.content, at)
        if depth != 8 or n not in (1, 3):
            raise ImageError("only 8-bit gray and three-component JPEGs are decoded")
        for k in range(n):
            name, ratio, quant = self.content[at + 6 + 3 * k : at + 9 + 3 * k]
            self.parts.append({"name": name, "h": ratio >> 4, "v": ratio & 15, "quant": quant})
        self.h, self.v = (max(p[k] for p in self.parts) for k in "hv")
        for p in self.parts:
            p["across"], p["down"] = -(-self.width // (8 * self.h)) * p["h"], -(-self.height // (8 * self.v)) * p["v"]
            p["blocks"] = np.zeros((p["down"] * p["across"], 64), np.int32)

    def read_scan(self, at: int, n: int) -> None:
        body = self.content[at : at + n]
        own = []
        for k in range(body[0]):
            part = next(p for p in self.parts if p["name"] == body[1 + 2 * k])
            own.append((part, self.codes[body[2 + 2 * k] >> 4], self.codes[16 + (body[2 + 2 * k] & 15)]))
        if len(own) == 1:  # one component alone comes block by block
            p = own[0][0]
            wide, tall = -(-self.width * p["h"] // (8 * self.h)), -(-self.height * p["v"] // (8 * self.v))
            units = [[(0, y * p["across"] + x)] for y in range(tall) for x in range(wide)]
        else:
            wide, tall = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
            units = [
                [(i, (y * p["v"] + b) * p["across"] + x * p["h"] + a) for i, (p, _, _) in enumerate(own) for b in range(p["v"]) for a in range(p["h"])]
                for y in range(tall) for x in range(wide)
            ]
        end = at + n
        for first in range(0, len(units), self.restart or len(units)):
            stop = end
            while not (self.content[stop] == 0xFF and self.content[stop + 1] != 0):
                stop = self.content.index(b"\xff", stop + (self.content[stop] == 0xFF))
            self.read_blocks(self.content[end:stop].replace(b"\xff\0", b"\xff"), units[first : first + (self.restart or len(units))], own)
            end = stop + 2

    @staticmethod
    def read_blocks(data: bytes, units: list, own: list) -> None:
        """Coefficients of the blocks between two restarts."""
        data += b"\xff\xff\xff\xff"
        before = [0] * len(own)
        bits = held = at = 0
        for unit in units:
            for i, place in unit:
                part, low, high = own[i]
                block, k = {}, 0
                while k < 64:
                    while held < 32:
                        bits = (bits << 8 | (data[at] if at < len(data) else 0)) & 0xFFFFFFFFFFFF
                        at, held = at + 1, held + 8
                        if at > len(data) + 8:
                            raise ImageError("too few pixels")
                    length, symbol = (high if k else low)[bits >> (held - 16) & 0xFFFF]
                    if not length:
                        raise ImageError("unknown code")
                    held -= length
                    size = symbol & 15 if k else symbol
                    if k and not size:
                        if symbol != 0xF0:
                            break
                        k += 16
                        continue
                    k += symbol >> 4 if k else 0
                    value = 0
                    if size:
                        held -= size
                        value = bits >> held & ((1 << size) - 1)
                        value -= 0 if value >> (size - 1) else (1 << size) - 1
                    if not k:
                        before[i] += value
                        value = before[i]
                    if k > 63:
                        raise ImageError("too many coefficients")
                    block[ZIGZAG[k]] = value
                    k += 1
                part["blocks"][place, list(block)] = list(block.values())

    def pixels(self) -> np.ndarray:
        planes = []
        for p in self.parts:
            x = (p["blocks"] * self.quant[p["quant"]]).reshape(-1, 8, 8)
            x = np.clip(np.round(COSINES.T @ x @ COSINES + 128), 0, 255)
            x = x.reshape(p["down"], p["across"], 8, 8).swapaxes(1, 2).reshape(p["down"] * 8, p["across"] * 8)
            x = np.repeat(np.repeat(x, self.v // p["v"], axis=0), self.h // p["h"], axis=1)
            planes.append(x[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        if self.adobe == 0:
            return np.stack(planes, axis=2).astype(np.uint8)
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
        return np.clip(np.round(rgb), 0, 255).astype(np.uint8)
