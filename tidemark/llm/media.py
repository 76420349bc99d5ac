"""Operator 10: media columns. Payloads become PNG files in a binary column and are read back from it.

The writer makes 8-bit grey images and gives each row the filter, of plain, left and up, whose
differences are smallest; the reader takes any 8-bit grey or RGB PNG without
interlacing: it tests every chunk's checksum, inflates the data and undoes the five row
filters with numpy. Features are hashes of the low frequencies of a cosine transform.

Nulls: a null payload is an empty one; a null id stays null. An empty payload is
padded to one row. A damaged file gives null features and an `error` text, never an
exception. Equal payloads give equal files and features. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts

ROW_BYTES = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
_CHANNELS = {0: 1, 2: 3}


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; ValueError where the signature, a length or a checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("file ends inside a chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body, end = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], at + 12 + n
        if end > len(png) or struct.unpack_from(">I", png, end - 4)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in chunk {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise ValueError("no IEND chunk")


def filtered(rows: np.ndarray, kind: int, bpp: int = 1) -> np.ndarray:
    """Rows of samples under one filter kind, each with the kind's byte in front."""
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    up[1:] = x[:-1]
    corner[1:, bpp:] = x[:-1, :-bpp]
    if kind in (NONE, SUB, UP):
        guess = {NONE: 0, SUB: left, UP: up}[kind]
    else:
        guess = (left + up) >> 1 if kind == AVERAGE else _nearest(left, up, corner)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = (x - guess) & 255
    return out


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one nearest to left + up - corner; the earlier one in a tie."""
    base = left + up - corner
    far_left, far_up, far_corner = abs(base - left), abs(base - up), abs(base - corner)
    return np.where((far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up, corner))


def adaptive(rows: np.ndarray, kinds: tuple[int, ...] = (NONE, SUB, UP)) -> np.ndarray:
    """Rows of samples, each under the filter kind with the smallest sum of signed differences."""
    made = np.stack([filtered(rows, k) for k in kinds])
    cost = np.abs(made[:, :, 1:].view(np.int8).astype(np.int16)).sum(axis=2)
    return made[cost.argmin(axis=0), np.arange(len(rows))]


def unfiltered(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered lines. Plain, left and up rows are undone row by row; where a row needs each pixel's left neighbour and the row above, all rows go together along the diagonals."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if not len(kinds) or (kinds == NONE).all():
        return out
    if kinds.max() > PAETH:
        raise ValueError("unknown filter")
    if kinds.max() >= AVERAGE:
        return _by_diagonals(kinds, out, bpp)
    for y, kind in enumerate(kinds.tolist()):
        if kind == UP:
            if y:
                out[y] += out[y - 1]
        elif kind == SUB:
            for c in range(bpp):
                out[y, c::bpp] = np.add.accumulate(out[y, c::bpp], dtype=np.uint8)
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    """A pixel needs those to its left, above and between, which lie on the two diagonals before its own."""
    height, width = len(lines), lines.shape[1] // bpp
    raw = lines.reshape(height, width, bpp).astype(np.int16)
    done = np.zeros((height + 1, width + 1, bpp), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - y, kinds[y][:, None]
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        guess = np.select([kind == SUB, kind == UP, kind == AVERAGE, kind == PAETH], [left, up, (left + up) >> 1, _nearest(left, up, corner)], 0)
        done[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return done[1:, 1:].reshape(height, -1).astype(np.uint8)


def write_png(payload: bytes, row_bytes: int = ROW_BYTES, level: int = 6, kind: int | None = None) -> bytes:
    """A grey PNG whose samples are the payload; its length must be a positive multiple of row_bytes. kind: one filter for all rows, None to choose for each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row_bytes)
    header = struct.pack(">IIBBBBB", row_bytes, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress((adaptive(rows) if kind is None else filtered(rows, kind)).tobytes(), level)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_png(png: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit grey or RGB PNG."""
    header, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif not kind[0] & 32 and kind not in (b"IEND", b"PLTE"):
            raise ValueError(f"unknown critical chunk {kind!r}")
    if header is None:
        raise ValueError("no IHDR chunk")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in _CHANNELS or interlace:
        raise ValueError("only 8-bit grey or RGB without interlacing")
    bpp = _CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != height * (width * bpp + 1):
        raise ValueError("wrong amount of image data")
    return unfiltered(lines.reshape(height, -1), bpp).reshape(height, width, bpp)


#: transforms up to this length are kept: 512 of them have 16 MB at most
KEPT = 512


def _cosines(n: int, k: int = 8) -> np.ndarray:
    x = np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n)) * np.sqrt(2 / n)
    x[0] /= np.sqrt(2)
    return x


_kept_cosines = lru_cache(KEPT)(_cosines)


def cosines(n: int) -> np.ndarray:
    """The eight lowest rows of the orthonormal cosine transform of length n."""
    return _kept_cosines(n) if n <= KEPT else _cosines(n)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies of the whole image lie above their median."""
    grey = samples.mean(axis=2)
    low = np.round(cosines(grey.shape[0]) @ grey @ cosines(grey.shape[1]).T, 6).reshape(-1)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def padded(data: bytes, multiple: int = ROW_BYTES) -> bytes:
    return data + b" " * (-len(data) % multiple if data else multiple)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES, level: int = 6, kind: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of every whole text, padded with spaces, as a PNG in a binary column."""

    def encode(batches):
        for b in slices(batches, "text"):
            data = [(x or "").encode() for x in b.column("text").to_pylist()]
            media = [write_png(padded(x, row_bytes), row_bytes, level, kind) for x in data]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = texts(docs, id_col, text_col)
    return docs.mapInArrow(encode, docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def media_features(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) what is read back from the stored bytes; `error` tells what is wrong with a file."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "error"]

    def one(png: bytes) -> tuple:
        size, digest = len(png), hashlib.sha256(png).hexdigest()
        try:
            samples = read_png(png)
        except (ValueError, zlib.error, struct.error) as e:
            return None, None, None, size, digest, None, None, None, str(e)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, cosine_hash(samples), samples.shape[1], samples.shape[0], None

    def decode(batches):
        for b in slices(batches, "media"):
            rows = [one(x or b"") for x in b.column("media").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", *names])

    kinds = "long string long long string string int int string".split()
    base = media.select("doc_id", "n_bytes").schema.simpleString()[7:-1].split(",")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, ", ".join(x.replace(":", " ", 1) for x in base) + ", " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
