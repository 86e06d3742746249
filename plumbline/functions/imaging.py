"""Image kernels that run on Arrow batches of encoded frames."""

from __future__ import annotations

import base64
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import as_col

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
THUMB = 32
MASK_THRESHOLD = 127


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit gray (H, W) or RGB (H, W, 3) pixels as PNG bytes."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = pixels.shape[:2]
    # Every line starts with filter type 0.
    lines = np.pad(pixels.reshape(h, -1), ((0, 0), (1, 0)))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> np.ndarray:
    """RGB or gray pixels of an encoded image.

    Uses Pillow where it is installed; without it only 8-bit non-interlaced PNG works.
    """
    try:
        from PIL import Image
    except ImportError:
        return _decode_png(data)
    picture = Image.open(io.BytesIO(data))
    return np.asarray(picture if picture.mode in ("L", "RGB") else picture.convert("RGB"))


def _decode_png(data: bytes) -> np.ndarray:
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image; install Pillow for other formats")
    at, body, head = 8, [], None
    while at < len(data):
        size = struct.unpack(">I", data[at:at + 4])[0]
        kind, content = data[at + 4:at + 8], data[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or bands is None or interlace:
        raise ValueError("unsupported PNG layout; install Pillow")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, 1 + width * bands)
    out = np.zeros((height, width * bands), dtype=np.uint8)
    above = np.zeros(width * bands, dtype=np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - bands] if x >= bands else 0
                corner = above[x - bands] if x >= bands else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda c: abs(p - c))
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    out = out.reshape(height, width, bands)
    return out[:, :, 0] if bands < 3 else out[:, :, :3]


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB pixels, rounded to 8 bits."""
    if pixels.ndim == 2:
        return pixels.astype(float)
    return np.rint(pixels.astype(float) @ np.array([0.299, 0.587, 0.114]))


def laplacian_variance(pixels: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian with mirrored borders; higher is sharper."""
    gray = np.pad(to_gray(pixels), 1, mode="reflect")
    inner = gray[1:-1, 1:-1]
    edges = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4.0 * inner
    return float(edges.var())


def _area_weights(size: int, cells: int) -> np.ndarray:
    # Share of each source pixel covered by each of `cells` equal target cells.
    edges = np.linspace(0.0, size, cells + 1)
    pixel = np.arange(size)
    cover = np.minimum(edges[1:, None], pixel + 1.0) - np.maximum(edges[:-1, None], pixel)
    return np.clip(cover, 0.0, None) * (cells / size)


def thumbnail(pixels: np.ndarray, size: int = THUMB) -> np.ndarray:
    """Mean-free unit-length gray thumbnail; a flat image stays all zero."""
    gray = to_gray(pixels)
    small = np.rint(_area_weights(gray.shape[0], size) @ gray @ _area_weights(gray.shape[1], size).T)
    small = small - small.mean()
    length = np.linalg.norm(small)
    return small / length if length > 1e-6 else small


def resize_linear(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned and borders repeated."""

    def taps(source: int, target: int):
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, source - 1), at - low

    y0, y1, fy = taps(pixels.shape[0], height)
    x0, x1, fx = taps(pixels.shape[1], width)
    p = pixels.astype(float)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy)[:, None] + low * fy[:, None])


def erode(mask: np.ndarray, px: int) -> np.ndarray:
    """Square erosion that ignores pixels outside the image; reverts when emptied."""
    if px <= 0:
        return mask
    kept = mask
    for axis in (0, 1):
        padded = np.pad(kept, [(px, px) if a == axis else (0, 0) for a in (0, 1)], constant_values=True)
        views = [np.take(padded, range(s, s + mask.shape[axis]), axis=axis) for s in range(2 * px + 1)]
        kept = np.logical_and.reduce(views)
    return kept if kept.any() else mask


def decode_mask(encoded: str, box: tuple[int, int, int, int], height: int, width: int) -> np.ndarray:
    """Full-image boolean mask of a base64 PNG probability map covering `box`."""
    payload = encoded.split(",", 1)[1] if encoded.startswith("data:") else encoded
    probability = to_gray(decode_image(base64.b64decode(payload)))
    x0, y0, x1, y1 = box
    if probability.shape != (y1 - y0, x1 - x0):
        probability = resize_linear(probability, y1 - y0, x1 - x0)
    mask = np.zeros((height, width), dtype=bool)
    mask[y0:y1, x0:x1] = probability >= MASK_THRESHOLD
    return mask


_FEATURES = T.StructType([
    T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
    T.StructField("sharpness", T.DoubleType()), T.StructField("thumb", T.ArrayType(T.FloatType())),
])


@F.pandas_udf(_FEATURES)
def frame_features(images: pd.Series) -> pd.DataFrame:
    """Size, sharpness and thumbnail of encoded frames."""
    rows = []
    for data in images:
        pixels = decode_image(bytes(data))
        rows.append((*pixels.shape[:2], laplacian_variance(pixels), thumbnail(pixels).astype("float32").ravel()))
    return pd.DataFrame(rows, columns=["h", "w", "sharpness", "thumb"])


def turned(pixels: np.ndarray, degrees: int) -> np.ndarray:
    """Rotate clockwise by 90, 180 or 270 degrees; anything else leaves the frame as is."""
    quarter = {90: -1, 180: 2, 270: 1}.get(degrees)
    return pixels if quarter is None else np.rot90(pixels, quarter)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Dot product of two equal-length arrays, clipped to -1..1."""
    parts = F.zip_with(as_col(a), as_col(b), lambda p, q: p.cast("double") * q.cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.least(F.greatest(total, F.lit(-1.0)), F.lit(1.0))
