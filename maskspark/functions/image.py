"""Gaussian blur of images. Uncompressed BMP needs numpy alone; other formats need Pillow, where it is installed."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd

from .base import Context, mask_function

DEFAULT_SIGMA = 10.0


def _kernel(sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma + 0.5))
    x = np.arange(-radius, radius + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blur_pixels(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of (height, width, channels) bytes; the edges are repeated outwards."""
    if sigma <= 0:
        return pixels
    k = _kernel(sigma)
    r = len(k) // 2
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(padded, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _blur_bmp(data: bytes, sigma: float) -> bytes:
    at, = struct.unpack_from("<I", data, 10)
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or depth not in (24, 32):
        raise ValueError("only uncompressed BMP of 24 or 32 bits")
    channels, rows = depth // 8, abs(height)
    stride = (width * channels + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride).copy()
    own = body[:, : width * channels].reshape(rows, width, channels)
    body[:, : width * channels] = blur_pixels(own, sigma).reshape(rows, width * channels)
    return data[:at] + body.tobytes() + data[at + stride * rows :]


def blur(data: bytes | None, sigma: float | None) -> bytes | None:
    """The image blurred, in its own format; NULL in, NULL out."""
    if data is None or sigma is None:
        return None
    data = bytes(data)
    if data[:2] == b"BM":
        return _blur_bmp(data, float(sigma))
    try:
        from PIL import Image, ImageFilter
    except ImportError as e:
        raise ValueError("images other than BMP need Pillow") from e
    import io

    image = Image.open(io.BytesIO(data))
    out = io.BytesIO()
    image.filter(ImageFilter.GaussianBlur(float(sigma))).save(out, format=image.format)
    return out.getvalue()


def _blur_series(data: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series([blur(d, s) for d, s in zip(data, sigma)], dtype=object)


@mask_function("image_blur", args=(1, 2))
def image_blur(ctx: Context, data: str, sigma: str = str(DEFAULT_SIGMA)) -> str:
    from pyspark.sql.functions import pandas_udf

    ctx.spark.udf.register("maskspark_image_blur", pandas_udf(_blur_series, "binary"))
    return f"maskspark_image_blur({data}, CAST({sigma} AS float))"
