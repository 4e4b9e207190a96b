"""Profiles of decoded images: one Arrow-batched pass over a table of pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rec. 601 luminance weights and the thresholds of the profile features.
LUMA = (0.299, 0.587, 0.114)
CLIPPED, CRUSHED, EDGE, NOISE_SAMPLES, MAD_SCALE = 250, 5, 40, 2048, 1.4826

SCHEMA = """
id bigint, width int, height int, aspect_ratio double, mean_luminance double, std_luminance double, rms_contrast double,
mean_saturation double, colorfulness double, sharpness double, edge_density double, noise double, clipped_highlights double,
crushed_blacks double, dominant_hue double, jpeg_quality double, dhash string, ahash string
"""


def _hue_and_saturation(rgb: np.ndarray) -> tuple[float, float]:
    """Mean saturation, and the centre of the heaviest of twelve saturation-weighted hue bins."""
    r, g, b = rgb[:, 0], rgb[:, 1], rgb[:, 2]
    top, low = rgb.max(axis=1), rgb.min(axis=1)
    spread = top - low
    saturation = np.divide(spread, top, out=np.zeros_like(top), where=top > 0)
    colored = spread > 0
    safe = np.where(colored, spread, 1)
    hue = np.select(
        [top == r, top == g], [np.fmod((g - b) / safe, 6), (b - r) / safe + 2], (r - g) / safe + 4
    ) * 60
    bins = np.minimum(11, np.floor(np.where(hue < 0, hue + 360, hue) / 30)).astype(int)
    weight = np.bincount(bins[colored], weights=saturation[colored], minlength=12)
    return float(saturation.mean()), float(weight.astype(np.float32).argmax() * 30 + 15)


def _sharp(gray: np.ndarray) -> tuple[float, float, float]:
    """Laplacian variance (zero border included), noise from its median, Sobel edge share."""
    lap = np.zeros_like(gray)
    if min(gray.shape) >= 3:
        lap[1:-1, 1:-1] = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    flat = lap.ravel()
    variance = float(flat.astype(float).var())
    median = np.partition(np.abs(flat), flat.size // 2)[flat.size // 2]
    edges = 0.0
    if min(gray.shape) >= 3:
        v = gray.astype(float)
        gx = (v[:-2, 2:] + 2 * v[1:-1, 2:] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[1:-1, :-2] + v[2:, :-2])
        gy = (v[2:, :-2] + 2 * v[2:, 1:-1] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[:-2, 1:-1] + v[:-2, 2:])
        edges = float((np.hypot(gx, gy) > EDGE).mean())
    return (0.0 if variance < 1e-12 else variance), float(MAD_SCALE * median), edges


def _jpeg_quality(gray: np.ndarray) -> float:
    """From the extra step at every eighth column; 90 for small images, 95 for flat ones."""
    height, width = gray.shape
    if width < 16 or height < 16:
        return 90.0
    steps = np.abs(np.diff(gray.astype(float), axis=1))[:, : width - 2]
    border = np.arange(1, width - 1) % 8 == 0
    inner = steps[:, ~border].mean()
    if inner == 0:
        return 95.0
    blocky = max(0.0, (steps[:, border].mean() - inner) / inner)
    return float(max(10, min(100, np.floor(100 - blocky * 80 + 0.5))))


def _bits_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def _hashes(gray: np.ndarray) -> tuple[str, str]:
    """Row-gradient hash of a 9 x 8 bilinear grid and mean hash of an 8 x 8 nearest grid."""
    height, width = gray.shape
    y, x = (np.arange(8) + 0.5) * (height / 8), (np.arange(9) + 0.5) * (width / 9)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(height - 1, y0 + 1), np.minimum(width - 1, x0 + 1)
    wy, wx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda rows, cols: gray[np.ix_(rows, cols)]
    top = (1 - wx) * at(y0, x0) + wx * at(y0, x1)
    grid = ((1 - wy) * top + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))).astype(np.float32)
    near = at(y0, np.floor((np.arange(8) + 0.5) * (width / 8)).astype(int)).astype(float)
    return _bits_hex(grid[:, :-1] > grid[:, 1:]), _bits_hex(near > near.sum() / 64)


def profile_one(key: int, width: int, height: int, pixels: np.ndarray) -> tuple:
    """All features of one RGB image given as width * height * 3 values."""
    rgb = np.asarray(pixels, dtype=float).reshape(height * width, 3)
    luma = rgb @ np.array(LUMA)
    gray = luma.astype(np.float32).reshape(height, width)
    mean = float(luma.mean())
    variance = float(((gray.ravel().astype(float) - mean) ** 2).mean())
    std = 0.0 if variance < 1e-12 else variance**0.5
    rg, yb = rgb[:, 0] - rgb[:, 1], 0.5 * (rgb[:, 0] + rgb[:, 1]) - rgb[:, 2]
    color = float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))
    saturation, hue = _hue_and_saturation(rgb)
    sharpness, noise, edges = _sharp(gray)
    dhash, ahash = _hashes(gray)
    return (
        key, width, height, width / height, mean, std, std / 255, saturation, color, sharpness, edges, noise,
        float((luma >= CLIPPED).mean()), float((luma <= CRUSHED).mean()), hue, _jpeg_quality(gray), dhash, ahash,
    )


COLUMNS = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(",")]


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [profile_one(int(k), int(w), int(h), p) for k, w, h, p in zip(batch.id, batch.width, batch.height, batch.pixels)]
        yield pd.DataFrame(rows, columns=COLUMNS)


def profile_images(images: DataFrame) -> DataFrame:
    """``images``: id, width, height, pixels (RGB values, row by row). Images without pixels are dropped.

    No shuffle: each task profiles the images it reads, one Arrow batch at a time.
    """
    usable = images.filter((F.col("width") > 0) & (F.col("height") > 0))
    return usable.select("id", "width", "height", "pixels").mapInPandas(_profile, SCHEMA.strip())
