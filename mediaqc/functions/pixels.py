"""Image features in numpy, run once an image inside mapInPandas.

Defined on H x W x 3 arrays of bytes in RGB order. Where a definition depends on a codec or a trained detector (JPEG
re-encoding, face cascades, key points) the figure is an input column instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LUMA = np.array([299, 587, 114], np.int64)


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma, rounded to bytes."""
    return ((rgb.astype(np.int64) @ LUMA + 500) // 1000).astype(np.uint8)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages: each target cell is the mean of the source it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        cells = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * m / n

    x = a.astype(np.float64)
    rows, columns = weights(a.shape[0], height), weights(a.shape[1], width)
    return np.einsum("ih,hw...,jw->ij...", rows, x, columns)


def at_most(a: np.ndarray, side: int) -> np.ndarray:
    """Unchanged if no side is longer, else shrunk in proportion."""
    h, w = a.shape[:2]
    if max(h, w) <= side:
        return a
    f = side / max(h, w)
    return np.clip(np.rint(resized(a, max(1, round(h * f)), max(1, round(w * f)))), 0, 255).astype(np.uint8)


def pixel_md5(rgb: np.ndarray) -> str:
    """Equal for images of equal size and pixels, whatever file they came in."""
    return hashlib.md5(np.array(rgb.shape[:2], np.int64).tobytes() + np.ascontiguousarray(rgb).tobytes()).hexdigest()


def _bits(b: np.ndarray) -> int:
    return int("".join("1" if x else "0" for x in b.ravel()), 2)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))


def phash(g: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """Low frequencies of the cosine transform against their median."""
    n = size * factor
    c = _cosines(n)
    low = (c @ resized(g, n, n) @ c.T)[:size, :size]
    return _bits(low > np.median(low))


def dhash(g: np.ndarray, size: int = 8) -> int:
    small = np.rint(resized(g, size, size + 1))
    return _bits(small[:, 1:] > small[:, :-1])


def whash(g: np.ndarray, size: int = 8) -> int:
    """The coarse band of a Haar decomposition, its lowest frequency removed, against its median."""
    side = max(size, 1 << int(np.log2(max(min(g.shape), size))))
    band = resized(g, side, side) / 255
    while band.shape[0] > size:
        band = (band[::2, ::2] + band[1::2, ::2] + band[::2, 1::2] + band[1::2, 1::2]) / 2
    band = band - band.mean()
    return _bits(band > np.median(band))


def moire(g: np.ndarray) -> float:
    """The ratio of the 99th percentile to the mean of the spectrum without its centre, over 20, at most 1."""
    m = np.abs(np.fft.fftshift(np.fft.fft2(g.astype(np.float64))))
    h, w = m.shape
    m[max(0, h // 2 - 5) : h // 2 + 5, max(0, w // 2 - 5) : w // 2 + 5] = 0
    return float(min(np.percentile(m, 99) / (m.mean() + 1e-10) / 20, 1))


def blur(g: np.ndarray) -> float:
    """Variance of the Laplacian, borders mirrored without the edge."""
    x = np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def timestamp(g: np.ndarray) -> bool:
    """Bright writing on dark in a lower corner."""
    h, w = g.shape
    dh, dw = max(30, h // 12), max(80, w // 6)
    for corner in (g[max(0, h - dh) :, :dw], g[max(0, h - dh) :, max(0, w - dw) :]):
        bright, dark = (corner > 230).mean(), (corner <= 50).mean()
        if bright > 0.08 and dark > 0.35 or corner.mean() < 70 and bright > 0.02:
            return True
    return False


def edge_band(g: np.ndarray) -> tuple[float, float]:
    h, w = g.shape
    k = max(10, min(h, w) // 20)
    band = np.concatenate([g[:k].ravel(), g[-k:].ravel(), g[:, :k].ravel(), g[:, -k:].ravel()]).astype(np.float64)
    return float(band.mean()), float(band.std())


def peaks(rgb: np.ndarray) -> int:
    """The most histogram bins, of 32 in a channel, with over three times the mean count."""
    most = 0
    for c in range(3):
        counts = np.histogram(rgb[:, :, c], bins=32)[0]
        most = max(most, int((counts > counts.mean() * 3).sum()))
    return most


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255."""
    x = rgb.astype(np.float64)
    top, low = x.max(axis=2), x.min(axis=2)
    d = top - low
    safe = np.where(d == 0, 1, d)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    hue = np.where(d == 0, 0, np.rint(hue) % 180)
    return np.stack([hue, np.rint(np.where(top == 0, 0, d / np.where(top == 0, 1, top)) * 255), top], axis=2)


# fixed values: least and most hue, least saturation, least value; ranges of one line are summed
BRANDING = (
    ((100, 130, 90, 40),),
    ((0, 15, 90, 80), (155, 179, 90, 80)),
    ((5, 25, 90, 80),),
    ((35, 85, 80, 50),),
)


def branding(rgb: np.ndarray, least: float = 0.015) -> bool:
    """One of the colours covers more than ``least`` of the image; an empty image passes."""
    if not rgb.size:
        return True
    h, s, v = np.moveaxis(hsv(rgb), 2, 0)
    shares = [sum(((h >= a) & (h <= b) & (s >= c) & (v >= d)).mean() for a, b, c, d in ranges) for ranges in BRANDING]
    return any(x > least for x in shares)


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image upright, by the orientation that a camera noted (1 to 8; anything else leaves it as it is)."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return rgb[:, ::-1] if orientation in (2, 3, 6, 7) else rgb


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges of a gray image: ridges of the gradient that are strong, or weak and joined to strong ones."""
    x = np.pad(g.astype(np.float64), 1, mode="edge")
    smooth = lambda a, b, c: a + 2 * b + c
    across = smooth(x[:-2], x[1:-1], x[2:])
    down = smooth(x[:, :-2], x[:, 1:-1], x[:, 2:])
    dx, dy = across[:, 2:] - across[:, :-2], down[2:] - down[:-2]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    h, w = g.shape
    side = lambda r, c: m[1 + r : 1 + r + h, 1 + c : 1 + c + w]
    # the neighbours along the gradient, in one of four directions
    slope = np.abs(dy) / np.maximum(np.abs(dx), 1e-12)
    flat, steep, same = slope < np.tan(np.pi / 8), slope > np.tan(3 * np.pi / 8), dx * dy > 0
    ahead = np.where(flat, side(0, 1), np.where(steep, side(1, 0), np.where(same, side(1, 1), side(1, -1))))
    behind = np.where(flat, side(0, -1), np.where(steep, side(-1, 0), np.where(same, side(-1, -1), side(-1, 1))))
    ridge = (size > behind) & (size >= ahead)
    weak, found = ridge & (size > low), ridge & (size > high)
    rows, columns = np.nonzero(found)
    while len(rows):  # only what was reached last spreads on
        near = np.stack([(rows + r, columns + c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c], 1).reshape(2, -1)
        near = near[:, (near[0] >= 0) & (near[0] < h) & (near[1] >= 0) & (near[1] < w)]
        fresh = np.zeros_like(found)
        fresh[near[0], near[1]] = True
        fresh &= weak & ~found
        found |= fresh
        rows, columns = np.nonzero(fresh)
    return found


def poster(g: np.ndarray, share: float = 0.18) -> bool:
    """Print and posters have edges nearly everywhere."""
    return bool(g.size) and float(edges(g).mean()) > share


FEATURES = (
    "md5 string, ph_hi long, ph_lo long, dh_hi long, dh_lo long, wh_hi long, wh_lo long, raw_moire double, blur_score double, is_blurry boolean, "
    "has_timestamp boolean, gray_std double, edge_mean double, edge_std double, hist_peaks int, has_branding_colors boolean, poster boolean"
)


def features(rgb: np.ndarray, side: int = 960) -> tuple:
    small = at_most(rgb, side)
    g, gs = gray(rgb), gray(small)
    halves = [x for f in (phash, dhash, whash) for x in divmod(f(g), 1 << 32)]
    score = blur(gs)
    return pixel_md5(rgb), *halves, moire(gs), score, score < 80, timestamp(gs), float(gs.std()), *edge_band(gs), peaks(small), branding(small), poster(gs)


def measured(df: DataFrame, decode: Callable[[bytes], np.ndarray], content: str = "content") -> DataFrame:
    """Adds the features of encoded images. A row without content, or whose image cannot be decoded or measured, gets
    ``load_ok`` false and null features; it neither vanishes nor ends the job. ``decode`` gives H x W x 3 bytes."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def one(data) -> tuple:
        try:
            return *features(decode(bytes(data))), True
        except Exception:  # whatever a codec or an odd image raises
            return *([None] * len(names)), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(b) if b is not None else (*([None] * len(names)), False) for b in pdf[content]]
            columns = dict(zip([*names, "load_ok"], zip(*found, strict=True) if found else [()] * (len(names) + 1), strict=True))
            yield pdf.drop(columns="load_ok", errors="ignore").assign(**{n: pd.Series(list(v), index=pdf.index, dtype=object) for n, v in columns.items()})

    kept = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "load_ok")
    return df.mapInPandas(run, f"{kept}, {FEATURES}, load_ok boolean")


def extract(images: DataFrame) -> DataFrame:
    """Features of images as Spark's image source decodes them (BGR or gray), one pass an image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = np.repeat(a, 3, axis=2) if r.nChannels == 1 else a[:, :, 2::-1]
                rows.append((r.origin, r.height, r.width, *features(rgb)))
            yield pd.DataFrame(rows, columns=names)

    schema = f"origin string, height int, width int, {FEATURES}"
    names = [f.split()[0] for f in schema.split(", ")]
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, schema)
