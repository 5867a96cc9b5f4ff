"""Operators that read what they have just written: one frame at a time.

Each frame is one group; frames are independent, so a table of many frames
spreads over the cluster, and no frame is larger than one task can hold
(100 million pixels in all; a side may be of any length, unlike in files).
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strokes import CH

SCHEMA = "doc_id long, x int, y int, r int, g int, b int, a int"
MAX_PIXELS = 100_000_000
#: Pixels that leave a task at once.
PART = 1 << 16


def check_size(w: int, h: int) -> None:
    if w * h > MAX_PIXELS:
        raise ValueError(f"a frame of {w} x {h} pixels is too large")


def in_parts(parts: Iterator[pd.DataFrame], w: int, h: int, f) -> Iterator[pd.DataFrame]:
    """``f(img, mask)`` of a frame whose pixels come and go in parts.

    Beside a part, only arrays of the frame are held: bytes while all values
    are, floats otherwise. ``mask`` is where rows are marked as ``hole``; a
    frame of no other rows gives none.
    """
    img, mask, doc_id, found = np.zeros((h, w, 4), np.uint8), np.zeros((h, w), bool), None, False
    for pdf in parts:
        hole, doc_id = pdf["hole"].to_numpy(bool), pdf["doc_id"].iloc[0]
        y, x, v = pdf["y"].to_numpy(int), pdf["x"].to_numpy(int), pdf[list(CH)].to_numpy()
        mask[y[hole], x[hole]] = True
        y, x, v = y[~hole], x[~hole], v[~hole]
        if len(v):
            found = True
            if img.dtype == np.uint8 and (v.dtype.kind != "i" or v.min() < 0 or v.max() > 255):
                img = img.astype(float)
            img[y, x] = v
    if found:
        flat = f(img, mask).reshape(-1, 4)
        for low in range(0, len(flat), PART):
            at, v = np.arange(low, min(len(flat), low + PART), dtype=np.int32), flat[low : low + PART].astype(np.int32)
            yield pd.DataFrame({"doc_id": doc_id, "x": at % w, "y": at // w, **{c: v[:, k] for k, c in enumerate(CH)}})


def per_frame(px: DataFrame, w: int, h: int, f, holes: DataFrame | None = None) -> DataFrame:
    """``f(img, mask)`` for each doc_id: the frame as an array (h, w, 4), and where ``holes`` (doc_id, x, y) are."""
    check_size(w, h)
    rows = px.select("doc_id", "x", "y", *CH, F.lit(False).alias("hole"))
    if holes is not None:
        rows = rows.unionByName(holes.select("doc_id", "x", "y", *[F.lit(0).alias(c) for c in CH], F.lit(True).alias("hole")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_parts(parts, w, h, f)

    return rows.groupBy("doc_id").applyInPandas(run, SCHEMA)


def dither_frame(img: np.ndarray) -> np.ndarray:
    """Two levels a channel, errors spread to the right and below; every other row runs backwards."""
    h, w = img.shape[:2]
    out = img.copy()
    for c in range(3):
        # errors are floats, a row's and the next one's; sums round to floats where they are stored
        err = array("f", bytes(4 * (w + 2)))
        for y in range(h):
            step = 1 if y % 2 == 0 else -1
            below, row = array("f", bytes(4 * (w + 2))), img[y, :, c].tolist()
            for x in range(w) if step > 0 else range(w - 1, -1, -1):
                v = row[x] + err[x + 1]
                v = 0.0 if v < 0 else 255.0 if v > 255 else v
                q = 0.0 if v <= 127 else 255.0
                row[x] = q
                e = v - q
                # fixed shares: ahead 7, below and behind 3, below 5, below and ahead 1 of 16
                err[x + 1 + step] += e * 0.4375
                below[x + 1 - step] += e * 0.1875
                below[x + 1] += e * 0.3125
                below[x + 1 + step] += e * 0.0625
            out[y, :, c] = row
            err = below
    return out


def inpaint_frame(img: np.ndarray, mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """Masked pixels filled from the rim inwards; within a wave later pixels see earlier ones."""
    h, w = mask.shape
    out, known, r = img.copy(), ~mask, max(1, int(radius))
    while not known.all():
        pad = np.pad(known, 1)
        near = np.zeros_like(known)
        for dy in range(3):
            for dx in range(3):
                if (dx, dy) != (1, 1):
                    near |= pad[dy : dy + h, dx : dx + w]
        wave = np.argwhere(~known & near)
        if not len(wave):
            break
        for y, x in wave:
            ys, xs = slice(max(0, y - r), y + r + 1), slice(max(0, x - r), x + r + 1)
            jj, ii = np.mgrid[ys.start : min(h, ys.stop), xs.start : min(w, xs.stop)]
            k = known[ys, xs] / (1.0 + (jj - y) ** 2 + (ii - x) ** 2)
            total = k.sum()
            if total > 0:
                out[y, x, :3] = np.rint(np.clip((out[ys, xs, :3] * k[..., None]).sum(axis=(0, 1)) / total, 0, 255))
            known[y, x] = True
    return out


def rain_frame(img: np.ndarray, density: float = 0.015, seed: int = 42, length: int = 14) -> np.ndarray:
    """Drops from a linear congruential sequence; a drop ends where another already is."""
    h, w = img.shape[:2]
    out, wet, s, n = img.copy(), np.zeros((h, w), bool), seed & 0xFFFFFFFF, max(2, int(length))
    for _ in range(math.floor(w * h * density)):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        x = math.floor(s / 4294967296 * w)
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        y = math.floor(s / 4294967296 * h)
        column = wet[y : y + n, x]
        run = int(column.argmax()) if column.any() else n
        stop = min(h, y + run)
        if stop > y:
            t = 1 - np.arange(stop - y) / n
            wet[y:stop, x] = True
            out[y:stop, x, :3] = np.floor(np.clip(img[y:stop, x, :3] * 0.5 + 160 * t[:, None], 0, 255))
    return out


def grain_frame(img: np.ndarray, intensity: float = 18, seed: int = 1337) -> np.ndarray:
    """One step of a congruential sequence for each pixel, in scan order; products round as doubles do."""
    h, w = img.shape[:2]
    noise, s = np.empty(h * w), float(seed & 0xFFFFFFFF)
    for k in range(h * w):
        s = float(int(s * 22695477.0 + 1.0) & 0xFFFFFFFF)
        noise[k] = (s / 4294967296 - 0.5) * intensity * 2
    out = img.copy()
    out[:, :, :3] = np.floor(np.clip(img[:, :, :3] + noise.reshape(h, w, 1), 0, 255))
    return out


def dither(px: DataFrame, w: int, h: int) -> DataFrame:
    return per_frame(px, w, h, lambda img, _: dither_frame(img))


def rain(px: DataFrame, w: int, h: int, density: float = 0.015, seed: int = 42, length: int = 14) -> DataFrame:
    return per_frame(px, w, h, lambda img, _: rain_frame(img, density, seed, length))


def grain(px: DataFrame, w: int, h: int, intensity: float = 18, seed: int = 1337) -> DataFrame:
    return per_frame(px, w, h, lambda img, _: grain_frame(img, intensity, seed))


def inpaint(px: DataFrame, mask: DataFrame, w: int, h: int, radius: int = 2) -> DataFrame:
    """``mask``: (doc_id, x, y) of the pixels to fill."""
    return per_frame(px, w, h, lambda img, hole: inpaint_frame(img, hole, radius), mask)
