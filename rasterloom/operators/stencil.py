"""Neighbourhood operators over frames held as scanlines.

A row of a frame is one record: y and an array of bytes for each channel. Rows
are dealt into bands of a bounded height, and each row also goes to the bands
that it borders (a halo as high as the operator's reach), so a band is complete
in its own group and large frames spread over many tasks. One shuffle serves a
whole operator, however many passes it has: a band arrives as Arrow columns and
is computed as matrices, tap by tap in kernel order, so rounding is the same on
every run and equal to a sum over single pixels.

``h`` is the frame's height: frame sizes are metadata, not scanned for. A frame
holds each of its rows once; a band that misses a row it needs, holds one twice,
or has a row of another width raises an error rather than shift its neighbours.
Rows outside 0..h-1 are not part of the frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

#: Rows of a band, and pixels it holds at most besides its halo.
BAND, PIXELS = 256, 1 << 21
CH = ("r", "g", "b", "a")
RGB = ("r", "g", "b")
EDGES = ("clamp", "wrap", "mirror", "reflect", "extend")
Plane = np.ndarray


# -- kernels --------------------------------------------------------------------


def single(v: float) -> float:
    return float(np.float32(v))


def gaussian_kernel(radius: int) -> list[float]:
    """Weights in single precision, sigma from the radius."""
    rad = max(1, int(radius))
    sigma = rad / 3 * 1.75 + 0.35
    raw = [single(math.exp(-((i - rad) ** 2) / (2 * sigma * sigma))) for i in range(2 * rad + 1)]
    total = sum(raw)
    return [single(v / total) for v in raw]


def frequency_kernel(radius: float) -> list[float]:
    r = max(1, math.floor(radius + 0.5))
    raw = [math.exp(-(i * i) / (2 * r * r * 0.5 + 0.5)) for i in range(-r, r + 1)]
    return [v / sum(raw) for v in raw]


def glow_kernel(radius: int) -> list[float]:
    r = max(1, int(radius))
    sigma = r * 0.6
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(raw) for v in raw]


# -- edges ------------------------------------------------------------------------


def edge(v: Plane, n: int, mode: str = "clamp") -> Plane:
    """Coordinates ``v`` brought into 0..n-1."""

    def fold(x: Plane, m: int) -> Plane:
        t = np.abs(x) % (2 * m)
        return np.where(t >= m, 2 * m - 1 - t, t)

    if mode == "wrap":
        return v % n
    if mode == "mirror":
        t = v % (2 * n)
        return np.where(t >= n, 2 * n - 1 - t, t)
    if mode == "reflect":
        return fold(v, n)
    if mode == "extend":
        return fold(v - 1, n - 2) + 1
    return np.clip(v, 0, n - 1)


# -- bands ------------------------------------------------------------------------


def band_height(w: int, reach: int) -> int:
    """Rows of a band: fewer where rows are wide, and at least the reach, so a row goes to three bands at most."""
    return max(1, min(BAND, PIXELS // max(1, w)), reach)


def _bands(reach: int, h: int, high: int, mode: str) -> Column:
    """The bands that need row y."""
    last = (h - 1) // high
    y = F.col("y")
    lo = F.greatest(F.lit(0), F.floor((y - reach) / high).cast("int"))
    hi = F.least(F.lit(last), F.floor((y + reach) / high).cast("int"))
    near = F.sequence(lo, hi)
    if mode == "clamp" or not reach:
        return near
    # rows that stand in for positions outside the frame: at most one for each such position
    beyond = np.concatenate((np.arange(-reach, 0), np.arange(h, h + reach)))
    also: dict[int, set[int]] = {}
    for p, src in zip(beyond.tolist(), edge(beyond, h, mode).tolist()):
        also.setdefault(src, set()).update(range(max(0, (p - reach) // high), min(last, (p + reach) // high) + 1))
    table = F.create_map(*[x for src, b in also.items() for x in (F.lit(src), F.array(*[F.lit(i) for i in sorted(b)]))])
    more = table[y.cast("int")]
    return F.when(more.isNull(), near).otherwise(F.array_union(near, more))


def _matrix(column: pa.ChunkedArray, w: int) -> Plane:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    if len(flat.flatten()) != w * len(flat) or any(n != w for n in flat.value_lengths().unique().to_pylist()):
        raise ValueError(f"a row of the frame is not {w} wide")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), w)


def banded(
    rows: DataFrame,
    w: int,
    h: int,
    reach: int,
    f: Callable[[dict[str, Plane], Plane], dict[str, Plane]],
    keys: tuple[str, ...] = (),
    needs: tuple[str, ...] = CH,
    gives: tuple[str, ...] = CH,
    mode: str = "clamp",
    kind: str = "int",
) -> DataFrame:
    """(keys, y, ``gives``) of ``f(planes, at)``, band by band.

    A plane holds the rows at the positions ``at``: those of the band and
    ``reach`` more on either side, edges resolved. ``f`` returns planes of the
    band's own rows.
    """
    high = band_height(w, reach)
    schema = ty.StructType([rows.schema[k] for k in keys] + [rows.schema["y"]] + [ty.StructField(c, ty.ArrayType(ty.IntegerType() if kind == "int" else ty.DoubleType())) for c in gives])
    own = pa.int32() if kind == "int" else pa.float64()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * high
        at = np.arange(first - reach, min(h, first + high) + reach)
        y = table.column("y").to_numpy()
        order = np.argsort(y, kind="stable")
        y, want = y[order], edge(at, h, mode)
        i = np.minimum(np.searchsorted(y, want), len(y) - 1)
        if (y[i] != want).any() or (len(y) > 1 and (y[1:] == y[:-1]).any()):
            raise ValueError(f"frame {[k.as_py() for k in key[:-1]]}: of rows {want.min()} to {want.max()} one is missing or repeated")
        out = f({c: _matrix(table.column(c), w)[order][i] for c in needs}, at)
        n = len(at) - 2 * reach
        data = [pa.repeat(k, n) for k in key[:-1]] + [pa.array(at[reach : reach + n]).cast(table.schema.field("y").type)]
        for c in gives:
            flat = np.ascontiguousarray(out[c]).ravel()
            data.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(flat.astype(np.int32 if kind == "int" else np.float64)).cast(own)))
        return pa.Table.from_arrays(data, names=schema.names)

    dealt = rows.filter((F.col("y") >= 0) & (F.col("y") < h)).select(*keys, "y", *needs, F.explode(_bands(reach, h, high, mode)).alias("band"))
    return dealt.groupBy(*keys, "band").applyInArrow(run, schema)


# -- rounding and passes ------------------------------------------------------------


def even(v: Plane) -> Plane:
    return np.rint(np.clip(v, 0.0, 255.0))


def cut(v: Plane) -> Plane:
    return np.trunc(np.clip(v, 0.0, 255.0))


def up(v: Plane) -> Plane:
    return np.clip(np.floor(v + 0.5), 0, 255)


def _single(v: Plane) -> Plane:
    return v.astype(np.float32).astype(np.float64)


def across(a: Plane, kernel: list[float]) -> Plane:
    """Weighted sums along the rows, first tap first."""
    r, w = len(kernel) // 2, a.shape[1]
    wide = a[:, edge(np.arange(-r, w + r), w)]
    out = np.zeros(a.shape)
    for i, k in enumerate(kernel):
        out += k * wide[:, i : i + w]
    return out


def down(a: Plane, kernel: list[float]) -> Plane:
    """Weighted sums along the columns of a plane with a halo of the kernel's radius, which goes."""
    n = len(a) - len(kernel) + 1
    out = np.zeros((n, a.shape[1]))
    for i, k in enumerate(kernel):
        out += k * a[i : i + n]
    return out


def inner(a: Plane, reach: int) -> Plane:
    """A plane without its halo."""
    return a[reach : len(a) - reach]


def blurred(a: Plane, kernel: list[float], first=even, second=even) -> Plane:
    return second(down(first(across(a, kernel)), kernel))


def boxed(a: Plane, r: int) -> Plane:
    """Means over 2r+1 bytes, along rows and then columns; sums of whole numbers, so running sums are exact."""
    n, w = 2 * r + 1, a.shape[1]
    wide = a[:, edge(np.arange(-r, w + r), w)].astype(np.int64)
    run = np.concatenate((np.zeros((len(a), 1), np.int64), np.cumsum(wide, axis=1)), axis=1)
    one = even((run[:, n:] - run[:, :-n]) / n).astype(np.int64)
    run = np.concatenate((np.zeros((1, w), np.int64), np.cumsum(one, axis=0)))
    return even((run[n:] - run[:-n]) / n)


def taps(a: Plane, reach: int, mode: str = "clamp") -> Callable[[int, int], Plane]:
    """``tap(dx, dy)``: the plane of neighbours at that offset."""
    w, n = a.shape[1], len(a) - 2 * reach
    wide = a[:, edge(np.arange(-reach, w + reach), w, mode)]
    return lambda dx, dy: wide[reach + dy : reach + dy + n, reach + dx : reach + dx + w]


# -- operators ----------------------------------------------------------------------


def convolve(rows, w, h, kernel: list[float], size: int, mode="clamp", gain=1.0, bias=0.0, keys=()):
    half = size // 2

    def f(src, at):
        out = {"a": inner(src["a"], half)}
        for c in RGB:
            tap, total = taps(src[c], half, mode), 0.0
            for i in range(size * size):
                total = total + tap(i % size - half, i // size - half) * float(kernel[i])
            out[c] = cut(total * gain + bias)
        return out

    return banded(rows, w, h, half, f, keys, mode=mode)


def gaussian_blur(rows, w, h, radius=4, keys=(), channels=CH):
    k = gaussian_kernel(radius)
    return banded(rows, w, h, len(k) // 2, lambda src, at: {c: blurred(src[c], k) for c in channels}, keys, channels, channels)


def frequency_blur(rows, w, h, radius=8, keys=()):
    """Like ``gaussian_blur`` with another sigma, single precision between the passes."""
    k = frequency_kernel(radius)
    return banded(rows, w, h, len(k) // 2, lambda src, at: {c: blurred(src[c], k, _single) for c in CH}, keys)


def box_blur(rows, w, h, radius=1, keys=()):
    r = max(1, int(radius))
    return banded(rows, w, h, r, lambda src, at: {c: boxed(src[c], r) for c in RGB} | {"a": inner(src["a"], r)}, keys)


def with_blur(rows, w, h, kernel: list[float], first, f: Callable[[Plane, Plane], Plane], keys=()) -> DataFrame:
    """``f(own, blurred)`` for each colour; alpha stays."""
    r = len(kernel) // 2
    return banded(rows, w, h, r, lambda src, at: {c: f(inner(src[c], r), blurred(src[c], kernel, first)) for c in RGB} | {"a": inner(src["a"], r)}, keys)


def unsharp_mask(rows, w, h, amount=1.2, radius=2, threshold=0, keys=()):
    f = lambda s, b: np.where(np.abs(s - b) < threshold, s, cut(s + (s - b) * float(amount)))
    return with_blur(rows, w, h, gaussian_kernel(radius), even, f, keys)


def emboss(rows, w, h, strength=1.5, direction=135.0, keys=()):
    rad = math.radians(direction)
    dx, dy = math.floor(math.cos(rad) + 0.5), math.floor(-math.sin(rad) + 0.5)

    def f(src, at):
        out = {"a": inner(src["a"], 1)}
        for c in RGB:
            tap = taps(src[c], 1)
            out[c] = cut((tap(dx, dy) * 0.5 - tap(-dx, -dy) * 0.5) * strength + 128.0)
        return out

    return banded(rows, w, h, 1, f, keys)


#: The gradient kernels and luma weights of the edge detector.
SOBEL_X = (-1, 0, 1, -2, 0, 2, -1, 0, 1)
SOBEL_Y = (-1, -2, -1, 0, 0, 0, 1, 2, 1)
LUMA = (0.299, 0.587, 0.114)


def _edges(src: dict[str, Plane], boost: float) -> Plane:
    """Gradient magnitude of the luma, at most 255; the halo of one goes."""
    luma = src["r"] * LUMA[0] + src["g"] * LUMA[1] + src["b"] * LUMA[2]
    tap = taps(luma, 1)
    grad = lambda k: sum((tap(i % 3 - 1, i // 3 - 1) * float(v) for i, v in enumerate(k) if v), 0.0)
    gx, gy = grad(SOBEL_X), grad(SOBEL_Y)
    return np.minimum(255.0, np.sqrt(gx * gx + gy * gy) * boost)


def sobel_edge(rows, w, h, invert=False, boost=1.0, keys=()):
    def f(src, at):
        mag = _edges(src, boost)
        v = even(255.0 - mag if invert else mag)
        return {"r": v, "g": v, "b": v, "a": np.full(v.shape, 255)}

    return banded(rows, w, h, 1, f, keys, RGB)


def median_filter(rows, w, h, radius=1, keys=()):
    n = 2 * radius + 1

    def f(src, at):
        out = {"a": inner(src["a"], radius)}
        for c in RGB:
            tap = taps(src[c].astype(np.uint8), radius)
            near = np.stack([tap(i % n - radius, i // n - radius) for i in range(n * n)])
            out[c] = np.partition(near, n * n // 2, axis=0)[n * n // 2]
        return out

    return banded(rows, w, h, radius, f, keys)


def posterized(v: Plane, levels: int) -> Plane:
    step = 255 / (max(2, levels) - 1)
    return cut(np.floor(np.floor(v / step + 0.5) * step + 0.5))


def cel_shade(rows, w, h, levels=4, boost=1.0, keys=()):
    """Posterised, with ink where the edge detector reaches 60."""
    ink = {"r": 20, "g": 20, "b": 24}

    def f(src, at):
        line = even(_edges(src, boost)) >= 60
        return {c: np.where(line, k, posterized(inner(src[c], 1), levels)) for c, k in ink.items()} | {"a": inner(src["a"], 1)}

    return banded(rows, w, h, 1, f, keys)


def kuwahara(rows, w, h, radius=3, keys=()):
    """Mean of the quadrant with the least variance; of equal ones the first."""
    r = max(1, int(radius))
    n = (r + 1) ** 2

    def f(src, at):
        tap = {c: taps(src[c], r) for c in RGB}
        best, out = None, {}
        for ox, oy in ((-r, -r), (0, -r), (-r, 0), (0, 0)):
            mean, var = {}, 0.0
            for c in RGB:
                total, square = 0.0, 0.0
                for i in range(n):
                    v = tap[c](ox + i % (r + 1), oy + i // (r + 1)).astype(float)
                    total, square = total + v, square + v * v
                mean[c] = total / float(n)
                var = var + (square / float(n) - mean[c] * mean[c])
            less = var < best if best is not None else np.ones(var.shape, bool)
            best = np.where(less, var, best) if best is not None else var
            out = {c: np.where(less, mean[c], out[c]) if out else mean[c] for c in RGB}
        return {c: even(v) for c, v in out.items()} | {"a": inner(src["a"], r)}

    return banded(rows, w, h, r, f, keys)


def to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    return F.when(v >= 1, 1.0).when(v <= 0, 0.0).when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def linear(v: Plane) -> Plane:
    """The same on planes."""
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def gamma(v: Plane) -> Plane:
    return np.where(v >= 1, 1.0, np.where(v <= 0.0031308, np.maximum(v, 0.0) * 12.92, 1.055 * np.maximum(v, 0.0) ** (1 / 2.4) - 0.055))


def bloom(rows, w, h, blur=12, intensity=0.7, keys=()):
    f = lambda s, b: cut(gamma(np.minimum(1.0, linear(s / 255.0) + linear(b / 255.0) * intensity)) * 255.0)
    return with_blur(rows, w, h, gaussian_kernel(blur), even, f, keys)


def motion_blur(rows, w, h, length=20, angle=0.0, zoom=0.0, keys=()):
    """``length`` taps along a line, and with ``zoom`` out from the centre; coordinates rounded to whole pixels, clamped.

    The reach follows from length, angle and zoom; with zoom it grows with the frame's height.
    """
    n = max(1, int(length))
    dx, dy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    fs = [t / n * 2 - 1 for t in range(n)]
    zoom = max(0.0, zoom)

    def to(v: Plane, f: float, d: float, size: int) -> Plane:
        mid = size / 2
        moved = mid + (v - mid) * (1 + f * zoom) if zoom else v
        return np.clip(np.floor(moved + d * f * length * 0.5 + 0.5).astype(int), 0, size - 1)

    every = np.arange(h)
    reach = max(int(np.abs(to(every, f, dy, h) - every).max(initial=0)) for f in fs)

    def run(src, at):
        own = inner(at, reach)
        out = {}
        for c in CH:
            total = 0
            for f in fs:
                total = total + src[c][np.ix_(to(own, f, dy, h) - at[0], to(np.arange(w), f, dx, w))].astype(np.int64)
            out[c] = even(total / float(n))
        return out

    return banded(rows, w, h, reach, run, keys)


def frequency_separate(rows, w, h, radius=8, keys=()) -> dict[str, DataFrame]:
    """low, high and their recombination."""
    k = frequency_kernel(radius)
    high = lambda s, b: up((s - b) / 2.0 + 128.0)
    return {
        "low": frequency_blur(rows, w, h, radius, keys),
        "high": with_blur(rows, w, h, k, _single, high, keys),
        "recon": with_blur(rows, w, h, k, _single, lambda s, b: up(b + 2.0 * (high(s, b) - 128)), keys),
    }


def frequency_layers(rows, w, h, radius=8, keys=()) -> dict[str, DataFrame]:
    """Two layers that give the frame back: ``low`` below, ``high`` over it in linear light mode; the difference is taken in linear light."""
    part = lambda s, b: up(gamma(np.clip((linear(s / 255.0) - linear(b / 255.0)) / 2 + 0.5, 0.0, 1.0)) * 255.0)
    return {"low": frequency_blur(rows, w, h, radius, keys), "high": with_blur(rows, w, h, frequency_kernel(radius), _single, part, keys)}


def smooth_tones(rows, w, h, radius=10, strength=0.7, keys=()):
    return with_blur(rows, w, h, frequency_kernel(radius), _single, lambda s, b: up(s + (b - s) * float(strength)), keys)


def blemish_mask(rows, w, h, threshold=30, radius=3, keys=()) -> DataFrame:
    """(keys, y, m): 1 where the pixel departs from its blur by more than ``threshold`` over the channels."""
    k = gaussian_kernel(radius)
    r = len(k) // 2
    f = lambda src, at: {"m": sum(np.abs(inner(src[c], r) - blurred(src[c], k)) for c in RGB) > threshold}
    return banded(rows, w, h, r, f, keys, RGB, ("m",))


def masked_smooth(rows, mask: DataFrame, w, h, radius=10, strength=0.6, keys=()):
    """Towards the blur where ``mask`` (y, m as an array of 0..1) is set."""
    k = gaussian_kernel(radius)
    r = len(k) // 2
    joined = rows.select(*keys, "y", *CH).join(mask.select(*keys, "y", F.transform("m", lambda v: v.cast("double")).alias("m")), [*keys, "y"])

    def f(src, at):
        m = inner(src["m"], r)
        soft = lambda s, b: up(s + (b - s) * m * float(strength))
        return {c: soft(inner(src[c], r), blurred(src[c], k)) for c in RGB} | {"a": inner(src["a"], r)}

    return banded(joined, w, h, r, f, keys, (*CH, "m"))


def glow_from_alpha(rows, w, h, color=(255, 210, 0), radius=14, intensity=1.0, keys=()):
    k = glow_kernel(radius)

    def f(src, at):
        soft = blurred(_single(src["a"] / 255.0), k, _single, _single)
        a = np.floor(np.minimum(1.0, soft * 1.4 * intensity) * 255.0 + 0.5)
        return {c: np.where(a > 0, v, 0) for c, v in zip(RGB, color)} | {"a": a}

    return banded(rows, w, h, len(k) // 2, f, keys, ("a",))


def drop_shadow(rows, w, h, dx=6, dy=8, blur=8, color=(0, 0, 0), opacity=0.55, keys=()):
    """A shifted, softened silhouette, cleared under the subject; means ignore what lies outside the frame."""
    sx, sy = math.floor(dx + 0.5), math.floor(dy + 0.5)
    rounds = min(3, max(0, math.floor(blur / 2 + 0.5)))
    reach = abs(sy) + rounds
    op = min(1.0, max(0.0, opacity))

    def f(src, at):
        a, n = src["a"], len(at)
        inside = ((at >= 0) & (at < h))[:, None]
        y, x = np.arange(n) - sy, np.arange(w) - sx
        there = ((y >= 0) & (y < n))[:, None] & ((x >= 0) & (x < w)) & ((at - sy >= 0) & (at - sy < h))[:, None]
        s = np.where(there & inside, a[np.clip(y, 0, n - 1)][:, np.clip(x, 0, w - 1)], 0).astype(float)
        count = np.pad(np.broadcast_to(inside, (n, w)).astype(float), 1)
        cells = sum(count[1 + j : 1 + j + n, 1 + i : 1 + i + w] for j in (-1, 0, 1) for i in (-1, 0, 1))
        for _ in range(rounds):
            wide = np.pad(np.where(inside, s, 0.0), 1)
            total = sum(wide[1 + j : 1 + j + n, 1 + i : 1 + i + w] for j in (-1, 0, 1) for i in (-1, 0, 1))
            s = even(total / np.maximum(1.0, cells))
        out = np.where(inner(a, reach) > 0, 0, np.floor(np.minimum(255.0, inner(s, reach) * op) + 0.5))
        return {c: np.where(out > 0, k, 0) for c, k in zip(RGB, color)} | {"a": out}

    return banded(rows, w, h, reach, f, keys, ("a",))
