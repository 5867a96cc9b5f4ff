"""Resampling, gathers, affine maps and whole-image reductions over pixels (keys, x, y, r, g, b, a).

A gather computes, for each target pixel, the coordinate it reads, and joins on
it: an equi-join keyed by frame and coordinate, whatever the mapping.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CH = ("r", "g", "b", "a")


def grid(spark: SparkSession, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """(x, y) of a half-open box."""
    ys = spark.range(y0, max(y0, y1)).select(F.col("id").cast("int").alias("y"))
    xs = F.explode(F.sequence(F.lit(x0), F.lit(x1 - 1))) if x1 > x0 else F.explode(F.array().cast("array<int>"))
    return ys.select(xs.alias("x"), "y")


def gather(target: DataFrame, source: DataFrame, sx: Column, sy: Column, keys: tuple[str, ...] = (), default: int | None = None) -> DataFrame:
    """Each target pixel with the colour at (sx, sy) of the source; targets without one are dropped, or clear with ``default``."""
    src = source.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"), *CH)
    rows = target.select(*keys, "x", "y", sx.cast("int").alias("_sx"), sy.cast("int").alias("_sy"))
    out = rows.join(src, [*keys, "_sx", "_sy"], "inner" if default is None else "left")
    return out.select(*keys, "x", "y", *[F.col(c) if default is None else F.coalesce(c, F.lit(default)).alias(c) for c in CH])


def pixelate(px: DataFrame, w: int, h: int, size: int = 8, keys=()) -> DataFrame:
    """The pixel at the middle of each block."""
    s = max(1, int(size))
    mid = lambda c, n: F.least(F.lit(n - 1), F.floor(F.col(c) / s) * s + s // 2)
    return gather(px, px, mid("x", w), mid("y", h), keys)


def kaleidoscope(px: DataFrame, w: int, h: int, segments: int = 8, cx=None, cy=None, keys=()) -> DataFrame:
    """Angles folded into one wedge of ``segments``; edges clamped."""
    cx, cy, n = w / 2 if cx is None else cx, h / 2 if cy is None else cy, max(2, int(segments))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    r = F.sqrt(dx * dx + dy * dy)
    turn = 2 * math.pi
    ang = F.atan2(dy, dx) * n
    ang = (ang % turn + turn) % turn
    within = ang % math.pi
    local = F.when(F.floor(ang / math.pi) % 2 == 0, within).otherwise(math.pi - within) / n
    at = lambda c, v, m: F.least(F.lit(m - 1), F.greatest(F.lit(0), F.floor(c + v * r + 0.5).cast("int")))
    return gather(px, px, at(cx, F.cos(local), w), at(cy, F.sin(local), h), keys)


def motion_zoom(px: DataFrame, w: int, h: int, length: int, angle: float, zoom: float, keys=()) -> DataFrame:
    """Taps along a line and out from the centre, whole coordinates, clamped; mean half-to-even."""
    n = max(1, int(length))
    dx, dy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    t = px.select(*keys, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t")).withColumn("f", F.col("t") / float(n) * 2 - 1)
    at = lambda c, mid, d, m: F.least(F.lit(m - 1), F.greatest(F.lit(0), F.floor(mid + (F.col(c) - mid) * (1 + F.col("f") * zoom) + d * F.col("f") * length * 0.5 + 0.5).cast("int")))
    src = px.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), *CH)
    joined = t.withColumns({"sx": at("x", w / 2, dx, w), "sy": at("y", h / 2, dy, h)}).join(src, [*keys, "sx", "sy"])
    return joined.groupBy(*keys, "x", "y").agg(*[F.rint(F.sum(c) / float(n)).cast("int").alias(c) for c in CH])


def scale_nearest(px: DataFrame, w: int, h: int, tw: int, th: int, keys=()) -> DataFrame:
    """Target pixel reads floor(t * size / target size)."""
    target = grid(px.sparkSession, 0, 0, tw, th)
    at = lambda c, n, m: F.least(F.lit(n - 1), F.floor(F.col(c) * n / m))
    if keys:
        target = px.select(*keys).distinct().withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(th - 1)))).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(tw - 1))).alias("x"), F.col("_y").alias("y"))
    return gather(target, px, at("x", w, tw), at("y", h, th), keys)


def scale_bilinear(px: DataFrame, w: int, h: int, tw: int, th: int) -> DataFrame:
    """Corners map to corners; four taps a pixel, summed in a fixed order, halves to even."""
    base = grid(px.sparkSession, 0, 0, tw, th)
    fx, fy = F.col("x") * (w - 1) / max(1, tw - 1), F.col("y") * (h - 1) / max(1, th - 1)
    base = base.withColumns({"fx": fx, "fy": fy}).withColumns({"x0": F.floor("fx").cast("int"), "y0": F.floor("fy").cast("int")})
    base = base.withColumns({"tx": F.col("fx") - F.col("x0"), "ty": F.col("fy") - F.col("y0")})
    tap = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i % 2).alias("dx"), F.lit(i // 2).alias("dy")) for i in range(4)])).alias("t")
    rows = base.select("*", tap)
    weight = F.when(F.col("t.dy") == 1, F.col("ty")).otherwise(1 - F.col("ty")) * F.when(F.col("t.dx") == 1, F.col("tx")).otherwise(1 - F.col("tx"))
    rows = rows.select("x", "y", F.col("t.i").alias("i"), weight.alias("k"), F.least(F.lit(w - 1), F.col("x0") + F.col("t.dx")).alias("sx"), F.least(F.lit(h - 1), F.col("y0") + F.col("t.dy")).alias("sy"))
    joined = rows.join(px.select(F.col("x").alias("sx"), F.col("y").alias("sy"), *CH), ["sx", "sy"])
    mixed = joined.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("i", "k", *CH))).alias("t"))
    one = lambda c: F.rint(F.aggregate("t", F.lit(0.0), lambda s, v: s + v[c] * v["k"])).cast("int")
    return mixed.select("x", "y", *[one(c).alias(c) for c in CH])


def crop(px: DataFrame, x: int, y: int, w: int, h: int, keys=(), keep_clear: bool = False) -> DataFrame:
    """A box moved to the origin; clear pixels are dropped unless asked for."""
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    rows = px.filter(inside if keep_clear else inside & (F.col("a") > 0))
    return rows.select(*keys, (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), *CH)


def crop_centre(px: DataFrame, w: int, h: int, cw: int, ch: int, keys=()) -> DataFrame:
    return crop(px, (w - cw) // 2, (h - ch) // 2, cw, ch, keys, keep_clear=True)


def crop_document(layers: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """All layers (x, y, z, r, g, b, a) cropped to one box."""
    return crop(layers, x, y, w, h, ("z",))


def move(px: DataFrame, dx: int, dy: int) -> DataFrame:
    return px.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


# -- affine maps ----------------------------------------------------------------------

Affine = tuple[float, float, float, float, float, float]
IDENTITY: Affine = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: Affine, n: Affine) -> Affine:
    """``n`` first, then ``m``."""
    lin = lambda x, y: (m[0] * x + m[2] * y, m[1] * x + m[3] * y)
    (a, b), (c, d), (e, f) = lin(n[0], n[1]), lin(n[2], n[3]), lin(n[4], n[5])
    return (a, b, c, d, e + m[4], f + m[5])


def translate(dx: float, dy: float) -> Affine:
    return (1.0, 0.0, 0.0, 1.0, dx, dy)


def scaling(sx: float, sy: float) -> Affine:
    return (sx, 0.0, 0.0, sy, 0.0, 0.0)


def rotation(angle: float) -> Affine:
    return (math.cos(angle), math.sin(angle), -math.sin(angle), math.cos(angle), 0.0, 0.0)


def about(cx=0.0, cy=0.0, angle=0.0, sx=1.0, sy=1.0, tx=0.0, ty=0.0) -> Affine:
    """Scale and turn about a pivot, then move."""
    out = translate(cx + tx, cy + ty)
    for m in (rotation(angle), scaling(sx, sy), translate(-cx, -cy)):
        out = multiply(out, m)
    return out


def invert(m: Affine) -> Affine | None:
    """None where the map is (nearly) singular."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    if abs(det) < 1e-12:
        return None
    return (d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)


def apply_to(m: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


# -- lookups and reductions ---------------------------------------------------------------


def palette_lookup(px: DataFrame, palette: DataFrame, index: str = "r", keys=()) -> DataFrame:
    """Colour of each pixel's palette entry, 0 where there is none; the planner broadcasts a palette of 256 rows."""
    p = palette.select(F.col("idx").alias(index), *[F.col(c).alias(f"p_{c}") for c in "rgb"])
    return px.join(p, index, "left").select(*keys, "x", "y", *[F.coalesce(f"p_{c}", F.lit(0)).alias(c) for c in "rgb"])


def _paired(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    o = b.select(*keys, "x", "y", *[F.col(c).alias(f"o_{c}") for c in CH])
    return a.join(o, [*keys, "x", "y"], "full").select(*keys, "x", "y", *[F.abs(F.coalesce(c, F.lit(0)) - F.coalesce(f"o_{c}", F.lit(0))).alias(c) for c in CH])


def max_difference(a: DataFrame, b: DataFrame, keys=()) -> DataFrame:
    """Largest difference of any channel; absent pixels are clear black."""
    return _paired(a, b, keys).groupBy(*keys).agg(F.max(F.greatest(*CH)).alias("max_diff"))


def mean_absolute_error(a: DataFrame, b: DataFrame, w: int, h: int, keys=()) -> DataFrame:
    """Mean over the first three quarters of the RGBA bytes, alpha among them."""
    at = (F.col("y").cast("long") * w + F.col("x")) * 4
    n = w * h * 3
    each = [F.when(at + k < n, F.col(c)).otherwise(0) for k, c in enumerate(CH)]
    return _paired(a, b, keys).groupBy(*keys).agg((F.sum(sum(each[1:], each[0])) / float(n)).alias("mae"))


def percent_different(a: DataFrame, b: DataFrame, w: int, h: int, limit: int = 24, keys=()) -> DataFrame:
    """Share of pixels whose channels differ by more than ``limit`` in sum."""
    return _paired(a, b, keys).groupBy(*keys).agg((F.sum((F.col("r") + F.col("g") + F.col("b") > limit).cast("int")) * 100.0 / float(w * h)).alias("percent"))
