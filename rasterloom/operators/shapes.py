"""Gradients and shapes: pixels made from closed forms over a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import grid

Stops = list[tuple[float, tuple[int, int, int, int]]]
CH = ("r", "g", "b", "a")


def _up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def sample_gradient(stops: Stops, t: Column) -> dict[str, Column]:
    """Colour at ``t`` of sorted stops, halves up."""
    out = {}
    for k, c in enumerate(CH):
        v = F.when(t <= stops[0][0], stops[0][1][k])
        for (t0, c0), (t1, c1) in zip(stops, stops[1:]):
            v = v.when(t <= t1, _up((t - t0) / (t1 - t0) * (c1[k] - c0[k]) + c0[k]))
        out[c] = v.otherwise(stops[-1][1][k])
    return out


def linear_gradient(spark: SparkSession, w: int, h: int, x0, y0, x1, y1, stops: Stops) -> DataFrame:
    """Only within the box of the two points."""
    g = grid(spark, max(0, int(min(x0, x1))), max(0, int(min(y0, y1))), math.ceil(min(w, max(x0, x1) + 1)), math.ceil(min(h, max(y0, y1) + 1)))
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.lit(0.0) if n == 0 else ((F.col("x") - x0) * dx + (F.col("y") - y0) * dy) / float(n)
    return _colored(g.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))), stops)


def radial_gradient(spark: SparkSession, w: int, h: int, cx, cy, r, stops: Stops) -> DataFrame:
    g = grid(spark, max(0, math.floor(cx - r)), max(0, math.floor(cy - r)), min(w, math.ceil(cx + r)), min(h, math.ceil(cy + r)))
    dx, dy = F.col("x") - float(cx), F.col("y") - float(cy)
    return _colored(g.withColumn("t", F.sqrt(dx * dx + dy * dy) / float(r)).filter("t <= 1"), stops)


def _colored(g: DataFrame, stops: Stops) -> DataFrame:
    return g.withColumns(sample_gradient(stops, F.col("t"))).filter("a > 0").select("x", "y", *CH)


def flat_gradient(spark: SparkSession, w: int, h: int, low=(255, 70, 40), high=(255, 160, 0), angle=0) -> DataFrame:
    down, across = F.col("y") / float(h - 1), F.col("x") / float(w - 1)
    t = {0: down, 90: across}.get(angle, (across + down) / 2)
    one = lambda a, b: F.rint(F.lit(float(a)) + t * float(b - a)).cast("int")
    return grid(spark, 0, 0, w, h).select("x", "y", *[one(a, b).alias(c) for c, a, b in zip("rgb", low, high)], F.lit(255).alias("a"))


def _painted(g: DataFrame, color) -> DataFrame:
    return g.select("x", "y", *[F.lit(v).alias(c) for c, v in zip(CH, color)])


def _box(x0, y0, x1, y1) -> tuple[int, int, int, int]:
    return math.floor(min(x0, x1)), math.floor(min(y0, y1)), math.ceil(max(x0, x1)), math.ceil(max(y0, y1))


def fill_rect(spark: SparkSession, x0, y0, x1, y1, color) -> DataFrame:
    a, b, c, d = _box(x0, y0, x1, y1)
    return _painted(grid(spark, a, b, c + 1, d + 1), color)


def stroke_rect(spark: SparkSession, x0, y0, x1, y1, color, thickness=1) -> DataFrame:
    a, b, c, d = _box(x0, y0, x1, y1)
    t = max(1, int(thickness))
    edge = (F.col("x") - a < t) | (c - F.col("x") < t) | (F.col("y") - b < t) | (d - F.col("y") < t)
    return _painted(grid(spark, a, b, c + 1, d + 1).filter(edge), color)


def _ellipse(cx, cy, rx, ry) -> Column:
    u, v = (F.col("x") - float(cx)) / float(rx), (F.col("y") - float(cy)) / float(ry)
    return u * u + v * v


def fill_ellipse(spark: SparkSession, cx, cy, rx, ry, color) -> DataFrame:
    g = grid(spark, math.floor(cx - rx), math.floor(cy - ry), math.ceil(cx + rx) + 1, math.ceil(cy + ry) + 1)
    return _painted(g.filter(_ellipse(cx, cy, rx, ry) <= 1), color)


def stroke_ellipse(spark: SparkSession, cx, cy, rx, ry, color, thickness=1) -> DataFrame:
    t = max(1, int(thickness))
    g = grid(spark, math.floor(cx - rx), math.floor(cy - ry), math.ceil(cx + rx) + 1, math.ceil(cy + ry) + 1)
    ring = (_ellipse(cx, cy, rx + t, ry + t) <= 1) & (_ellipse(cx, cy, max(1, rx - t), max(1, ry - t)) >= 1)
    return _painted(g.filter(ring), color)


def draw_line(spark: SparkSession, x0: int, y0: int, x1: int, y1: int, color, thickness=1) -> DataFrame:
    """A Bresenham line in closed form: the minor coordinate follows from the major one; squares of the thickness on each point."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    # the minor coordinate advances once the exact line passes the middle between two pixels, not on a tie
    long, short, steep = (dx, dy, False) if dx >= dy else (dy, dx, True)
    i = F.col("id")
    minor = F.lit(0) if long == 0 else F.floor((i * (2 * short) + (long - 1)) / (2 * long))
    p = spark.range(long + 1).select(i.alias("u"), minor.cast("int").alias("v"))
    px, py = ("v", "u") if steep else ("u", "v")
    pts = p.select((F.col(px) * sx + x0).cast("int").alias("x"), (F.col(py) * sy + y0).cast("int").alias("y"))
    half = max(1, int(thickness)) // 2
    if half:
        k = F.sequence(F.lit(-half), F.lit(half))
        pts = pts.select("x", "y", F.explode(k).alias("ox")).select("x", "y", "ox", F.explode(k).alias("oy"))
        pts = pts.select((F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y")).distinct()
    return _painted(pts, color)


def star(cx, cy, radius, points=5) -> list[tuple[float, float]]:
    """Corners, outer and inner in turn, the first on top."""
    out = []
    for k in range(points * 2):
        r, ang = (radius if k % 2 == 0 else radius * 0.45), -math.pi / 2 + k * math.pi / points
        out.append((cx + math.cos(ang) * r, cy + math.sin(ang) * r))
    return out


def draw_star(spark: SparkSession, w: int, h: int, cx: int, cy: int, radius, color=(255, 210, 0), stroke=(0, 0, 0), points=5, reach=5.0) -> DataFrame:
    """Pixels inside the star; those within ``reach`` of an edge take the stroke colour."""
    ring = star(cx, cy, radius, points)
    box = radius + 8
    g = grid(spark, max(0, math.ceil(cx - box)), max(0, math.ceil(cy - box)), min(w, math.floor(cx + box) + 1), min(h, math.floor(cy + box) + 1))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    crossings, near = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (y - ay) * ((bx - ax) / ((by - ay) or 1e-300)) + ax)
        crossings = crossings + hit.cast("int")
        n = max(1e-6, (bx - ax) ** 2 + (by - ay) ** 2)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n))
        ex, ey = x - (t * (bx - ax) + ax), y - (t * (by - ay) + ay)
        near = near | (F.sqrt(ex * ex + ey * ey) <= reach)
    g = g.filter((crossings % 2 == 1) & (F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= box))
    return g.select("x", "y", *[F.when(near, s).otherwise(c).alias(k) for k, s, c in zip("rgb", stroke, color)], F.lit(255).alias("a"))


def draw_arrow(spark: SparkSession, w: int, h: int, x1, y1, x2, y2, color=(230, 30, 30), stroke=(255, 255, 255), thick=22) -> DataFrame:
    """Discs along a line with a rim, then a head; where dots overlap the last one drawn shows."""
    dist = max(1.0, math.hypot(x2 - x1, y2 - y1))
    ux, uy, half = (x2 - x1) / dist, (y2 - y1) / dist, thick / 2
    steps = lambda stop, by: max(0, math.floor(stop / by) + (1 if math.floor(stop / by) * by <= stop else 0))
    turns, rings = math.ceil(6.283 / 0.25), math.floor(half + 8) + 1
    body = spark.range(steps(dist, 1.5) * rings * turns).select(
        F.col("id").alias("seq"), (F.floor(F.col("id") / (rings * turns)) * 1.5).alias("t"), (F.floor(F.col("id") / turns) % rings).alias("r"), (F.col("id") % turns * 0.25).alias("a")
    )
    dot = lambda c, u, f, k: F.floor(c + u * F.col("t") + f("a") * F.col("r") * k + 0.5).cast("int")
    body = body.select("seq", dot(x1, ux, F.cos, 1.0).alias("x"), dot(y1, uy, F.sin, 1.0).alias("y"), (F.col("r") > half).alias("rim"))
    tip = thick * 2.6
    turns2, n = math.ceil(6.283 / 0.3), math.ceil(tip / 0.8)
    head = spark.range(n * turns2).select((F.col("id") + (1 << 40)).alias("seq"), (F.floor(F.col("id") / turns2) * 0.8).alias("t"), (F.col("id") % turns2 * 0.3).alias("a")).withColumn("r", tip - F.col("t"))
    head = head.select("seq", dot(x2, ux, F.cos, 0.34).alias("x"), dot(y2, uy, F.sin, 0.34).alias("y"), F.lit(False).alias("rim"))
    last = body.unionByName(head).filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < w) & (F.col("y") < h)).groupBy("x", "y").agg(F.max_by("rim", "seq").alias("rim"))
    return last.select("x", "y", *[F.when(F.col("rim"), s).otherwise(c).alias(k) for k, s, c in zip("rgb", stroke, color)], F.lit(255).alias("a"))
