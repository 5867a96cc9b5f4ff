"""Selections, masks, polygons, region growing and the operators built on them.

A selection is a set of (keys, x, y). Growing a contiguous region is a
reachability question: bands of rows label their members on their own, and the
labels are joined over the borders by alternating star steps, as many rounds as
the logarithm of the number of bands, instead of one round for each pixel of a
region's diameter.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import grid
from .stencil import BAND, PIXELS

CH = ("r", "g", "b", "a")


def shared(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder the cluster shares and read again, so that loops keep no lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = (base or "file:/tmp/checkpoints").rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- rectangles --------------------------------------------------------------------


def norm_rect(x1: int, y1: int, x2: int, y2: int) -> tuple[int, int, int, int]:
    """Two corners, both inside, as x, y, w, h."""
    return min(x1, x2), min(y1, y2), abs(x2 - x1) + 1, abs(y2 - y1) + 1


def contains(rect, x, y) -> bool:
    return rect[0] <= x < rect[0] + rect[2] and rect[1] <= y < rect[1] + rect[3]


def intersect(a, b) -> tuple[int, int, int, int] | None:
    x, y = max(a[0], b[0]), max(a[1], b[1])
    x1, y1 = min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    return (x, y, x1 - x, y1 - y) if x1 > x and y1 > y else None


def _inside(rect) -> Column:
    x, y, w, h = rect
    return (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)


def rect_mask(px: DataFrame, rect, inverse: bool = False) -> DataFrame:
    return px.filter(~_inside(rect) if inverse else _inside(rect)).select("x", "y")


def ellipse_mask(px: DataFrame, cx, cy, rx, ry) -> DataFrame:
    rx, ry = max(0.01, abs(rx)), max(0.01, abs(ry))
    box = (F.col("x") >= math.floor(cx - rx)) & (F.col("x") <= math.ceil(cx + rx)) & (F.col("y") >= math.floor(cy - ry)) & (F.col("y") <= math.ceil(cy + ry))
    d = ((F.col("x") - cx) / rx) * ((F.col("x") - cx) / rx) + ((F.col("y") - cy) / ry) * ((F.col("y") - cy) / ry)
    return px.filter(box & (d <= 1)).select("x", "y")


def polygon_mask(spark: SparkSession, w: int, h: int, points: list[tuple[float, float]]) -> DataFrame:
    """Even-odd fill, scanlines through pixel centres, both ends of a span inside.

    Edges meet scanlines by their range of rows (an edge is a few numbers, a
    frame's height bounds the rows), crossings are sorted in their row and
    taken in pairs.
    """
    if len(points) < 3:
        return spark.createDataFrame([], "x int, y int")
    ring = [*points, points[0]] if points[0] != points[-1] else list(points)
    edges = spark.createDataFrame([(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, ring[1:])], "x1 double, y1 double, x2 double, y2 double")
    lo, hi = max(0, math.floor(min(p[1] for p in points))), min(h - 1, math.ceil(max(p[1] for p in points)))
    if lo > hi:
        return spark.createDataFrame([], "x int, y int")
    rows = edges.withColumn("y", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("ys", F.col("y") + 0.5)
    rows = rows.filter(((F.col("y1") <= F.col("ys")) & (F.col("y2") > F.col("ys"))) | ((F.col("y2") <= F.col("ys")) & (F.col("y1") > F.col("ys"))))
    cross = F.col("x1") + (F.col("ys") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    xs = rows.groupBy("y").agg(F.array_sort(F.collect_list(cross)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)), lambda k: F.struct(F.greatest(F.lit(0), F.ceil(F.get("xs", k * 2)).cast("int")).alias("a"), F.least(F.lit(w - 1), F.floor(F.get("xs", k * 2 + 1)).cast("int")).alias("b")))
    out = xs.filter(F.size("xs") >= 2).select("y", F.explode(spans).alias("s")).filter("s.a <= s.b")
    return out.select(F.explode(F.sequence("s.a", "s.b")).alias("x"), "y").distinct()


# -- using a selection -----------------------------------------------------------------


def fill(px: DataFrame, mask: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    """Selected pixels take the colour, those that were absent too."""
    m = mask.select("x", "y").distinct().withColumn("_m", F.lit(True))
    joined = px.join(m, ["x", "y"], "full")
    return joined.select("x", "y", *[F.when(F.col("_m"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip(CH, color)])


def clear(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Selected pixels become clear: absent."""
    return px.join(mask.select("x", "y"), ["x", "y"], "left_anti")


def invert_selection(spark: SparkSession, mask: DataFrame, w: int, h: int) -> DataFrame:
    return grid(spark, 0, 0, w, h).join(mask.select("x", "y"), ["x", "y"], "left_anti")


def bounds(mask: DataFrame) -> DataFrame:
    """One row: count and box of a selection."""
    return mask.agg(
        F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")
    )


def is_rectangle(mask: DataFrame) -> DataFrame:
    return bounds(mask).select((F.col("n") == F.col("w") * F.col("h")).cast("int").alias("rectangle"))


def outline(mask: DataFrame) -> DataFrame:
    """Members with a 4-neighbour outside the selection."""
    near = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    n = mask.select("x", "y").select(near.alias("p")).select("p.x", "p.y").groupBy("x", "y").agg(F.count("*").alias("k"))
    return mask.select("x", "y").join(n, ["x", "y"], "left").filter(F.coalesce("k", F.lit(0)) < 4).select("x", "y")


# -- regions ------------------------------------------------------------------------------


def _labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the links (u, v): hook and halve."""
    p = np.arange(n)
    while True:
        a, b = p[u], p[v]
        if (a == b).all():
            return p
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while (p[p] != p).any():
            p = p[p]


def _reach(cells: DataFrame, w: int) -> DataFrame:
    """(x, y, c): the least index y * w + x that 4-neighbour steps reach.

    A band of rows is solved in its own task; what remains are links between
    components on either side of a border, joined by alternating star steps.
    """
    high = max(1, min(BAND, PIXELS // max(1, w)))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        at = np.unique(table.column("y").to_numpy().astype(np.int64) * w + table.column("x").to_numpy())
        here = lambda want: np.minimum(np.searchsorted(at, want), len(at) - 1)
        right, down = here(at + 1), here(at + w)
        r = np.flatnonzero((at[right] == at + 1) & ((at + 1) % w != 0))
        d = np.flatnonzero(at[down] == at + w)
        label = _labels(np.concatenate((r, d)), np.concatenate((right[r], down[d])), len(at))
        return pa.table({"x": pa.array((at % w).astype(np.int32)), "y": pa.array((at // w).astype(np.int32)), "c": pa.array(at[label])})

    banded = cells.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.floor(F.col("y") / high).alias("band"))
    found = shared(banded.groupBy("band").applyInArrow(solve, "x int, y int, c long"), "bands")
    above = found.filter(F.pmod("y", F.lit(high)) == high - 1).select("x", (F.col("y") + 1).alias("y"), F.col("c").alias("v"))
    links = found.filter(F.pmod("y", F.lit(high)) == 0).select("x", "y", F.col("c").alias("u")).join(above, ["x", "y"]).select("u", "v").distinct()
    links = shared(links, "links")
    seen = None
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        links = shared(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    label = links.select(F.col("u").alias("c"), F.col("v").alias("root"))
    return found.join(label, "c", "left").select("x", "y", F.coalesce("root", "c").alias("c"))


def matching(px: DataFrame, seed: tuple[int, int, int, int], tol: float, match_alpha: bool = True) -> Column:
    """Squared distance to the seed colour within the tolerance."""
    d = sum(((F.col(c) - s) * (F.col(c) - s) for c, s in zip(CH if match_alpha else CH[:3], seed)), F.lit(0))
    return d <= tol * tol * (4 if match_alpha else 3)


def color_at(px: DataFrame, x: int, y: int) -> tuple[int, int, int, int]:
    r = px.filter((F.col("x") == x) & (F.col("y") == y)).select(*CH).first()
    return tuple(r) if r else (0, 0, 0, 0)


def region_grow(px: DataFrame, w: int, h: int, sx: int, sy: int, tol: float, match_alpha: bool = True, contiguous: bool = True) -> DataFrame:
    """Pixels like the seed's; contiguous: those that 4-neighbour steps reach from it, the seed always among them."""
    if not (0 <= sx < w and 0 <= sy < h):
        return px.limit(0).select("x", "y")
    cells = px.filter(matching(px, color_at(px, sx, sy), tol, match_alpha)).select("x", "y")
    if not contiguous:
        return cells
    cells = shared(cells.distinct(), "cells")
    found = shared(_reach(cells, w), "regions")
    own = found.filter((F.col("x") == sx) & (F.col("y") == sy)).select("c").first()
    return found.filter(F.col("c") == (own["c"] if own else -1)).select("x", "y")


def flood_fill(px, w, h, sx, sy, tol, color, match_alpha=True, contiguous=True) -> DataFrame:
    return fill(px, region_grow(px, w, h, sx, sy, tol, match_alpha, contiguous), color)


def magic_wand(px, w, h, sx, sy, tol) -> DataFrame:
    return region_grow(px, w, h, sx, sy, tol, match_alpha=False)


def magic_eraser(px, w, h, sx, sy, tol, contiguous=True) -> DataFrame:
    return clear(px, region_grow(px, w, h, sx, sy, tol, True, contiguous))


def chroma_key(px: DataFrame, w: int, h: int, key: tuple[int, int, int] = (0, 255, 0), tol: float = 90) -> DataFrame:
    """Background like the key that touches the border becomes clear; alpha is softened once, green spill reduced."""
    most = tol * math.sqrt(3)
    d2 = sum(((F.col(c) - k) * (F.col(c) - k) for c, k in zip("rgb", key)), F.lit(0))
    d = F.sqrt(d2.cast("double"))
    cells = shared(px.filter(d < most).select("x", "y"), "cells")
    label = shared(_reach(cells, w), "regions")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)
    back = label.join(label.filter(border).select("c").distinct(), "c", "left_semi").select("x", "y", F.lit(True).alias("back"))
    alpha = px.withColumn("d", d).join(back, ["x", "y"], "left")
    alpha = alpha.withColumn("al", F.when(F.col("back"), 0.0).otherwise(F.least(F.lit(1.0), F.col("d") / most)).cast("float").cast("double"))
    taps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("x") + i % 3 - 1).alias("x"), (F.col("y") + i // 3 - 1).alias("y"), F.lit(float(k)).alias("k"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("al").alias("own")) for i, k in enumerate((1, 2, 1, 2, 4, 2, 1, 2, 1))]))
    near = alpha.select(taps.alias("t")).select("t.*").join(alpha.select("x", "y", "al"), ["x", "y"], "left")
    soft = near.groupBy("tx", "ty").agg(F.array_sort(F.collect_list(F.struct("i", (F.coalesce("al", "own") * F.col("k")).alias("v")))).alias("t"))
    soft = soft.select(F.col("tx").alias("x"), F.col("ty").alias("y"), (F.aggregate("t", F.lit(0.0), lambda s, v: s + v["v"]) / 16.0).cast("float").cast("double").alias("f"))
    out = alpha.select("x", "y", "r", "g", "b").join(soft, ["x", "y"])
    spill = F.least(F.lit(1.0), (1 - F.col("f")) * 0.7)
    g = F.when((spill > 0) & (F.col("g") > F.col("r")) & (F.col("g") > F.col("b")), F.col("g") + ((F.col("r") + F.col("b")) / 2.0 - F.col("g")) * spill * 2).otherwise(F.col("g").cast("double"))
    g = F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), g))).cast("int")
    return out.select("x", "y", "r", g.alias("g"), "b", F.floor(F.col("f") * 255 + 0.5).cast("int").alias("a"))


