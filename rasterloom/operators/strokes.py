"""Strokes: resampling a path, and folding many stamps into a frame in order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stencil import to_linear, to_srgb

CH = ("r", "g", "b", "a")


def stroke_points(path: DataFrame, spacing: float, keys: tuple[str, ...] = ("stroke",)) -> DataFrame:
    """(keys, n, x, y): points every ``spacing`` along the path (keys, seq, x, y).

    Arc length is a running sum over the stroke, of decimals, so that its error
    doesn't grow along a stroke; each segment then yields the points whose
    length falls inside it. The first point is always there.
    """
    by = Window.partitionBy(*keys).orderBy("seq")
    seg = path.select(*keys, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    seg = seg.withColumns({"px": F.lag("x").over(by), "py": F.lag("y").over(by)})
    seg = seg.withColumn("l", F.coalesce(F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))), F.lit(0.0)))
    seg = seg.withColumn("end", F.sum(F.col("l").cast("decimal(28,16)")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("double")).withColumn("start", F.col("end") - F.col("l"))
    first = seg.filter(F.col("px").isNull()).select(*keys, F.lit(0).cast("long").alias("n"), "x", "y")
    low = F.floor(F.col("start") / spacing) + 1
    high = F.floor((F.col("end") + 1e-6) / spacing)
    inner = seg.filter((F.col("l") > 0) & (high >= low)).withColumn("n", F.explode(F.sequence(low, high)))
    t = (F.col("n") * spacing - F.col("start")) / F.col("l")
    inner = inner.select(*keys, "n", (F.col("px") + (F.col("x") - F.col("px")) * t).alias("x"), (F.col("py") + (F.col("y") - F.col("py")) * t).alias("y"))
    return first.unionByName(inner)


def footprint(stamps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stamps (keys, seq, cx, cy, radius, ...) by the pixels in their box, with the distance ``d`` (1 at the rim)."""
    r = F.greatest(F.lit(1.0), F.col("radius"))
    box = lambda c: F.sequence(F.floor(F.col(c) - r - 1).cast("int"), F.ceil(F.col(c) + r + 1).cast("int"))
    rows = stamps.withColumn("x", F.explode(box("cx"))).withColumn("y", F.explode(box("cy")))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return rows.withColumn("d", F.sqrt(dx * dx + dy * dy) / r).filter("d <= 1")


def coverage(d: Column, hardness: Column, radius: Column) -> Column:
    aa = F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), radius))
    hard = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (d - (1 - aa)) / aa))
    soft = F.pow(1 - d, F.lit(1.6))
    return F.when(hardness >= 1, hard).when(hardness <= 0, soft).otherwise(hard * hardness + soft * (1 - hardness))


def _over(s: Column, v: Column) -> Column:
    """Bytes ``v`` over bytes ``s``, normal mode, each step rounded to bytes."""
    sa, ba = v["a"] / 255.0, s["a"] / 255.0
    ao = sa + ba * (1 - sa)
    lin = lambda c: to_linear(c / 255.0)
    mix = lambda c: F.when(s["a"] == 0, lin(v[c])).otherwise((sa * lin(v[c]) + (1 - sa) * ba * lin(s[c])) / ao)
    byte = lambda x: F.floor(to_srgb(x) * 255 + 0.5).cast("int")
    return F.struct(*[byte(mix(c)).alias(c) for c in "rgb"], F.floor(ao * 255 + 0.5).cast("int").alias("a"))


def apply_stamps(px: DataFrame, stamps: DataFrame, w: int, h: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Frame after brush stamps (keys, seq, cx, cy, radius, hardness, r, g, b, a, alpha), in order of seq.

    A pixel's stamps meet in one group and are folded there, rounded to bytes
    at each step; pixels are independent, so any number of strokes spreads.
    """
    f = footprint(stamps, keys).filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < w) & (F.col("y") < h))
    cov = coverage(F.col("d"), F.col("hardness"), F.col("radius"))
    f = f.withColumn("sa", F.floor(cov * (F.col("a") / 255.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("alpha"))) * 255 + 0.5).cast("int")).filter("sa > 0")
    lists = f.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct("seq", "r", "g", "b", F.col("sa").alias("a")))).alias("stamps"))
    joined = px.join(lists, [*keys, "x", "y"], "full")
    start = F.struct(*[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in CH])
    out = joined.withColumn("o", F.when(F.col("stamps").isNull(), start).otherwise(F.aggregate("stamps", start, _over)))
    return out.select(*keys, "x", "y", *[F.col(f"o.{c}").alias(c) for c in CH])


def dirty_rect(stamps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Box that a stroke's stamps touch."""
    lo = lambda c: F.greatest(F.lit(0), F.min(F.col(c) - F.col("radius")).cast("int"))
    span = lambda c: F.ceil(F.max(F.col(c) + F.col("radius")) - F.min(F.col(c) - F.col("radius"))).cast("int")
    return stamps.groupBy(*keys).agg(lo("cx").alias("x"), lo("cy").alias("y"), span("cx").alias("w"), span("cy").alias("h"))


# -- tools that read pixels they have just changed: one frame at a time, in scan order ----


def _cells(cx, cy, radius, hardness, w, h):
    r = max(1.0, radius)
    aa = min(1.0, 1 / r)
    for y in range(max(0, math.floor(cy - r - 1)), min(h - 1, math.ceil(cy + r + 1)) + 1):
        for x in range(max(0, math.floor(cx - r - 1)), min(w - 1, math.ceil(cx + r + 1)) + 1):
            d = math.hypot(x - cx, y - cy) / r
            if d <= 1:
                hard, soft = min(1.0, max(0.0, 1 - (d - (1 - aa)) / aa)), (1 - d) ** 1.6
                cov = hard if hardness >= 1 else soft if hardness <= 0 else hard * hardness + soft * (1 - hardness)
                if cov > 0:
                    yield x, y, cov


def _mean(img, x, y, middle: bool):
    near = [img[j, i] for j in range(max(0, y - 1), min(img.shape[0], y + 2)) for i in range(max(0, x - 1), min(img.shape[1], x + 2)) if (middle or (i, j) != (x, y)) and img[j, i, 3] > 0]
    return np.mean([p[:3] for p in near], axis=0) if near else None


def _up(v):
    return np.clip(np.floor(v + 0.5), 0, 255)


def blur_stamp(img: np.ndarray, s) -> None:
    for x, y, cov in _cells(s.cx, s.cy, s.radius, s.hardness, img.shape[1], img.shape[0]):
        if img[y, x, 3]:
            m = _mean(img, x, y, False)
            if m is not None:
                img[y, x, :3] = _up(img[y, x, :3] + (m - img[y, x, :3]) * cov)


def sharpen_stamp(img: np.ndarray, s) -> None:
    for x, y, cov in _cells(s.cx, s.cy, s.radius, s.hardness, img.shape[1], img.shape[0]):
        if img[y, x, 3]:
            img[y, x, :3] = _up(img[y, x, :3] + (img[y, x, :3] - _mean(img, x, y, True)) * (cov * s.strength))


def smudge_stamp(img: np.ndarray, s) -> None:
    snap = img.copy()
    for x, y, cov in _cells(s.cx, s.cy, s.radius, s.hardness, img.shape[1], img.shape[0]):
        sx, sy = int(x - s.pull_x), int(y - s.pull_y)
        inside = 0 <= sx < img.shape[1] and 0 <= sy < img.shape[0]
        src = snap[sy, sx] if inside else np.zeros(4)
        if src[3] == 0 or img[y, x, 3] == 0:
            if src[3] > 0:
                img[y, x] = [*src[:3], 255]
        else:
            img[y, x, :3] = _up(img[y, x, :3] + (src[:3] - img[y, x, :3]) * min(0.95, cov * s.strength))


TOOLS = {"blur": blur_stamp, "sharpen": sharpen_stamp, "smudge": smudge_stamp}


def frame_of(pdf: pd.DataFrame, w: int, h: int) -> np.ndarray:
    img = np.zeros((h, w, 4))
    img[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[list(CH)].to_numpy()
    return img


def pixels_of(img: np.ndarray, **keys) -> pd.DataFrame:
    h, w = img.shape[:2]
    out = pd.DataFrame({"x": np.tile(np.arange(w, dtype=np.int32), h), "y": np.repeat(np.arange(h, dtype=np.int32), w)})
    for k, c in enumerate(CH):
        out[c] = img[:, :, k].reshape(-1).astype(np.int32)
    for k, v in keys.items():
        out[k] = v
    return out


def apply_sequential(px: DataFrame, stamps: DataFrame, w: int, h: int) -> DataFrame:
    """Blur, sharpen and smudge stamps (doc_id, seq, tool, cx, cy, radius, hardness, strength, pull_x, pull_y), frame by frame."""

    def run(frame: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "x", "y", *CH])
        img = frame_of(frame, w, h)
        for s in todo.sort_values("seq").itertuples():
            TOOLS[s.tool](img, s)
        return pixels_of(img, doc_id=frame["doc_id"].iloc[0])

    return px.groupBy("doc_id").cogroup(stamps.groupBy("doc_id")).applyInPandas(run, "doc_id long, x int, y int, r int, g int, b int, a int")
