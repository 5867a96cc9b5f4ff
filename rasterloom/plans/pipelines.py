"""Whole pipelines over the operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import adjust as A
from ..functions.dual import Steps, names
from ..operators import composite, geometry, region, sequential, shapes, stencil, text

CH = ("r", "g", "b", "a")
RGB = ("r", "g", "b")
FRAME = "doc_id"


def to_scan(px: DataFrame, w: int, h: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense scanlines of sparse pixels, band by band; absent pixels and rows are clear, pixels outside the frame are left out."""
    high = stencil.band_height(w, 0)
    lines = F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")
    every = px.select(*keys).distinct().select(*keys, lines) if keys else px.sparkSession.range(1).select(lines)
    mark = every.select(*keys, F.lit(-1).alias("x"), "y", *[F.lit(0).alias(c) for c in CH])
    inside = px.filter((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    rows = inside.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("x", "y", *CH)]).union(mark).withColumn("band", F.floor(F.col("y") / high))
    schema = ty.StructType([px.schema[k] for k in keys] + [ty.StructField("y", ty.IntegerType())] + [ty.StructField(c, ty.ArrayType(ty.IntegerType())) for c in CH])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * high
        n = min(high, h - first)
        table = table.filter(pc.greater_equal(table.column("x"), 0))
        at = (table.column("y").to_numpy() - first, table.column("x").to_numpy())
        data = [pa.repeat(k, n) for k in key[:-1]] + [pa.array(np.arange(first, first + n, dtype=np.int32))]
        for c in CH:
            plane = np.zeros((n, w), np.int32)
            plane[at] = pc.fill_null(table.column(c), 0).to_numpy()
            data.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(plane.ravel())))
        return pa.Table.from_arrays(data, names=schema.names)

    return rows.groupBy(*keys, "band").applyInArrow(run, schema)


def to_pixels(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pixel of scanlines."""
    flat = rows.select(*keys, "y", F.posexplode(F.arrays_zip(*CH)).alias("x", "v"))
    return flat.select(*keys, "x", "y", *[F.col(f"v.{c}").alias(c) for c in CH])


def demo(spark, w: int = 96, h: int = 64) -> DataFrame:
    """Gradient, a multiplied disc, a bucket fill, flatten, box blur: scanlines."""
    stops = [(0.0, (20, 40, 120, 255)), (1.0, (240, 200, 80, 255))]
    ground = shapes.linear_gradient(spark, w, h, 0, 0, w - 1, h - 1, stops).withColumn("z", F.lit(1))
    disc = shapes.fill_ellipse(spark, w / 2, h / 2, h / 3, h / 3, (200, 60, 60, 255)).withColumn("z", F.lit(2))
    flat = composite.flatten(ground.unionByName(disc), [composite.Layer(1), composite.Layer(2, "multiply")])
    filled = region.flood_fill(flat, w, h, 1, 1, 12, (255, 255, 255, 255))
    return stencil.box_blur(to_scan(filled, w, h), w, h, 2)


def flagship(layers: DataFrame, w: int, h: int) -> DataFrame:
    """Four layers in different modes, flattened and blurred: scanlines."""
    stack = [composite.Layer(1), composite.Layer(2, "multiply", 0.5), composite.Layer(3, "screen", 0.8), composite.Layer(4, "overlay")]
    return stencil.box_blur(to_scan(composite.flatten(layers, stack), w, h), w, h, 2)


def fit_inside(px: DataFrame, w: int, h: int, tw: int, th: int) -> DataFrame:
    """Centre crop to the target's shape, then a bilinear scale."""
    cw, ch = min(w, h * tw // th), min(h, w * th // tw)
    return geometry.scale_bilinear(geometry.crop_centre(px, w, h, cw, ch), cw, ch, tw, th)


#: How much of the backdrop's channels is kept; the subject's part of the canvas; its margins on a canvas 1280 wide.
DARKER = (0.45, 0.45, 0.5)
SUBJECT_HIGH, SUBJECT_SHAPE, SUBJECT_WIDE = 0.78, 1.15, 0.52
RIGHT, UP = 90, 20
#: Size of the caption, and its margins to the left and below.
CAPTION, CAPTION_LEFT, CAPTION_UP = 120, 60, 70


def _caption(spark, line: str, size: int, **look) -> DataFrame:
    return text.bitmap_text(spark.createDataFrame([(line,)], "text string"), size, **look)


def thumbnail(px: DataFrame, w: int, h: int, tw: int = 1280, th: int = 720, blur: int = 18, caption: str = "INSANE!") -> DataFrame:
    """A darkened, blurred backdrop of the whole frame with its tone-mapped, sharpened centre in front, to the right; darker below, with a caption."""
    wide = stencil.gaussian_blur(to_scan(geometry.scale_bilinear(px, w, h, tw, th), tw, th), tw, th, blur)
    back = to_pixels(wide).select("x", "y", *[F.rint(F.col(c) * k).cast("int").alias(c) for c, k in zip(RGB, DARKER)], "a")
    cw = min(w, math.floor(h * SUBJECT_HIGH))
    ch = min(h, math.floor(cw * SUBJECT_SHAPE))
    steps = Steps()
    tone = A.f_tone_map(steps, *names(*RGB))
    centre = geometry.crop_centre(px, w, h, cw, ch)
    toned = steps.spark(centre).select("x", "y", *[v.col.alias(k) for k, v in tone.items()], "a")
    sharp = to_pixels(stencil.unsharp_mask(to_scan(toned, cw, ch), cw, ch, 1.4, 1.5, 2))
    sw = math.floor(th * SUBJECT_WIDE)
    sh = math.floor(sw * ch / cw)
    subject = geometry.scale_bilinear(sharp, cw, ch, sw, sh)
    canvas = composite.over_gamma(back, subject, tw - sw - RIGHT * tw // 1280, (th - sh) // 2 - UP * tw // 1280)
    dark = A.f_dark_gradient(*names(*RGB, "y"), th, 0.55, 0.6)
    canvas = canvas.select("x", "y", *[dark[c].col.alias(c) for c in RGB], "a")
    line = _caption(px.sparkSession, caption, CAPTION)
    return composite.over_gamma(canvas, line, CAPTION_LEFT, th - text.text_size(caption, CAPTION)[1] - CAPTION_UP)


def _shrunk(line: str, size: int, step: int, least: int, widest: int) -> int:
    """The size at which a line fits, in steps, down to a least."""
    while text.text_size(line, size, *_tight(size))[0] > widest and size > least:
        size -= step
    return size


def _tight(size: int) -> tuple[float, int]:
    """Gap and margin of headline text."""
    return 0.12, math.ceil(size * 0.25)


def _headline(spark, line: str, size: int, **look) -> DataFrame:
    gap, pad = _tight(size)
    return _caption(spark, line, size, gap=gap, pad=pad, rim=max(2, math.ceil(size // 9 * 0.45)), **look)


def headline_thumbnail(food: DataFrame, fw: int, fh: int, man: DataFrame, mw: int, mh: int, title: str = "BEST FAST FOOD", sub: str = "IRAN!", tw: int = 1280, th: int = 720) -> DataFrame:
    """Two subjects cut out of green, each with a glow, on a flat gradient, with badges, an arrow and two lines of text.

    ``food`` stands at the lower left, ``man`` at the right, cut by the edge.
    Positions and sizes are those of a canvas 1280 by 720.
    """
    spark = food.sparkSession
    canvas = shapes.flat_gradient(spark, tw, th, (255, 40, 20), (255, 170, 0), 0)
    lay = lambda back, top, x, y, k=1.0: composite.over_gamma(back, top, x, y, k, True)

    def subject(px, w, h, share, color, radius, strength):
        high = math.floor(th * share + 0.5)
        wide = max(1, math.floor(high * w / h + 0.5))  # of a very high picture a column stays
        cut = geometry.scale_bilinear(region.chroma_key(px, w, h, (0, 255, 0), 100), w, h, wide, high)
        glow = to_pixels(stencil.glow_from_alpha(to_scan(cut, wide, high), wide, high, color, radius, strength))
        return cut, glow, wide, high

    cut, glow, _, high = subject(food, fw, fh, 0.72, (255, 200, 0), 12, 1.0)
    canvas = lay(lay(canvas, glow, -60, th - high + 90, 0.9), cut, -60, th - high + 90, 1.12)
    cut, glow, wide, high = subject(man, mw, mh, 0.74, (255, 240, 210), 10, 0.8)
    at = tw - math.floor(wide * 0.8 + 0.5), th - high + 60
    canvas = lay(lay(canvas, glow, *at, 0.5), cut, *at, 1.05)
    canvas = lay(canvas, shapes.draw_star(spark, tw, th, 120, 110, 56, (255, 210, 0), (0, 0, 0)), 0, 0)
    canvas = lay(canvas, shapes.draw_star(spark, tw, th, 250, 60, 30, (255, 255, 255), (0, 0, 0)), 0, 0)
    canvas = lay(canvas, shapes.draw_arrow(spark, tw, th, 380, 560, 300, 430, (230, 30, 30), (255, 255, 255), 26), 0, 0)
    size, small = _shrunk(title, 130, 8, 60, 1100), _shrunk(sub, 90, 6, 50, 1100)
    top = th - text.text_size(title, size, *_tight(size))[1] - 16
    canvas = lay(canvas, _headline(spark, title, size, color=(255, 255, 255), stroke=(0, 0, 0)), 50, top)
    return lay(canvas, _headline(spark, sub, small, color=(255, 60, 30), stroke=(255, 255, 255)), 50, top - text.text_size(sub, small, *_tight(small))[1] - 40)


# -- retouching -----------------------------------------------------------------


def _skin(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warm tones of middle brightness; fixed limits."""
    r, g, b = (v.astype(np.int64) for v in (r, g, b))
    light = 0.299 * r + 0.587 * g + 0.114 * b
    return (r > b + 8) & (g > b + 2) & (r > g + 2) & (light > 45) & (light < 245)


def _marked(rows: DataFrame, w: int, h: int, limit: float, soft: int, keys) -> DataFrame:
    """``rows`` with m, the skin as bytes (softened by ``soft``; 0: not at all), and spot, where skin departs from its blur."""
    local, smooth = stencil.gaussian_kernel(3), stencil.gaussian_kernel(soft) if soft else [1.0]
    reach = max(len(local), len(smooth)) // 2

    def f(src, at):
        skin = _skin(*(src[c] for c in RGB)) * 255.0
        m = stencil.blurred(stencil.inner(skin, reach - len(smooth) // 2), smooth)
        near = lambda a: stencil.inner(a, reach - len(local) // 2)
        gap = sum(np.abs(stencil.inner(src[c], reach) - stencil.blurred(near(src[c]), local)) for c in RGB)
        return {c: stencil.inner(src[c], reach) for c in CH} | {"m": m, "spot": (m >= 127.5) & (gap > limit)}

    return stencil.banded(rows, w, h, reach, f, keys, CH, (*CH, "m", "spot"))


def _healed(marked: DataFrame, w: int, h: int, radius: int) -> DataFrame:
    """(doc_id, y, channels, m): spots filled from around them."""
    px = to_pixels(marked, (FRAME,))
    holes = marked.select(FRAME, "y", F.posexplode("spot").alias("x", "s")).filter("s = 1").select(FRAME, "x", "y")
    rows = to_scan(sequential.inpaint(px, holes, w, h, radius), w, h, (FRAME,))
    return rows.join(marked.select(FRAME, "y", "m"), [FRAME, "y"])


def retouch(rows: DataFrame, w: int, h: int, threshold: float = 40, tone: float = 0.18, shade: float = 0.06, seed: int = 12345) -> DataFrame:
    """Portrait retouching of frames ``doc_id``: pixels.

    Softened skin mask; blemishes within it healed; tones smoothed where skin is;
    centre brightened and rim darkened; light sharpening; film grain.
    """
    keys = (FRAME,)
    healed = _healed(_marked(rows, w, h, threshold * 3, 5, keys), w, h, 7)
    wide, fine = stencil.gaussian_kernel(10), stencil.gaussian_kernel(1)
    reach, edge = len(wide) // 2 + len(fine) // 2, len(fine) // 2

    def f(src, at):
        near = lambda a: stencil.inner(a, reach - edge)
        m = (near(src["m"]) / 255.0).astype(np.float32).astype(float)
        x, y = np.arange(w)[None, :], near(at[:, None])
        dx, dy = (x - 0.5 * w) / (0.34 * w), (y - 0.45 * h) / (0.42 * h)
        d2 = dx * dx + dy * dy
        k = np.where(d2 <= 1, 1 + 0.12 * shade * (1 - d2), 1 - 0.10 * shade * np.minimum(1.0, (np.sqrt(d2) - 1) * 1.5))
        out = {"a": stencil.inner(src["a"], reach)}
        again = np.clip(y[:, 0], 0, h - 1) - y[0, 0]  # the next pass clamps what this one has made
        for c in RGB:
            own = near(src[c])
            toned = stencil.up(own + (stencil.blurred(src[c], wide) - own) * m * tone)
            lit = np.where(m < 0.4, toned, stencil.up(toned * k))[again]
            s, b = stencil.inner(lit, edge), stencil.blurred(lit, fine)
            out[c] = np.where(np.abs(s - b) < 3, s, stencil.cut(s + (s - b) * 0.3))
        return out

    sharp = stencil.banded(healed, w, h, reach, f, keys, (*CH, "m"))
    return sequential.grain(to_pixels(sharp, keys), w, h, 3, seed)


def auto_retouch(rows: DataFrame, w: int, h: int) -> DataFrame:
    """The one-step form, on frames ``doc_id``: a hard skin mask, healing, and a quarter of the way to a wide blur on skin; scanlines."""
    healed = _healed(_marked(rows, w, h, 90, 0, (FRAME,)), w, h, 6)
    wide = stencil.gaussian_kernel(10)
    r = len(wide) // 2

    def f(src, at):
        m = (stencil.inner(src["m"], r) > 0) * 0.25
        soft = lambda s, b: stencil.even(s + (b - s) * m)
        return {c: soft(stencil.inner(src[c], r), stencil.blurred(src[c], wide)) for c in RGB} | {"a": stencil.inner(src["a"], r)}

    return stencil.banded(healed, w, h, r, f, (FRAME,), (*CH, "m"))


# -- dispatch -------------------------------------------------------------------


def _points(f, **more):
    """A point filter of ``functions.adjust`` as a step on pixels; ``place``: it also takes x, y, w, h."""

    def run(px: DataFrame, w: int, h: int) -> DataFrame:
        place = (*names("x", "y"), w, h) if more.get("place") else ()
        values = f(*names(*RGB), *place)
        return px.select(FRAME, "x", "y", *[values[c].col.alias(c) for c in RGB], values["a"].col.alias("a") if "a" in values else "a")

    return run


def _lines(f):
    """A neighbourhood operator as a step on pixels."""
    return lambda px, w, h: to_pixels(f(to_scan(px, w, h, (FRAME,)), w, h), (FRAME,))


_K = {"keys": (FRAME,)}
_S_CURVE = [(64, 40), (128, 140), (192, 215)]
#: Every filter by name, with the settings it has there; each takes pixels (doc_id, x, y, r, g, b, a).
FILTERS = {
    "grayscale": _points(A.f_grayscale),
    "invert": _points(A.invert),
    "sepia": _points(A.f_sepia),
    "threshold": _points(A.f_threshold),
    "blur": _lines(lambda d, w, h: stencil.box_blur(d, w, h, 2, **_K)),
    "gaussian": _lines(lambda d, w, h: stencil.gaussian_blur(d, w, h, 6, **_K)),
    "unsharp": _lines(lambda d, w, h: stencil.unsharp_mask(d, w, h, 1.4, 2, 2, **_K)),
    "emboss": _lines(lambda d, w, h: stencil.emboss(d, w, h, 1.2, 135.0, **_K)),
    "sobel": _lines(lambda d, w, h: stencil.sobel_edge(d, w, h, False, 1.2, **_K)),
    "median": _lines(lambda d, w, h: stencil.median_filter(d, w, h, 1, **_K)),
    "pixelate": lambda px, w, h: geometry.pixelate(px, w, h, 10, (FRAME,)),
    "posterize": _points(lambda r, g, b: A.f_posterize(r, g, b, 4)),
    "cel": _lines(lambda d, w, h: stencil.cel_shade(d, w, h, 4, 1.2, **_K)),
    "kuwahara": _lines(lambda d, w, h: stencil.kuwahara(d, w, h, 3, **_K)),
    "bloom": _lines(lambda d, w, h: stencil.bloom(d, w, h, 12, 0.65, **_K)),
    "motion": _lines(lambda d, w, h: stencil.motion_blur(d, w, h, 24, 0.0, **_K)),
    "vignette": _points(lambda r, g, b, x, y, w, h: A.f_vignette(r, g, b, x, y, w, h, 0.75, 1.0), place=True),
    "thermal": _points(A.f_thermal),
    "vaporwave": _points(lambda r, g, b: A.f_vaporwave(r, g, b, 0.18)),
    "rain": lambda px, w, h: sequential.rain(px, w, h, 0.02, 42, 16),
    "grain": lambda px, w, h: sequential.grain(px, w, h, 16),
    "colorbal": _points(lambda r, g, b: A.f_color_balance(r, g, b, (0.0, 0.0, 0.0), (10.0, 0.0, -10.0), (0.0, 8.0, 0.0))),
    "gradmap": _points(lambda r, g, b: A.f_gradient_map(r, g, b, (20.0, 10.0, 40.0), (255.0, 200.0, 80.0))),
    "kaleido": lambda px, w, h: geometry.kaleidoscope(px, w, h, 8, keys=(FRAME,)),
    "curves": _points(lambda r, g, b: A.table(r, g, b, *[A.linear_table(_S_CURVE)] * 3)),
    "exposure+": _points(lambda r, g, b: A.f_exposure(r, g, b, 1.0)),
    "exposure-": _points(lambda r, g, b: A.f_exposure(r, g, b, -1.0)),
    "vibrance": _points(lambda r, g, b: A.f_vibrance(r, g, b, 0.4)),
    "desaturate": _points(A.f_grayscale),
    "autoretouch": lambda px, w, h: to_pixels(auto_retouch(to_scan(px, w, h, (FRAME,)), w, h), (FRAME,)),
    "freqsep": _lines(lambda d, w, h: stencil.frequency_layers(d, w, h, 8, **_K)["high"]),
    "smoothskin": _lines(lambda d, w, h: stencil.smooth_tones(d, w, h, 10, 0.7, **_K)),
}


def apply_filter(px: DataFrame, kind: str, w: int, h: int) -> DataFrame:
    """The filter ``kind`` on frames ``doc_id`` of dense pixels; an unknown name leaves them as they are.

    ``chroma`` keys out green; it works on one frame at a time. ``freqsep``
    gives its upper layer; the lower is ``stencil.frequency_blur``.
    """
    if kind == "chroma":
        return region.chroma_key(px, w, h, (0, 255, 0), 100)
    return FILTERS[kind](px, w, h) if kind in FILTERS else px


# -- layers ---------------------------------------------------------------------


def layer_split(px: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, x, y, r, g, b, a): one layer for each colour class (x, y, class)."""
    return px.join(classes, ["x", "y"]).select("class", "x", "y", *CH)


def layer_ground(split: DataFrame, w: int, h: int, radius: int = 3) -> DataFrame:
    """The background: the whole frame, with the pixels of classed layers filled from around them."""
    px = split.select(F.lit(0).cast("long").alias(FRAME), "x", "y", *CH)
    holes = split.filter(F.col("class") != "none").select(F.lit(0).cast("long").alias(FRAME), "x", "y")
    return sequential.inpaint(px, holes, w, h, radius).select("x", "y", *CH)


def layer_rebuild(split: DataFrame, w: int, h: int, radius: int = 3) -> DataFrame:
    """The classed layers laid over that background again: pixels."""
    over = split.filter(F.col("class") != "none").select("x", "y", *CH, F.lit(2).alias("z"))
    ground = layer_ground(split, w, h, radius).withColumn("z", F.lit(1))
    return composite.flatten(ground.unionByName(over), [composite.Layer(1), composite.Layer(2)])
