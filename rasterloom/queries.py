"""Every operator as a query over the raster views, with the checking engine's SQL beside it."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import adjust as A
from .functions import blend as B
from .functions import color as C
from .functions import stamps as ST
from .functions.dual import Steps, X, dbl, half_up, lit, name, names
from .operators import composite as K
from .operators import geometry as Y
from .operators import history as HI
from .operators import region as Z
from .operators import sequential as Q
from .operators import shapes as S
from .operators import stencil as T
from .operators import strokes as N
from .operators import text as TX
from .plans import pipelines as P
from .plans import views as V
from .sources import codecs as CO
from .sources import images as IM
from .sources import psd as PS
from .streaming import strokes as SM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[key] = query
    if sql is not None:
        SQL[key] = sql


def pointwise(key: str, values: dict[str, X], steps: Steps | None = None, keys: tuple[str, ...] = ("x", "y")) -> None:
    """A projection of the pixels."""
    steps = steps or Steps()
    shown = ", ".join([*keys, *[f"{v.duck} AS {k}" for k, v in values.items()]])
    register(
        key,
        lambda spark, sf: steps.spark(V.pixels(spark, sf)).select(*keys, *[v.col.alias(k) for k, v in values.items()]),
        f"SELECT {shown} FROM ({steps.duck(V.PIXELS)})",
    )


R, G, BL, XX, YY = names("r", "g", "b", "x", "y")
RGB = (R, G, BL)


# -- blend modes ---------------------------------------------------------------
# The pixel is the backdrop; its channels in another order are the source.
for _mode in B.MODES:
    _s = Steps()
    _v = B.over_bytes(_s, _mode, [R, G, BL, lit(255)], [BL, R, half_up((dbl(R) + dbl(G)) / 2.0), lit(200)], 0.8)
    pointwise(f"blend_{_mode}", _v, _s)
_s = Steps()
pointwise("blend_clear_backdrop", B.over_bytes(_s, "multiply", [R, G, BL, lit(0)], [BL, R, G, lit(128)]), _s)
_s = Steps()
pointwise("blend_clear_source", B.over_bytes(_s, "screen", [R, G, BL, lit(90)], [BL, R, G, lit(0)]), _s)
pointwise("blend_hash2", {"h": half_up(C.hash2(XX, YY) * 1000000.0)})

# -- scalar colour functions ---------------------------------------------------
_milli = lambda v: half_up(v * 100000.0)
pointwise("color_srgb_to_linear", {"v": _milli(C.to_linear(dbl(R) / 255.0))})
pointwise("color_linear_to_srgb", {"v": _milli(C.to_srgb(dbl(R) / 255.0))})
pointwise("color_linear_bytes", {k: C.to_byte(C.from_byte(v) * 0.5) for k, v in zip("rgb", RGB)})
pointwise("color_hex", {"hex": C.to_hex(*RGB)})
_s = Steps().let(hex=C.to_hex(*RGB))
pointwise("color_hex_to_rgb", C.from_hex(name("hex")), _s)
pointwise("color_hsl", {k: _milli(v) for k, v in C.rgb_to_hsl(*RGB).items()})
pointwise("color_hsv", {k: _milli(v) for k, v in C.rgb_to_hsv(*RGB).items()})
_s = Steps().let(**{f"h_{k}": v for k, v in C.rgb_to_hsl(*RGB).items()})
pointwise("color_hsl_to_rgb", C.hsl_to_rgb(*names("h_h", "h_s", "h_l")), _s)
pointwise("color_lerp", {k: C.lerp(v, w, 0.3) for k, v, w in zip("rgb", RGB, (G, BL, R))})
pointwise("color_u16", {"v": C.u8_to_u16(R), "w": C.u16_to_u8(C.u8_to_u16(R))})
pointwise("color_f32_to_u16", {"v": half_up(C.to_srgb(C.from_byte(R)) * 65535.0)})
pointwise("color_cmyk_to_rgb", C.cmyk_to_rgb(R, G, BL, lit(200)))
pointwise("color_rgb_to_cmyk", C.rgb_to_cmyk(*RGB))
_s = Steps()
pointwise("color_lab_to_rgb", C.lab_to_rgb(_s, R, G, BL), _s)
pointwise("color_f32_to_byte", {"v": C.f32_to_byte(dbl(R) / 200.0 - 0.1)})
pointwise("color_invert_planes", {k: 255 - v for k, v in zip("rgb", RGB)})
pointwise("color_expand_bit", {f"b{k}": C.bit_to_byte(R, k) for k in range(8)})
pointwise("tone_brightness", {"v": _milli(A.brightness_of(dbl(R) / 255.0, 0.3))})
pointwise("tone_gamma", {"v": _milli(A.gamma_of(dbl(R) / 255.0, 2.2))})
pointwise("tone_curve", {"v": _milli(A.curve_of(dbl(R) / 255.0, [(0.1, 0.0), (0.5, 0.7), (0.9, 1.0)]))})
pointwise("tone_hsl", {"v": _milli(A.hsl_of(dbl(R) / 255.0, 0.4, 1.5, 0.1))})

# -- adjustments and point filters ----------------------------------------------
for _key, (_f, _p) in A.ADJUSTMENTS.items():
    _s = Steps()
    pointwise(f"adj_{_key}", _f(*RGB, **_p, **({"steps": _s} if _key == "hue" else {})), _s)
pointwise("filter_grayscale", A.f_grayscale(*RGB))
pointwise("filter_invert", A.invert(*RGB))
pointwise("filter_brightness_contrast", A.f_brightness_contrast(*RGB, 0.1, 0.3))
pointwise("filter_threshold", A.f_threshold(*RGB))
pointwise("filter_sepia", A.f_sepia(*RGB))
pointwise("filter_posterize", A.f_posterize(*RGB, 5))
pointwise("filter_thermal", A.f_thermal(*RGB))
pointwise("filter_vaporwave", A.f_vaporwave(*RGB))
pointwise("filter_color_balance", A.f_color_balance(*RGB, (20.0, -10.0, 5.0), (-5.0, 10.0, 0.0), (0.0, 5.0, -15.0)))
pointwise("filter_gradient_map", A.f_gradient_map(*RGB))
pointwise("filter_exposure", A.f_exposure(*RGB, 0.6))
pointwise("filter_vibrance", A.f_vibrance(*RGB, 0.5))
pointwise("filter_curves_linear", A.table(*RGB, *[A.linear_table([(64, 30), (180, 220)])] * 3))
#: A frame of fixed height: rows beyond it take part, by the same formulas.
FRAME_H = 500
pointwise("filter_vignette", A.f_vignette(*RGB, XX, YY, 64, FRAME_H))
_s = Steps()
pointwise("filter_tone_map", A.f_tone_map(_s, *RGB), _s)
pointwise("filter_dark_gradient", A.f_dark_gradient(*RGB, YY, FRAME_H))
pointwise("filter_dodge_burn", A.f_dodge_burn(*RGB, XX, YY, 64, FRAME_H))
pointwise("filter_skin", {"skin": X(f"CAST({A.is_skin(*RGB).spark} AS INT)", f"CAST({A.is_skin(*RGB).duck} AS INT)")})
pointwise("filter_colour_class", {"class": A.colour_class(R, G, BL, YY)})

# -- composition ----------------------------------------------------------------
L = K.Layer


def stacked(key: str, stack: list[K.Layer], mask: bool = False, region: bool = False, clip=None, tiles=None) -> None:
    """A flatten of the line-item layers; masks and regions are layer 7 and layer 6 of the same view."""

    def run(spark, sf):
        px = V.layers(spark, sf)
        m = px.filter("z = 7").selectExpr("x", "y", "3 AS z", "a AS m") if mask else None
        v = px.filter("z = 6").selectExpr("x", "y", "2 AS z") if region else None
        return K.flatten(px, stack, masks=m, regions=v, clip=clip, tiles=tiles)

    where = "true"
    if clip:
        where = f"x >= {clip[0]} AND x < {clip[0] + clip[2]} AND y >= {clip[1]} AND y < {clip[1] + clip[3]}"
    if tiles is not None:
        where = "(" + " OR ".join(f"(x // 256 = {a} AND y // 256 = {b})" for a, b in tiles) + ")" if tiles else "false"
    m = f"SELECT x, y, 3 AS z, a AS m FROM ({V.LAYERS}) WHERE z = 7" if mask else None
    v = f"SELECT x, y, 2 AS z FROM ({V.LAYERS}) WHERE z = 6" if region else None
    register(key, run, K.flatten_sql(V.LAYERS, stack, m, v, where))


stacked("composite_normal", [L(1), L(2), L(3), L(4)])
stacked("composite_bench", [L(1), L(2, "multiply", 0.5), L(3, "screen", 0.8), L(4, "overlay")])
stacked("composite_nonseparable", [L(1), L(2, "hue"), L(3, "luminosity", 0.7), L(4, "color")])
stacked("composite_opacity", [L(1, opacity=0.6), L(2, visible=False), L(3, opacity=0.0), L(4, opacity=0.25)])
stacked("composite_group", [L(1), L(kind="group", opacity=0.5), L(2), L(kind="group", opacity=0.4), L(3), L(kind="end"), L(kind="end"), L(4)])
stacked("composite_hidden_group", [L(1), L(kind="group", visible=False), L(2), L(kind="end"), L(3)])
stacked("composite_adjustment", [L(1), L(2), L(kind="adjust", adjust="levels"), L(3, "multiply"), L(kind="adjust", adjust="hue")])
stacked("composite_offset", [L(1), L(2, ox=3, oy=-1), L(3, "lighten", ox=-2, oy=2)])
stacked("composite_clip_to_below", [L(1), L(2, clip=True), L(3, "screen", 0.5, clip=True)])
stacked("composite_mask", [L(1), L(2), L(3, "normal", 0.9, masked=True)], mask=True)
stacked("composite_vector_mask", [L(1), L(2, "multiply", vector_masked=True), L(3)], region=True)
stacked("composite_clip_region", [L(1), L(2, "difference")], clip=(10, 5, 60, 40))
stacked("composite_dirty_tiles", [L(1), L(2, "exclusion")], tiles=K.dirty_tiles(100, 10, 60, 20, 1, 5))
stacked("composite_merge_down", [L(4), L(5, "softLight", 0.7)])


# -- neighbourhoods ----------------------------------------------------------------
W = V.WIDTH
PX = f"px AS MATERIALIZED ({V.PIXELS}), hh AS (SELECT max(y) + 1 AS h FROM px)"
EVEN = lambda v: f"round_even(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {v})), 0)::INT"
CUT = lambda v: f"trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {v})))::INT"
UP = lambda v: f"least(255, greatest(0, floor({v} + 0.5::DOUBLE)::INT))"
SINGLE = lambda v: f"(({v})::FLOAT)::DOUBLE"


def _edge_sql(v: str, n: str, mode: str = "clamp") -> str:
    fold = lambda x, m: f"(CASE WHEN abs({x}) % (2 * ({m})) >= ({m}) THEN 2 * ({m}) - 1 - abs({x}) % (2 * ({m})) ELSE abs({x}) % (2 * ({m})) END)"
    t = f"((({v}) % (2 * ({n})) + 2 * ({n})) % (2 * ({n})))"
    return {
        "clamp": f"least({n} - 1, greatest(0, {v}))",
        "wrap": f"((({v}) % ({n}) + ({n})) % ({n}))",
        "mirror": f"(CASE WHEN {t} >= {n} THEN 2 * ({n}) - 1 - {t} ELSE {t} END)",
        "reflect": fold(f"({v})", n),
        "extend": f"({fold(f'(({v}) - 1)', f'{n} - 2')} + 1)",
    }[mode]


def _offsets(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {dx}, {dy}, {float(k)!r}::DOUBLE)" for i, (dx, dy, k) in enumerate(rows)) + ") AS o(i, dx, dy, k)"


def taps(src: str, rows: list[tuple], select: str, mode: str = "clamp") -> str:
    """For each pixel of ``src``, its neighbours s with tap o (i, k); grouped by the pixel. The taps are written first: then the join has plain keys."""
    every = f"SELECT p.x, p.y, o.i, o.k, {_edge_sql('p.x + o.dx', str(W), mode)} AS sx, {_edge_sql('p.y + o.dy', 'hh.h', mode)} AS sy FROM {src} p CROSS JOIN hh CROSS JOIN {_offsets(rows)}"
    return f"SELECT * FROM (WITH o AS MATERIALIZED ({every}) SELECT o.x, o.y, {select} FROM o JOIN {src} s ON s.x = o.sx AND s.y = o.sy GROUP BY o.x, o.y)"


def _line(kernel, down: bool) -> list[tuple]:
    r = len(kernel) // 2
    return [(0, i - r, k) if down else (i - r, 0, k) for i, k in enumerate(kernel)]


def two_pass(kernel, first, second, channels="rgba", src="px", out="blur") -> str:
    """CTEs ``{out}_h`` and ``{out}``."""
    sums = lambda f: ", ".join(f"{f(f's_{c}')} AS {c}" for c in channels)
    pass_ = lambda src, down, f: f"SELECT x, y, {sums(f)} FROM ({taps(src, _line(kernel, down), ', '.join(f'sum(o.k * s.{c}) AS s_{c}' for c in channels))})"
    return f"{out}_h AS MATERIALIZED ({pass_(src, False, first)}), {out} AS MATERIALIZED ({pass_(f'{out}_h', True, second)})"


def stencil(key: str, run, ctes: str, select: str, channels: str = "rgb") -> None:
    def query(spark, sf):
        h = V.height(spark, sf)
        return V.explode_scan(run(V.scan(spark, sf), W, h), ("y",), tuple(channels)).select("x", "y", *channels)

    register(key, query, f"WITH {PX}{', ' + ctes if ctes else ''} {select}")


def rgb(f, channels="rgb") -> str:
    return ", ".join(f"{f(c)} AS {c}" for c in channels)


_sharpen = [0, -1, 0, -1, 5, -1, 0, -1, 0]
_grid = lambda r, k=None: [(i % (2 * r + 1) - r, i // (2 * r + 1) - r, k[i] if k else 1) for i in range((2 * r + 1) ** 2)]
for _m in T.EDGES:
    stencil(
        f"stencil_convolve_{_m}",
        lambda d, w, h, m=_m: T.convolve(d, w, h, _sharpen, 3, m),
        "",
        taps("px", _grid(1, _sharpen), rgb(lambda c: CUT(f"sum(o.k * s.{c})")), _m),
    )
stencil("stencil_gaussian_blur", lambda d, w, h: T.gaussian_blur(d, w, h, 6), two_pass(T.gaussian_kernel(6), EVEN, EVEN), "SELECT x, y, r, g, b, a FROM blur", "rgba")
stencil("stencil_frequency_blur", lambda d, w, h: T.frequency_blur(d, w, h, 4), two_pass(T.frequency_kernel(4), SINGLE, EVEN), "SELECT x, y, r, g, b FROM blur")
_mean = lambda v: EVEN(f"{v} / 5")
stencil("stencil_box_blur", lambda d, w, h: T.box_blur(d, w, h, 2), two_pass([1.0] * 5, _mean, _mean, "rgb"), "SELECT x, y, r, g, b FROM blur")
_with = lambda f: f"SELECT p.x, p.y, {rgb(f)} FROM px p JOIN blur q USING (x, y)"
stencil(
    "stencil_unsharp_mask",
    lambda d, w, h: T.unsharp_mask(d, w, h, 1.2, 2, 3),
    two_pass(T.gaussian_kernel(2), EVEN, EVEN),
    _with(lambda c: f"CASE WHEN abs(p.{c} - q.{c}) < 3 THEN p.{c} ELSE {CUT(f'p.{c} + (p.{c} - q.{c}) * 1.2::DOUBLE')} END"),
)
stencil(
    "stencil_emboss",
    lambda d, w, h: T.emboss(d, w, h),
    "",
    taps("px", [(-1, -1, 1), (1, 1, -1)], rgb(lambda c: CUT(f"sum(o.k * s.{c} * 0.5::DOUBLE) * 1.5::DOUBLE + 128.0::DOUBLE"))),
)
_lum = "(s.r * 0.299::DOUBLE + s.g * 0.587::DOUBLE + s.b * 0.114::DOUBLE)"
_case = lambda k: "CASE o.i " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(k)) + " END"
SOBEL = f"sobel AS (SELECT x, y, least(255.0::DOUBLE, sqrt(gx * gx + gy * gy)) AS m FROM ({taps('px', _grid(1), f'sum({_lum} * {_case(T.SOBEL_X)}) AS gx, sum({_lum} * {_case(T.SOBEL_Y)}) AS gy')}))"
stencil("stencil_sobel", lambda d, w, h: T.sobel_edge(d, w, h), SOBEL, f"SELECT x, y, {rgb(lambda c: EVEN('m'))} FROM sobel")
stencil("stencil_sobel_inverted", lambda d, w, h: T.sobel_edge(d, w, h, True, 1.0), SOBEL, f"SELECT x, y, {rgb(lambda c: EVEN('255.0::DOUBLE - m'))} FROM sobel")
stencil("stencil_median", lambda d, w, h: T.median_filter(d, w, h, 1), "", taps("px", _grid(1), rgb(lambda c: f"list_sort(list(s.{c}))[5]")))
_post = lambda v: f"floor(floor({v} / 85.0::DOUBLE + 0.5::DOUBLE) * 85.0::DOUBLE + 0.5::DOUBLE)::INT"
stencil(
    "stencil_cel_shade",
    lambda d, w, h: T.cel_shade(d, w, h),
    SOBEL,
    f"SELECT p.x, p.y, {rgb(lambda c: f'CASE WHEN {EVEN(chr(109))} < 60 THEN {_post(f'p.{c}')} ELSE {24 if c == 'b' else 20} END')} FROM px p JOIN sobel USING (x, y)",
)



def _kuwahara_sql() -> str:
    means = ", ".join(f"avg(s.{c}) AS m{c}, sum(s.{c} * s.{c}) / 9.0::DOUBLE - (sum(s.{c}) / 9.0::DOUBLE) * (sum(s.{c}) / 9.0::DOUBLE) AS v{c}" for c in "rgb")
    return taps("px", _quads, f"o.k AS q, {means}").replace("GROUP BY o.x, o.y)", "GROUP BY o.x, o.y, o.k)")


_quads = [(ox + i % 3, oy + i // 3, q) for q, (ox, oy) in enumerate(((-2, -2), (0, -2), (-2, 0), (0, 0))) for i in range(9)]
stencil(
    "stencil_kuwahara",
    lambda d, w, h: T.kuwahara(d, w, h, 2),
    f"q AS (SELECT x, y, q, {', '.join(f'm{c}, v{c}' for c in 'rgb')} FROM ({_kuwahara_sql()}))",
    f"SELECT x, y, {rgb(lambda c: EVEN(f'm{c}'))} FROM q QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY vr + vg + vb, q) = 1",
)
_lin = lambda v: f"(CASE WHEN {v} <= 0.04045::DOUBLE THEN {v} / 12.92::DOUBLE ELSE power(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_srgb = lambda v: f"(CASE WHEN {v} >= 1 THEN 1.0::DOUBLE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * power({v}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END)"
stencil(
    "stencil_bloom",
    lambda d, w, h: T.bloom(d, w, h, 5, 0.7),
    two_pass(T.gaussian_kernel(5), EVEN, EVEN),
    f"SELECT x, y, {rgb(lambda c: CUT(f'{_srgb(c)} * 255.0::DOUBLE'))} FROM (SELECT p.x, p.y, {rgb(lambda c: f'least(1.0::DOUBLE, {_lin(f'(p.{c} / 255.0::DOUBLE)')} + {_lin(f'(q.{c} / 255.0::DOUBLE)')} * 0.7::DOUBLE)')} FROM px p JOIN blur q USING (x, y))",
)
_n = 9
_moves = [(math.floor((t / _n * 2 - 1) * _n * 0.5 * math.cos(0.5) + 0.5), math.floor((t / _n * 2 - 1) * _n * 0.5 * math.sin(0.5) + 0.5), 1) for t in range(_n)]
stencil("stencil_motion_blur", lambda d, w, h, n=_n: T.motion_blur(d, w, h, n, math.degrees(0.5)), "", taps("px", _moves, rgb(lambda c: EVEN(f"sum(s.{c}) / 9.0::DOUBLE"))))
_FREQ = two_pass(T.frequency_kernel(4), SINGLE, EVEN)
_HIGH = f"high AS (SELECT p.x, p.y, {rgb(lambda c: UP(f'(p.{c} - q.{c}) / 2.0::DOUBLE + 128.0::DOUBLE'))} FROM px p JOIN blur q USING (x, y))"
stencil("stencil_frequency_high", lambda d, w, h: T.frequency_separate(d, w, h, 4)["high"], f"{_FREQ}, {_HIGH}", "SELECT * FROM high")
stencil(
    "stencil_frequency_recon",
    lambda d, w, h: T.frequency_separate(d, w, h, 4)["recon"],
    f"{_FREQ}, {_HIGH}",
    f"SELECT q.x, q.y, {rgb(lambda c: f'least(255, greatest(0, q.{c} + 2 * (t.{c} - 128)))')} FROM blur q JOIN high t USING (x, y)",
)
stencil(
    "stencil_frequency_layer",
    lambda d, w, h: T.frequency_layers(d, w, h, 4)["high"],
    _FREQ,
    _with(lambda c: UP(f"{_srgb(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_lin(f"(p.{c} / 255.0::DOUBLE)")} - {_lin(f"(q.{c} / 255.0::DOUBLE)")}) / 2 + 0.5::DOUBLE))')} * 255.0::DOUBLE")),
)
stencil("stencil_smooth_tones", lambda d, w, h: T.smooth_tones(d, w, h, 4, 0.7), _FREQ, _with(lambda c: UP(f"p.{c} + (q.{c} - p.{c}) * 0.7::DOUBLE")))
_G3 = two_pass(T.gaussian_kernel(3), EVEN, EVEN)
_BLEM = "blem AS (SELECT p.x, p.y, (abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) > 60)::INT AS m FROM px p JOIN blur q USING (x, y))"
stencil("stencil_blemish_mask", lambda d, w, h: T.blemish_mask(d, w, h, 60), f"{_G3}, {_BLEM}", "SELECT x, y, m FROM blem", "m")
stencil(
    "stencil_masked_smooth",
    lambda d, w, h: T.masked_smooth(d, T.blemish_mask(d, w, h, 60), w, h, 4, 0.6),
    f"{_G3}, {_BLEM}, {two_pass(T.gaussian_kernel(4), EVEN, EVEN, out='soft')}",
    f"SELECT p.x, p.y, {rgb(lambda c: UP(f'p.{c} + (q.{c} - p.{c}) * m * 0.6::DOUBLE'))} FROM px p JOIN soft q USING (x, y) JOIN blem USING (x, y)",
)
# alpha for the next two: clear where the pixel is dark
_sil = lambda d: d.withColumn("a", F.transform("r", lambda v: F.when(v > 125, 255).otherwise(0)))
_SIL = "sil AS MATERIALIZED (SELECT x, y, CASE WHEN r > 125 THEN 255 ELSE 0 END AS a FROM px)"
stencil(
    "stencil_glow",
    lambda d, w, h: T.glow_from_alpha(_sil(d), w, h, radius=3),
    f"{_SIL}, unit AS MATERIALIZED (SELECT x, y, {SINGLE('a / 255.0::DOUBLE')} AS a FROM sil), {two_pass(T.glow_kernel(3), SINGLE, SINGLE, 'a', 'unit', 'glow')}",
    "SELECT x, y, CASE WHEN o > 0 THEN 255 ELSE 0 END AS r, CASE WHEN o > 0 THEN 210 ELSE 0 END AS g, 0 AS b, o AS a FROM (SELECT x, y, floor(least(1.0::DOUBLE, a * 1.4::DOUBLE) * 255.0::DOUBLE + 0.5::DOUBLE)::INT AS o FROM glow)",
    "rgba",
)


def _means(src: str, out: str) -> str:
    every = f"SELECT p.x, p.y, p.x + o.dx AS sx, p.y + o.dy AS sy FROM {src} p CROSS JOIN {_offsets(_grid(1))}"
    near = f"WITH o AS MATERIALIZED ({every}) SELECT o.x, o.y, sum(s.s) / count(*) AS m FROM o JOIN {src} s ON s.x = o.sx AND s.y = o.sy GROUP BY o.x, o.y"
    return f"{out} AS MATERIALIZED (SELECT x, y, {EVEN('m')} AS s FROM ({near}))"


stencil(
    "stencil_drop_shadow",
    lambda d, w, h: T.drop_shadow(_sil(d), w, h, 4, 3, 4),
    f"{_SIL}, s0 AS MATERIALIZED (SELECT d.x, d.y, coalesce(s.a, 0) AS s FROM sil d LEFT JOIN sil s ON s.x = d.x - 4 AND s.y = d.y - 3), {_means('s0', 's1')}, {_means('s1', 's2')}",
    "SELECT x, y, 0 AS r, 0 AS g, 0 AS b, CASE WHEN sil.a > 0 THEN 0 ELSE floor(least(255.0::DOUBLE, s * 0.55::DOUBLE) + 0.5::DOUBLE)::INT END AS a FROM s2 JOIN sil USING (x, y)",
    "rgba",
)


# -- geometry and lookups -------------------------------------------------------------
H5 = "500"
PXH = f"px AS MATERIALIZED ({V.PIXELS}), hh AS (SELECT max(y) + 1 AS h FROM px)"


def framed(key: str, run, sql: str | None) -> None:
    """``run(spark, pixels, w, h)``."""
    register(key, lambda spark, sf: run(spark, V.pixels(spark, sf), W, V.height(spark, sf)), f"WITH {PXH} {sql}" if sql else None)


framed(
    "geometry_pixelate",
    lambda s, p, w, h: Y.pixelate(p, w, h, 6),
    "SELECT p.x, p.y, s.r, s.g, s.b, s.a FROM px p CROSS JOIN hh JOIN px s ON s.x = least(63, p.x // 6 * 6 + 3) AND s.y = least(h - 1, p.y // 6 * 6 + 3)",
)
_ang = "((atan2(p.y - cy, p.x - cx) * 6) % (2 * pi()) + 2 * pi()) % (2 * pi())"
framed(
    "geometry_kaleidoscope",
    lambda s, p, w, h: Y.kaleidoscope(p, w, h, 6),
    f"SELECT q.x, q.y, s.r, s.g, s.b, s.a FROM (SELECT x, y, h, cx + cos(l) * d AS fx, cy + sin(l) * d AS fy FROM (SELECT x, y, h, cx, cy, d, CASE WHEN floor(ang / pi())::BIGINT % 2 = 0 THEN ang % pi() ELSE pi() - ang % pi() END / 6 AS l FROM (SELECT p.x, p.y, h, cx, cy, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) AS d, {_ang} AS ang FROM px p CROSS JOIN (SELECT h, 32.0::DOUBLE AS cx, h / 2.0::DOUBLE AS cy FROM hh)))) q "
    "JOIN px s ON s.x = least(63, greatest(0, floor(fx + 0.5::DOUBLE)::INT)) AND s.y = least(h - 1, greatest(0, floor(fy + 0.5::DOUBLE)::INT))",
)
_zt = "(t / 7.0::DOUBLE * 2 - 1)"
_zat = lambda c, mid, d, m: f"least({m} - 1, greatest(0, floor({mid} + (p.{c} - {mid}) * (1 + {_zt} * 0.05::DOUBLE) + {d!r}::DOUBLE * {_zt} * 7 * 0.5::DOUBLE + 0.5::DOUBLE)::INT))"
framed(
    "geometry_motion_zoom",
    lambda s, p, w, h: Y.motion_zoom(p, w, h, 7, 30.0, 0.05),
    f"SELECT p.x, p.y, {rgb(lambda c: f'round_even(sum(s.{c}) / 7.0::DOUBLE, 0)::INT', 'rgba')} FROM px p CROSS JOIN hh CROSS JOIN (SELECT unnest(range(7)) AS t) JOIN px s ON s.x = {_zat('x', '32.0::DOUBLE', math.cos(math.radians(30.0)), '64')} AND s.y = {_zat('y', '(h / 2.0::DOUBLE)', math.sin(math.radians(30.0)), 'h')} GROUP BY p.x, p.y",
)
_tgrid = "(SELECT unnest(range(40))::INT AS x) CROSS JOIN (SELECT unnest(range(70))::INT AS y)"
framed(
    "geometry_scale_nearest",
    lambda s, p, w, h: Y.scale_nearest(p, w, h, 40, 70),
    f"SELECT t.x, t.y, s.r, s.g, s.b, s.a FROM (SELECT * FROM {_tgrid}) t CROSS JOIN hh JOIN px s ON s.x = least(63, t.x * 64 // 40) AND s.y = least(h - 1, t.y * h // 70)",
)
framed(
    "geometry_scale_bilinear",
    lambda s, p, w, h: Y.scale_bilinear(p, w, h, 40, 70),
    f"SELECT t.x, t.y, {rgb(lambda c: EVEN(f'sum(s.{c} * (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END))'), 'rgba')} "
    f"FROM (SELECT x, y, h, x * 63 / 39.0::DOUBLE AS fx, y * (h - 1) / 69.0::DOUBLE AS fy FROM {_tgrid} CROSS JOIN hh) t CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS d(dx, dy) JOIN px s ON s.x = least(63, floor(fx)::INT + dx) AND s.y = least(h - 1, floor(fy)::INT + dy) GROUP BY t.x, t.y",
)
framed("geometry_crop", lambda s, p, w, h: Y.crop(p, 5, 20, 30, 40), "SELECT x - 5 AS x, y - 20 AS y, r, g, b, a FROM px WHERE x >= 5 AND x < 35 AND y >= 20 AND y < 60 AND a > 0")
framed("geometry_crop_centre", lambda s, p, w, h: Y.crop_centre(p, w, h, 20, 40), "SELECT x - 22 AS x, y - (h - 40) // 2 AS y, r, g, b, a FROM px CROSS JOIN hh WHERE x >= 22 AND x < 42 AND y >= (h - 40) // 2 AND y < (h - 40) // 2 + 40")
register("geometry_crop_document", lambda s, sf: Y.crop_document(V.layers(s, sf), 10, 5, 40, 20), f"SELECT z, x - 10 AS x, y - 5 AS y, r, g, b, a FROM ({V.LAYERS}) WHERE x >= 10 AND x < 50 AND y >= 5 AND y < 25 AND a > 0")
framed("geometry_move", lambda s, p, w, h: Y.move(p, 7, -3), "SELECT x + 7 AS x, y - 3 AS y, r, g, b, a FROM px")
_m = Y.about(32, 250, 0.3, 1.2, 0.9, 4, -6)
_i = Y.invert(_m)


def _affine(spark, p, w, h):
    u, v = Y.apply_to(_m, F.col("x"), F.col("y"))
    back = Y.apply_to(_i, F.col("u"), F.col("v"))
    k = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return p.select("x", "y", u.alias("u"), v.alias("v")).select("x", "y", k(F.col("u")).alias("u"), k(F.col("v")).alias("v"), k(back[0]).alias("bx"), k(back[1]).alias("by"))


_af = lambda m, x, y: (f"({x} * {m[0]!r}::DOUBLE + {y} * {m[2]!r}::DOUBLE + {m[4]!r}::DOUBLE)", f"({x} * {m[1]!r}::DOUBLE + {y} * {m[3]!r}::DOUBLE + {m[5]!r}::DOUBLE)")
_k = lambda v: f"floor({v} * 1000 + 0.5::DOUBLE)::BIGINT"
framed("geometry_affine", _affine, f"SELECT x, y, {_k('u')} AS u, {_k('v')} AS v, {_k(_af(_i, 'u', 'v')[0])} AS bx, {_k(_af(_i, 'u', 'v')[1])} AS by FROM (SELECT x, y, {_af(_m, 'x', 'y')[0]} AS u, {_af(_m, 'x', 'y')[1]} AS v FROM px)")
register(
    "lookup_palette",
    lambda s, sf: Y.palette_lookup(V.pixels(s, sf).withColumn("r", F.col("r") % 60), V.palette(s, sf)),
    f"SELECT p.x, p.y, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b FROM ({V.PIXELS}) p LEFT JOIN ({V.PALETTE}) q ON q.idx = p.r % 60",
)
_other = lambda p: p.withColumns({"r": F.col("g"), "g": F.col("r")}).filter("x > 2")
_PAIR = "d AS (SELECT coalesce(p.x, q.x) AS x, coalesce(p.y, q.y) AS y, abs(coalesce(p.r, 0) - coalesce(q.g, 0)) AS r, abs(coalesce(p.g, 0) - coalesce(q.r, 0)) AS g, abs(coalesce(p.b, 0) - coalesce(q.b, 0)) AS b, abs(coalesce(p.a, 0) - coalesce(q.a, 0)) AS a FROM px p LEFT JOIN (SELECT * FROM px WHERE x > 2) q ON p.x = q.x AND p.y = q.y)"
framed("reduce_max_difference", lambda s, p, w, h: Y.max_difference(p, _other(p)), f", {_PAIR} SELECT max(greatest(r, g, b, a)) AS max_diff FROM d")
framed(
    "reduce_mean_absolute_error",
    lambda s, p, w, h: Y.mean_absolute_error(p, _other(p), w, h).select(F.floor(F.col("mae") * 1000 + 0.5).cast("long").alias("mae")),
    f", {_PAIR} SELECT floor(sum((CASE WHEN ix < n THEN r ELSE 0 END) + (CASE WHEN ix + 1 < n THEN g ELSE 0 END) + (CASE WHEN ix + 2 < n THEN b ELSE 0 END) + (CASE WHEN ix + 3 < n THEN a ELSE 0 END)) / any_value(n)::DOUBLE * 1000 + 0.5::DOUBLE)::BIGINT AS mae FROM (SELECT *, (y * 64 + x) * 4 AS ix, 64 * h * 3 AS n FROM d CROSS JOIN hh)",
)
framed(
    "reduce_percent_different",
    lambda s, p, w, h: Y.percent_different(p, _other(p), w, h).select(F.floor(F.col("percent") * 1000 + 0.5).cast("long").alias("percent")),
    f", {_PAIR} SELECT floor(sum((r + g + b > 24)::INT) * 100.0::DOUBLE / (64 * any_value(h)) * 1000 + 0.5::DOUBLE)::BIGINT AS percent FROM d CROSS JOIN hh",
)

# -- selections -------------------------------------------------------------------------
_RECT = (8, 30, 25, 60)
_in = "x >= 8 AND x < 33 AND y >= 30 AND y < 90"
framed("select_rect", lambda s, p, w, h: Z.rect_mask(p, Z.norm_rect(32, 89, 8, 30)), f"SELECT x, y FROM px WHERE {_in}")
framed("select_rect_inverse", lambda s, p, w, h: Z.rect_mask(p, _RECT, True), f"SELECT x, y FROM px WHERE NOT ({_in})")
framed("select_ellipse", lambda s, p, w, h: Z.ellipse_mask(p, 30.5, 100, 20, 45), "SELECT x, y FROM px WHERE ((x - 30.5::DOUBLE) / 20) * ((x - 30.5::DOUBLE) / 20) + ((y - 100) / 45.0::DOUBLE) * ((y - 100) / 45.0::DOUBLE) <= 1 AND x BETWEEN 10 AND 51 AND y BETWEEN 55 AND 145")
_POLY = [(5.0, 10.0), (60.0, 40.5), (40.0, 120.0), (30.0, 60.0), (12.5, 110.0)]
_edges = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]]))
framed(
    "select_polygon",
    lambda s, p, w, h: Z.polygon_mask(s, w, h, _POLY),
    f", e AS (SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (VALUES {_edges}) AS v(x1, y1, x2, y2)), c AS (SELECT p.x, p.y, count(*) FILTER (WHERE cx <= p.x) AS n, count(*) FILTER (WHERE cx = p.x) AS t FROM px p JOIN (SELECT y, x1 + (y + 0.5::DOUBLE - y1) / (y2 - y1) * (x2 - x1) AS cx FROM (SELECT DISTINCT y FROM px), e WHERE (y1 <= y + 0.5::DOUBLE AND y2 > y + 0.5::DOUBLE) OR (y2 <= y + 0.5::DOUBLE AND y1 > y + 0.5::DOUBLE)) k USING (y) GROUP BY p.x, p.y) SELECT x, y FROM c WHERE n % 2 = 1 OR t > 0",
)
framed("select_invert", lambda s, p, w, h: Z.invert_selection(s, p.filter("r >= 120"), w, h), "SELECT x, y FROM px WHERE r < 120")
framed("select_bounds", lambda s, p, w, h: Z.bounds(p.filter("r > 180")), "SELECT count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px WHERE r > 180")
framed("select_is_rectangle", lambda s, p, w, h: Z.is_rectangle(Z.rect_mask(p, _RECT)), f"SELECT (count(*) = (max(x) - min(x) + 1) * (max(y) - min(y) + 1))::INT AS rectangle FROM px WHERE {_in}")
framed("select_outline", lambda s, p, w, h: Z.outline(p.filter("r >= 115")), ", m AS (SELECT x, y FROM px WHERE r >= 115) SELECT x, y FROM m WHERE (SELECT count(*) FROM m n WHERE abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4")
framed("select_fill", lambda s, p, w, h: Z.fill(p, Z.rect_mask(p, _RECT), (1, 2, 3, 200)), f"SELECT x, y, CASE WHEN {_in} THEN 1 ELSE r END AS r, CASE WHEN {_in} THEN 2 ELSE g END AS g, CASE WHEN {_in} THEN 3 ELSE b END AS b, CASE WHEN {_in} THEN 200 ELSE a END AS a FROM px")
framed("select_clear", lambda s, p, w, h: Z.clear(p, Z.rect_mask(p, _RECT)), f"SELECT x, y, r, g, b, a FROM px WHERE NOT ({_in})")
_SEED = "seed AS (SELECT r AS sr, g AS sg, b AS sb FROM px WHERE x = 32 AND y = 40)"
_near = lambda t, k: f"(r - sr) * (r - sr) + (g - sg) * (g - sg) + (b - sb) * (b - sb) <= {t * t * k}"
_MEMBER = lambda t, k: f"{_SEED}, m AS (SELECT x, y FROM px, seed WHERE {_near(t, k)})"
_GROW = "g AS (SELECT x, y FROM m WHERE x = 32 AND y = 40 UNION SELECT m.x, m.y FROM (SELECT x + unnest([1, -1, 0, 0]) AS x, y + unnest([0, 0, 1, -1]) AS y FROM g) n JOIN m USING (x, y))"


def region(key: str, run, ctes: str, select: str) -> None:
    register(key, lambda spark, sf: run(V.pixels(spark, sf), W, V.height(spark, sf)), f"WITH RECURSIVE {PXH}, {ctes} {select}")


region("region_grow", lambda p, w, h: Z.region_grow(p, w, h, 32, 40, 40), f"{_MEMBER(40, 4)}, {_GROW}", "SELECT x, y FROM g")
region("region_grow_everywhere", lambda p, w, h: Z.region_grow(p, w, h, 32, 40, 20, contiguous=False), _MEMBER(20, 4), "SELECT x, y FROM m")
region("region_magic_wand", lambda p, w, h: Z.magic_wand(p, w, h, 32, 40, 40), f"{_MEMBER(40, 3)}, {_GROW}", "SELECT x, y FROM g")
region("region_flood_fill", lambda p, w, h: Z.flood_fill(p, w, h, 32, 40, 40, (9, 8, 7, 255)), f"{_MEMBER(40, 4)}, {_GROW}", "SELECT px.x, px.y, CASE WHEN g.x IS NULL THEN r ELSE 9 END AS r, CASE WHEN g.x IS NULL THEN px.g ELSE 8 END AS g, CASE WHEN g.x IS NULL THEN b ELSE 7 END AS b, a FROM px LEFT JOIN g ON g.x = px.x AND g.y = px.y")
region("region_magic_eraser", lambda p, w, h: Z.magic_eraser(p, w, h, 32, 40, 40), f"{_MEMBER(40, 4)}, {_GROW}", "SELECT px.x, px.y, r, px.g AS g, b, a FROM px ANTI JOIN g ON g.x = px.x AND g.y = px.y")
_D = "sqrt(((r - 120) * (r - 120) + (g - 130) * (g - 130) + (b - 125) * (b - 125))::DOUBLE)"
_MOST = 25 * math.sqrt(3)
region(
    "region_chroma_key",
    lambda p, w, h: Z.chroma_key(p, w, h, (120, 130, 125), 25),
    f"m AS (SELECT x, y FROM px WHERE {_D} < {_MOST!r}::DOUBLE), g AS (SELECT m.x, m.y FROM m, hh WHERE x = 0 OR y = 0 OR x = 63 OR y = h - 1 UNION SELECT m.x, m.y FROM (SELECT x + unnest([1, -1, 0, 0]) AS x, y + unnest([0, 0, 1, -1]) AS y FROM g) n JOIN m USING (x, y)), "
    f"al AS MATERIALIZED (SELECT px.x, px.y, r, px.g AS gg, b, {SINGLE(f'CASE WHEN g.x IS NOT NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, sqrt(((r - 120) * (r - 120) + (px.g - 130) * (px.g - 130) + (b - 125) * (b - 125))::DOUBLE) / {_MOST!r}::DOUBLE) END')} AS al FROM px LEFT JOIN g ON g.x = px.x AND g.y = px.y), "
    f"so AS (SELECT p.x, p.y, {SINGLE('sum(coalesce(s.al, p.al) * o.k) / 16.0::DOUBLE')} AS f FROM al p CROSS JOIN {_offsets(_grid(1, [1, 2, 1, 2, 4, 2, 1, 2, 1]))} LEFT JOIN al s ON s.x = p.x + o.dx AND s.y = p.y + o.dy GROUP BY p.x, p.y), "
    "fin AS (SELECT x, y, r, gg, b, f, least(1.0::DOUBLE, (1 - f) * 0.7::DOUBLE) AS sp FROM al JOIN so USING (x, y))",
    f"SELECT x, y, r, {EVEN('CASE WHEN sp > 0 AND gg > r AND gg > b THEN gg + ((r + b) / 2.0::DOUBLE - gg) * sp * 2 ELSE gg END')} AS g, b, floor(f * 255 + 0.5::DOUBLE)::INT AS a FROM fin",
)

# -- gradients and shapes (made from nothing: the tables only supply a session) -----------
_STOPS = [(0.0, (10, 20, 30, 255)), (0.4, (200, 50, 90, 128)), (1.0, (0, 255, 100, 0))]


def _stop_sql(t: str) -> str:
    out = []
    for k, c in enumerate("rgba"):
        parts = [f"WHEN {t} <= {_STOPS[0][0]}::DOUBLE THEN {_STOPS[0][1][k]}"]
        parts += [f"WHEN {t} <= {t1}::DOUBLE THEN floor(({t} - {t0}::DOUBLE) / {t1 - t0!r}::DOUBLE * {c1[k] - c0[k]} + {c0[k]} + 0.5::DOUBLE)::INT" for (t0, c0), (t1, c1) in zip(_STOPS, _STOPS[1:])]
        out.append(f"CASE {' '.join(parts)} ELSE {_STOPS[-1][1][k]} END AS {c}")
    return ", ".join(out)


def _xy(x0, y0, x1, y1) -> str:
    return f"(SELECT x::INT AS x, y::INT AS y FROM (SELECT unnest(range({x0}, {x1})) AS x), (SELECT unnest(range({y0}, {y1})) AS y))"


def made(key: str, run, sql: str | None) -> None:
    register(key, lambda spark, sf: run(spark), sql)


_clamp01 = lambda t: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {t}))"
made("shape_linear_gradient", lambda s: S.linear_gradient(s, 100, 80, 10, 5, 70, 60, _STOPS), f"SELECT * FROM (SELECT x, y, {_stop_sql('t')} FROM (SELECT x, y, {_clamp01('((x - 10) * 60 + (y - 5) * 55) / 6625.0::DOUBLE')} AS t FROM {_xy(10, 5, 71, 61)})) WHERE a > 0")
made("shape_radial_gradient", lambda s: S.radial_gradient(s, 100, 80, 50, 40, 30, _STOPS), f"SELECT * FROM (SELECT x, y, {_stop_sql('t')} FROM (SELECT x, y, sqrt(((x - 50) * (x - 50) + (y - 40) * (y - 40))::DOUBLE) / 30.0::DOUBLE AS t FROM {_xy(20, 10, 80, 70)}) WHERE t <= 1) WHERE a > 0")
for _a, _t in ((0, "y / 49.0::DOUBLE"), (90, "x / 89.0::DOUBLE"), (45, "(x / 89.0::DOUBLE + y / 49.0::DOUBLE) / 2")):
    made(
        f"shape_flat_gradient_{_a}",
        lambda s, a=_a: S.flat_gradient(s, 90, 50, angle=a),
        f"SELECT x, y, {', '.join(f'round_even({a}.0::DOUBLE + ({_t}) * {b - a}, 0)::INT AS {c}' for c, a, b in zip('rgb', (255, 70, 40), (255, 160, 0)))}, 255 AS a FROM {_xy(0, 0, 90, 50)}",
    )
_one = "1 AS r, 2 AS g, 3 AS b, 255 AS a"
_col = (1, 2, 3, 255)
made("shape_fill_rect", lambda s: S.fill_rect(s, 10.5, 5, 3, 20.2, _col), f"SELECT x, y, {_one} FROM {_xy(3, 5, 12, 22)}")
made("shape_stroke_rect", lambda s: S.stroke_rect(s, 3, 5, 30, 20, _col, 2), f"SELECT x, y, {_one} FROM {_xy(3, 5, 31, 21)} WHERE x < 5 OR x > 28 OR y < 7 OR y > 18")
_ell = lambda rx, ry: f"(((x - 40) / {rx}.0::DOUBLE) * ((x - 40) / {rx}.0::DOUBLE) + ((y - 30) / {ry}.0::DOUBLE) * ((y - 30) / {ry}.0::DOUBLE))"
made("shape_fill_ellipse", lambda s: S.fill_ellipse(s, 40, 30, 20, 12, _col), f"SELECT x, y, {_one} FROM {_xy(20, 18, 61, 43)} WHERE {_ell(20, 12)} <= 1")
made("shape_stroke_ellipse", lambda s: S.stroke_ellipse(s, 40, 30, 20, 12, _col, 2), f"SELECT x, y, {_one} FROM {_xy(20, 18, 61, 43)} WHERE {_ell(22, 14)} <= 1 AND {_ell(18, 10)} >= 1")
for _n, (_x0, _y0, _x1, _y1) in {"flat": (3, 5, 40, 17), "steep": (20, 50, 9, 4), "diagonal": (0, 0, 12, 12)}.items():
    made(
        f"shape_line_{_n}",
        lambda s, p=(_x0, _y0, _x1, _y1): S.draw_line(s, *p, _col, 1),
        f"WITH RECURSIVE l AS (SELECT {_x0} AS x, {_y0} AS y, {abs(_x1 - _x0) - abs(_y1 - _y0)} AS e UNION ALL SELECT CASE WHEN 2 * e > {-abs(_y1 - _y0)} THEN x + {1 if _x0 < _x1 else -1} ELSE x END, CASE WHEN 2 * e < {abs(_x1 - _x0)} THEN y + {1 if _y0 < _y1 else -1} ELSE y END, e - CASE WHEN 2 * e > {-abs(_y1 - _y0)} THEN {abs(_y1 - _y0)} ELSE 0 END + CASE WHEN 2 * e < {abs(_x1 - _x0)} THEN {abs(_x1 - _x0)} ELSE 0 END FROM l WHERE NOT (x = {_x1} AND y = {_y1})) SELECT x, y, {_one} FROM l",
    )
made("shape_star", lambda s: S.draw_star(s, 100, 100, 50, 50, 40), None)
made("shape_arrow", lambda s: S.draw_arrow(s, 120, 120, 20, 20, 80, 70), None)

# -- stamps -------------------------------------------------------------------------------
PXA = [R, G, BL, name("a")]
_at = ST.Stamp(30.3, 60.7, 14, 0.6)


def stamped(key: str, f) -> None:
    steps = Steps()
    pointwise(key, f(steps), steps)


stamped("stamp_brush", lambda s: ST.brush(s, PXA, XX, YY, _at, (200, 30, 90, 255), 0.7))
stamped("stamp_brush_hard", lambda s: ST.brush(s, PXA, XX, YY, ST.Stamp(30, 60, 9, 1.0), (200, 30, 90, 180)))
stamped("stamp_brush_soft", lambda s: ST.brush(s, PXA, XX, YY, ST.Stamp(30, 60, 9, 0.0), (200, 30, 90, 255)))
stamped("stamp_square", lambda s: ST.brush(s, PXA, XX, YY, ST.Stamp(30.3, 60.7, 20, 0.5, True), (10, 230, 90, 255)))
stamped("stamp_pencil", lambda s: ST.pencil(s, PXA, XX, YY, _at, (0, 0, 255, 128)))
stamped("stamp_eraser", lambda s: ST.erase(s, PXA, XX, YY, _at, 0.9))
for _e, _r in ((0.5, "midtones"), (-0.6, "shadows"), (0.8, "highlights")):
    stamped(f"stamp_{'dodge' if _e > 0 else 'burn'}_{_r}", lambda s, e=_e, r=_r: ST.dodge_burn(s, PXA, XX, YY, _at, e, r))


def sourced(key: str, f) -> None:
    """Stamps that read another pixel: the frame joined with itself at an offset; absent is clear."""
    steps = Steps()
    values = f(steps, PXA, [name(f"s_{c}") for c in "rgba"])

    def run(spark, sf):
        px = V.pixels(spark, sf)
        src = px.select((F.col("x") - 9).alias("x"), (F.col("y") + 4).alias("y"), *[F.col(c).alias(f"s_{c}") for c in "rgba"])
        joined = px.join(src, ["x", "y"], "left").withColumns({f"s_{c}": F.coalesce(f"s_{c}", F.lit(0)) for c in "rgba"})
        return steps.spark(joined).select("x", "y", *[v.col.alias(k) for k, v in values.items()])

    src = f"SELECT p.*, {', '.join(f'coalesce(s.{c}, 0) AS s_{c}' for c in 'rgba')} FROM ({V.PIXELS}) p LEFT JOIN ({V.PIXELS}) s ON s.x = p.x + 9 AND s.y = p.y - 4"
    register(key, run, f"SELECT x, y, {', '.join(f'{v.duck} AS {k}' for k, v in values.items())} FROM ({steps.duck(src)})")


sourced("stamp_clone", lambda s, p, q: ST.clone(s, p, q, XX, YY, _at, 0.8))
sourced("stamp_heal", lambda s, p, q: ST.heal(s, p, q, XX, YY, _at, 0.9))
framed("stamp_pick_colour", lambda s, p, w, h: p.filter("x = 12 AND y = 34").select("r", "g", "b", "a"), "SELECT r, g, b, a FROM px WHERE x = 12 AND y = 34")


def _path(spark, sf):
    return V.strokes(spark, sf).filter("k >= 0").select((F.col("seq") % 97).alias("stroke"), "seq", "x", "y")


def _points(spark, sf):
    p = N.stroke_points(_path(spark, sf), 2.5)
    k = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return p.select("stroke", "n", k("x"), k("y"))


register(
    "stroke_points",
    _points,
    f"""WITH s AS (SELECT seq % 97 AS stroke, seq, x::DOUBLE AS x, y::DOUBLE AS y FROM ({V.STROKES})),
    g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY stroke ORDER BY seq)),
    l AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0::DOUBLE) AS l FROM g),
    e AS (SELECT *, sum(l) OVER (PARTITION BY stroke ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM l),
    n AS (SELECT *, unnest(range((floor((e - l) / 2.5::DOUBLE) + 1)::BIGINT, (floor((e + 1e-6::DOUBLE) / 2.5::DOUBLE) + 1)::BIGINT)) AS n FROM e WHERE l > 0),
    p AS (SELECT stroke, n, px + (x - px) * ((n * 2.5::DOUBLE - (e - l)) / l) AS x, py + (y - py) * ((n * 2.5::DOUBLE - (e - l)) / l) AS y FROM n
      UNION ALL SELECT stroke, 0, x, y FROM g WHERE px IS NULL)
    SELECT stroke, n, {_k('x')} AS x, {_k('y')} AS y FROM p""",
)


def _stamps(spark, sf):
    return V.strokes(spark, sf).filter("tool = 'click'").select("seq", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), (F.col("seq") % 4 + 2).cast("double").alias("radius"), F.lit(0.7).alias("hardness"), (F.col("seq") % 256).cast("int").alias("r"), F.lit(120).alias("g"), F.lit(40).alias("b"), F.lit(255).alias("a"), F.lit(0.5).alias("alpha"))


framed_stroke = lambda s, sf: N.apply_stamps(V.pixels(s, sf), _stamps(s, sf), W, V.height(s, sf))
register("stroke_brush", framed_stroke)
register("stroke_dirty_rect", lambda s, sf: N.dirty_rect(_stamps(s, sf).withColumn("stroke", F.col("seq") % 7), ("stroke",)), f"SELECT seq % 7 AS stroke, greatest(0, trunc(min(x - r))::INT) AS x, greatest(0, trunc(min(y - r))::INT) AS y, ceil(max(x + r) - min(x - r))::INT AS w, ceil(max(y + r) - min(y - r))::INT AS h FROM (SELECT seq, x::DOUBLE AS x, y::DOUBLE AS y, (seq % 4 + 2)::DOUBLE AS r FROM ({V.STROKES}) WHERE tool = 'click') GROUP BY 1")

# -- history ------------------------------------------------------------------------------
_KIND = "CASE tool WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'push' END"


def _log(spark, sf):
    return V.strokes(spark, sf).select(F.col("x").alias("doc"), "seq", F.expr(_KIND).alias("kind"), (F.col("y") % 8).alias("key"), F.col("k").alias("value"))


_HIST = f"""WITH RECURSIVE lg AS (SELECT x AS doc, seq, {_KIND} AS kind, y % 8 AS key, k AS value, row_number() OVER (PARTITION BY x ORDER BY seq) AS rn FROM ({V.STROKES})),
  f AS (SELECT DISTINCT doc, 0::BIGINT AS rn, []::BIGINT[] AS done, []::BIGINT[] AS redo FROM lg
  UNION ALL SELECT o.doc, o.rn,
    CASE WHEN kind = 'push' THEN list_append(done, seq)[greatest(1, len(done) - {HI.LIMIT - 2}):] WHEN kind = 'undo' AND len(done) > 0 THEN done[:len(done) - 1] WHEN kind = 'redo' AND len(redo) > 0 THEN list_append(done, redo[len(redo)]) ELSE done END,
    CASE WHEN kind = 'push' THEN []::BIGINT[] WHEN kind = 'undo' AND len(done) > 0 THEN list_append(redo, done[len(done)]) WHEN kind = 'redo' AND len(redo) > 0 THEN redo[:len(redo) - 1] ELSE redo END
    FROM f JOIN lg o ON o.doc = f.doc AND o.rn = f.rn + 1),
  last AS (SELECT doc, done, redo FROM f QUALIFY row_number() OVER (PARTITION BY doc ORDER BY rn DESC) = 1)"""
register(
    "history_in_force",
    lambda s, sf: HI.in_force(_log(s, sf)).select("doc", F.array_join("done", ",").alias("done"), F.array_join("redo", ",").alias("redo")),
    _HIST + " SELECT doc, array_to_string(done, ',') AS done, array_to_string(redo, ',') AS redo FROM last",
)
register(
    "history_state",
    lambda s, sf: HI.state(_log(s, sf), ("key",), "value"),
    _HIST + " SELECT lg.doc, key, arg_max(value, seq) AS value FROM lg JOIN (SELECT doc, unnest(done) AS seq FROM last) d USING (doc, seq) GROUP BY lg.doc, key",
)
register("history_tiles", lambda s, sf: HI.allocated_tiles(V.layers(s, sf), ("z",), 16), f"SELECT z, count(*) AS tiles, count(*) * 1024 AS bytes FROM (SELECT DISTINCT z, x // 16, y // 16 FROM ({V.LAYERS}) WHERE a > 0) GROUP BY z")
_small = f"SELECT DISTINCT z, 10 * z AS v FROM ({V.LAYERS})"
_zs = lambda s, sf: V.layers(s, sf).select("z", (F.col("z") * 10).alias("v")).distinct()
register("history_remove_layer", lambda s, sf: HI.remove_layer(_zs(s, sf), 3), f"SELECT CASE WHEN z > 3 THEN z - 1 ELSE z END AS z, v FROM ({_small}) WHERE z <> 3")
register("history_reorder_layer", lambda s, sf: HI.reorder_layer(_zs(s, sf), 2, 5), f"SELECT CASE WHEN z = 2 THEN 5 WHEN z BETWEEN 2 AND 5 THEN z - 1 ELSE z END AS z, v FROM ({_small})")


_labelled = lambda s, sf: _log(s, sf).withColumn("label", F.concat(F.lit("edit "), F.col("value")))
register(
    "history_labels",
    lambda s, sf: HI.labels(_labelled(s, sf)),
    _HIST + ", d AS (SELECT doc, unnest(done) AS seq, unnest(range(len(done))) AS n FROM last) SELECT doc, 0 AS depth, 'Open' AS label FROM last UNION ALL SELECT doc, (n + 1)::INT, 'edit ' || value FROM d JOIN lg USING (doc, seq)",
)


def _snapshots(spark, sf):
    """Two layers of each document after each push, and the document as it was opened."""
    log = _log(spark, sf)
    seqs = log.filter("kind = 'push'").select("doc", F.col("seq").cast("long").alias("seq")).unionByName(log.select("doc", F.lit(0).cast("long").alias("seq")).distinct())
    return seqs.select("doc", "seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("z")).withColumn("name", F.concat(F.lit("layer "), F.col("z") * F.col("seq")))


register(
    "history_restore",
    lambda s, sf: HI.restore(_log(s, sf), _snapshots(s, sf)),
    _HIST + " SELECT doc, seq, z, 'layer ' || (z * seq) AS name FROM (SELECT doc, CASE WHEN len(done) > 0 THEN done[len(done)] ELSE 0 END AS seq FROM last), (VALUES (1), (2)) AS v(z)",
)
register("history_capture", lambda s, sf: HI.restore_tiles(HI.capture_tiles(V.layers(s, sf), ("z",), 16), ("z",)), f"SELECT * FROM ({V.LAYERS}) WHERE a > 0")
framed(
    "history_written",
    lambda s, p, w, h: HI.written(p, p.filter("r < 90").withColumn("g", 255 - F.col("g")).withColumn("x", F.col("x") + 1)),
    ", c AS (SELECT x + 1 AS x, y, r, 255 - g AS g, b, a FROM px WHERE r < 90) SELECT p.x, p.y, p.r, p.g, p.b, p.a FROM px p LEFT JOIN c USING (x, y) WHERE c.r IS NULL UNION ALL SELECT * FROM c",
)
_META = "z, CASE z % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS name, 'paint' AS kind, z % 2 = 0 AS clip"
_meta = lambda s, sf: V.layers(s, sf).select("z").distinct().selectExpr(*_META.split(", "))
_META_SQL = f"(SELECT {_META} FROM (SELECT DISTINCT z FROM ({V.LAYERS})))"
register("history_rename_layer", lambda s, sf: HI.rename_layer(_meta(s, sf), 3, "sky"), f"SELECT z, CASE z WHEN 3 THEN 'sky' ELSE name END AS name, kind, clip FROM {_META_SQL}")
register("history_clip_layer", lambda s, sf: HI.toggle_layer(_meta(s, sf), 3, "clip"), f"SELECT z, name, kind, clip <> (z = 3) AS clip FROM {_META_SQL}")
register("history_duplicate_layer", lambda s, sf: HI.duplicate_layer(_meta(s, sf), 3), f"SELECT CASE WHEN z > 3 THEN z + 1 ELSE z END AS z, name, kind, clip FROM {_META_SQL} UNION ALL SELECT 4, name, kind, clip FROM {_META_SQL} WHERE z = 3")
register(
    "history_group_layer",
    lambda s, sf: HI.group_layer(_meta(s, sf), 3).withColumn("clip", F.coalesce("clip", F.lit(False))),
    f"SELECT CASE WHEN z > 3 THEN z + 2 WHEN z = 3 THEN 4 ELSE z END AS z, name, kind, clip FROM {_META_SQL} UNION ALL SELECT z, 'Group', k, false FROM (VALUES (3, 'group'), (5, 'end')) AS v(z, k)",
)
_TOOLS = [t for tools in SM.FAMILIES.values() for t in tools]
_events = lambda s, sf: V.strokes(s, sf).select(F.col("x").alias("doc"), "seq", F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("seq") % (len(_TOOLS) + 2)).cast("int") % len(_TOOLS) + 1).alias("tool"))
_FAMILY = "CASE " + " ".join(f"WHEN tool IN ({', '.join(repr(t) for t in tools)}) THEN '{f}'" for f, tools in SM.FAMILIES.items()) + " END"
register(
    "stroke_runs",
    lambda s, sf: SM.runs(_events(s, sf)),
    f"WITH e AS (SELECT x AS doc, seq, [{', '.join(repr(t) for t in _TOOLS)}][(seq % {len(_TOOLS) + 2})::INT % {len(_TOOLS)} + 1] AS tool FROM ({V.STROKES})), f AS (SELECT doc, seq, {_FAMILY} AS family FROM e), "
    "g AS (SELECT *, CASE WHEN lag(family) OVER (PARTITION BY doc ORDER BY seq) = family THEN 0 ELSE 1 END AS cut FROM f), h AS (SELECT *, sum(cut) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM g) "
    "SELECT doc, run::BIGINT AS run, family, min(seq) AS first, max(seq) AS last, count(*) AS n FROM h GROUP BY doc, run, family",
)


def _over_gamma(opaque: bool, k: float):
    def run(spark, p, w, h):
        return K.over_gamma(p, p.filter("x < 20 AND y < 30").withColumn("a", F.col("g")), 10, 5, k, opaque)

    f = lambda c: f"CASE WHEN t.a IS NULL THEN p.{c} ELSE {EVEN(f't.{c} * {k}::DOUBLE * (t.a / 255.0::DOUBLE) + p.{c} * (1 - t.a / 255.0::DOUBLE)')} END"
    a = "CASE WHEN t.a IS NULL THEN p.a ELSE 255 END" if opaque else "p.a"
    return run, f"SELECT p.x, p.y, {rgb(f)}, {a} AS a FROM px p LEFT JOIN (SELECT x + 10 AS x, y + 5 AS y, r, g, b, g AS a FROM px WHERE x < 20 AND y < 30 AND g > 0) t ON t.x = p.x AND t.y = p.y"


framed("composite_over_gamma", *_over_gamma(False, 1.0))
framed("composite_over_gamma_bright", *_over_gamma(True, 1.3))


# -- codecs: what comes back is what went in; a frame too high for one file is several strips --
def _placed(px: DataFrame) -> DataFrame:
    """Pixels of strips at their place in the frame; the path of a strip is its first row."""
    return px.withColumn("y", F.col("y") + F.col("path").cast("int")).drop("path")


def _round_trip(kind: str):
    def run(spark, p, w, h):
        files = IM.encode_strips(p.withColumn("doc_id", F.lit(0).cast("long")), kind, w, h).select(F.col("top").cast("string").alias("path"), "content")
        return _placed(IM.to_pixels(IM.decode(files)))

    return run


for _kind in CO.DECODERS:
    framed(f"codec_{_kind}", _round_trip(_kind), "SELECT x, y, r, g, b, a FROM px")


framed("codec_jpeg", _round_trip("jpeg"), None)


def _sniffed(spark, p, w, h):
    whole = p.withColumn("doc_id", F.lit(0).cast("long"))
    files = [IM.encode_strips(whole, k, w, h).select(F.lit(k).alias("kind"), "content") for k in CO.ENCODERS]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out.select("kind", IM.sniff(F.col("content")).alias("format")).distinct()


framed("codec_sniff", _sniffed, "SELECT k AS kind, k AS format FROM (VALUES " + ", ".join(f"('{k}')" for k in CO.ENCODERS) + ") AS v(k)")


# -- layered documents: images to a document, read again, flattened by what the document says --------
_DOC = [L(1, opacity=0.8), L(2, "multiply", 0.6), L(3, "screen", 0.8), L(4, "hardLight", 0.2)]


def _read_flat(docs: DataFrame, canvas: tuple[int, int] | None = None) -> DataFrame:
    """The layers of one document, flattened as its records say; only the records, without pixels, come to the driver.

    The document is (top, content): one file, or one for each strip, whose records are the same.
    """
    docs = Z.shared(docs.select(F.col("top").cast("string").alias("path"), "content"), "documents")
    rows = PS.read_layers(docs)
    heads = PS.read_layers(docs.filter("path = '0'")).withColumn("mask", F.expr("CASE WHEN mask IS NOT NULL THEN x'' END")).drop("data").orderBy("z").collect()
    regions = _placed(PS.vector_regions(rows, *canvas)) if canvas else None
    return K.flatten(_placed(PS.layer_pixels(rows)), PS.stack(heads), regions=regions)


def _from_stack(spark, sf):
    px = V.layers(spark, sf).filter("z <= 4")
    h = int(px.agg(F.max("y")).first()[0]) + 1
    look = F.create_map(*[F.lit(v) for k in _DOC for v in (k.z, f"{k.mode}:{k.opacity}")])[F.col("z")]
    files = IM.encode_strips(px, "png", 128, h, "z").select("top", "z", F.concat(F.lit("layer "), "z").alias("name"), F.split(look, ":")[0].alias("mode"), F.split(look, ":")[1].cast("double").alias("opacity"), "content")
    return PS.from_images(files, "top")


register("pipeline_layered_file", lambda s, sf: _read_flat(_from_stack(s, sf)), K.flatten_sql(V.LAYERS, _DOC))
_BOX = (4, 3, 40, 90)
#: What stands over the frame in the document: a group at 0.6 with a masked, darkened copy of the frame, and two adjustments.
_OVER = [
    PS.Record("group", "group", opacity=0.6),
    PS.Record("copy", mode="difference", box=_BOX, style={"drop_shadow": {"distance": 8.0, "angle": 90.0, "opacity": 0.5}, "stroke": {"size": 3.0}}),
    PS.Record("close", "end"),
    PS.Record("tone", "adjust", adjust="levels", params={"shadows": 20, "highlights": 230, "gamma": 1.2}),
    PS.Record("negative", "adjust", adjust="invert"),
]


def _box_at(box: tuple[int, int, int, int], top: int, h: int) -> tuple[int, int, int, int]:
    """A box as the strip of h rows from ``top`` holds it: one that misses the strip lies just outside."""
    y = min(max(box[1] - top, -2), h + 1)
    return box[0], y, box[2], min(max(box[3] - top, y + 1), h + 2)


def _with_blocks(px: DataFrame, w: int, h: int) -> DataFrame:
    """(top, content): the frame as a document of records of every kind."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, n, rgba = CO.decode(bytes(pdf["content"].iloc[0]))
        top = int(pdf["top"].iloc[0])
        own = lambda r: PS.replace(r, w=w, h=n, rgba=rgba, box=r.box and _box_at(r.box, top, n))
        filled = [own(r) if r.kind == "paint" else r for r in [PS.Record("frame"), *_OVER]]
        return pd.DataFrame({"top": [top], "content": [PS.encode(w, n, filled)]})

    files = IM.encode_strips(px.withColumn("doc_id", F.lit(0).cast("long")), "png", w, h)
    return files.groupBy("top").applyInPandas(run, "top int, content binary")


_BLOCKS = [L(0), L(1, kind="group", opacity=0.6), L(2, "difference", vector_masked=True), L(3, kind="end"), L(4, kind="adjust", adjust="levels", params=_OVER[3].params), L(5, kind="adjust", adjust="invert")]
framed(
    "codec_layered_blocks",
    lambda s, p, w, h: _read_flat(_with_blocks(p, w, h), (w, h)),
    ", fl AS (" + K.flatten_sql("SELECT *, 0 AS z FROM px UNION ALL SELECT *, 2 AS z FROM px", _BLOCKS, regions=f"SELECT x, y, 2 AS z FROM px WHERE x >= {_BOX[0]} AND x < {_BOX[2]} AND y >= {_BOX[1]} AND y < {_BOX[3]}") + ") SELECT x, y, r, g, b, a FROM fl",
)


def _styles(spark, p, w, h):
    """Layer styles as variants."""
    rows = PS.read_layers(_with_blocks(p, w, h).select(F.col("top").cast("string").alias("path"), "content"))
    got = rows.filter("style IS NOT NULL").select("z", "name", F.parse_json("style").alias("v"))
    part = lambda path, kind: F.variant_get("v", path, kind)
    out = got.select("z", "name", part("$.drop_shadow.distance", "double").alias("distance"), part("$.drop_shadow.blur", "double").alias("blur"), part("$.drop_shadow.mode", "string").alias("mode"), part("$.stroke.size", "double").alias("size"), part("$.stroke.position", "string").alias("position"))
    return out.distinct()  # the strips of a document have the same


framed("codec_layer_styles", _styles, ", one AS (SELECT 1 AS k) SELECT 2 AS z, 'copy' AS name, 8.0::DOUBLE AS distance, 0.0::DOUBLE AS blur, 'multiply' AS mode, 3.0::DOUBLE AS size, 'outside' AS position FROM one")


def _bytes(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _packed(shortest: int):
    def query(spark, sf):
        def run(text: pd.Series) -> pd.Series:
            raw = [t.encode() for t in text]
            return pd.Series([len(b) if CO.unpack_bits(CO.pack_bits(b, shortest)) == b else -1 for b in raw])

        return _bytes(spark, sf).select("doc_id", F.pandas_udf(run, "long")("text").alias("n_bytes"))

    return query


for _n in (2, 3):
    register(f"codec_pack_bits_{_n}", _packed(_n), "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents")
#: One step of the checksum for a byte, eight bits at a time, from a table of 256 remainders.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END, i::BIGINT))"
register(
    "codec_crc32",
    lambda s, sf: _bytes(s, sf).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc")),
    f"WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t), b AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents) "
    "SELECT doc_id, xor(list_reduce(b, lambda v, x: xor(t[xor(v, x) % 256 + 1], v // 256), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b, t",
)
_row = lambda: Window.partitionBy("y").orderBy("x")
_delta = lambda p: p.select("x", "y", F.pmod(F.col("r") - F.coalesce(F.lag("r").over(_row()), F.lit(0)), F.lit(256)).cast("int").alias("d"))
framed("codec_delta", lambda s, p, w, h: _delta(p), "SELECT x, y, ((r - coalesce(lag(r) OVER (PARTITION BY y ORDER BY x), 0)) % 256 + 256) % 256 AS d FROM px")
framed("codec_undelta", lambda s, p, w, h: _delta(p).select("x", "y", F.pmod(F.sum("d").over(_row().rowsBetween(Window.unboundedPreceding, 0)), F.lit(256)).cast("int").alias("r")), "SELECT x, y, r FROM px")

# -- text ---------------------------------------------------------------------------------
register("text_lines", lambda s, sf: _bytes(s, sf).select("doc_id", F.posexplode(TX.layout_lines(F.col("text"), F.lit(300.0), F.lit(6.0))).alias("n", "line")))
register(
    "text_spec",
    lambda s, sf: TX.clamp_spec(V.strokes(s, sf).select("seq", F.col("y").cast("double").alias("size"), (F.col("x") / 10.0).alias("line_height"), (F.col("k") * 100.0).alias("stroke_width"), F.lit(0.0).alias("letter_spacing"), F.col("tool").alias("align")))
    .select("seq", F.floor(F.col("size")).cast("int").alias("size"), F.floor(F.col("line_height") * 100 + 0.5).cast("int").alias("line_height"), F.floor("stroke_width").cast("int").alias("stroke_width"), "align"),
    f"SELECT seq, floor(least(4000, greatest(4, CASE WHEN y = 0 THEN 64 ELSE y END)))::INT AS size, floor(least(4.0::DOUBLE, greatest(0.5::DOUBLE, CASE WHEN x = 0 THEN 1.25::DOUBLE ELSE x / 10.0::DOUBLE END)) * 100 + 0.5::DOUBLE)::INT AS line_height, floor(least(200, greatest(0, k * 100)))::INT AS stroke_width, 'left' AS align FROM ({V.STROKES})",
)

_CELL, _GAP, _PAD, _RIM = 2, 3, 4, 1
_GLYPH_SQL = "(VALUES " + ", ".join(f"('{c}', {x}, {y})" for c, rows in TX.GLYPHS.items() for y, row in enumerate(rows.split()) for x, bit in enumerate(row) if bit == "1") + ") AS gl(c, cx, cy)"
register(
    "text_bitmap",
    lambda s, sf: TX.bitmap_text(s.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name"), 18, gap=0.17, pad=_PAD, keys=("p_partkey",), text="p_name"),
    f"WITH t AS (SELECT p_partkey, upper(p_name) AS s FROM part), u AS (SELECT p_partkey, s, unnest(range(length(s))) AS n FROM t), "
    f"c AS (SELECT p_partkey, length(s) * {6 * _CELL + _GAP} - {_GAP} + {2 * _PAD} AS wide, {_PAD} + n * {6 * _CELL + _GAP} + cx * {_CELL} AS px, cy * {_CELL} AS py FROM u JOIN {_GLYPH_SQL} ON c = substr(s, n + 1, 1)), "
    f"p AS (SELECT p_partkey, px + i - {_RIM} AS x, py + j - {_RIM} AS y, i BETWEEN {_RIM} AND {_RIM + _CELL - 1} AND j BETWEEN {_RIM} AND {_RIM + _CELL - 1} AS own, wide FROM c, (SELECT unnest(range({_CELL + 2 * _RIM})) AS i), (SELECT unnest(range({_CELL + 2 * _RIM})) AS j)) "
    f"SELECT p_partkey, x::INT AS x, y::INT AS y, CASE WHEN bool_or(own) THEN 255 ELSE 0 END AS r, CASE WHEN bool_or(own) THEN 214 ELSE 0 END AS g, 0 AS b, 255 AS a FROM p WHERE x >= 0 AND y >= 0 AND x < wide AND y < {8 * _CELL + 2 * _PAD} GROUP BY p_partkey, x, y",
)

# -- one frame at a time ------------------------------------------------------------------
_framed = lambda p: p.withColumn("doc_id", F.lit(0).cast("long"))
framed("frame_dither", lambda s, p, w, h: Q.dither(_framed(p), w, h), None)
framed("frame_rain", lambda s, p, w, h: Q.rain(_framed(p), w, h), None)
framed("frame_grain", lambda s, p, w, h: Q.grain(_framed(p), w, h), None)
framed("frame_inpaint", lambda s, p, w, h: Q.inpaint(_framed(p), _framed(p.filter("r > 200")).select("doc_id", "x", "y"), w, h), None)


def _tool(spark, p, w, h):
    todo = spark.createDataFrame([(0, k, t, 20.0 + 4 * k, 60.0, 9.0, 0.5, 0.6, 3, -2) for k, t in enumerate(("blur", "sharpen", "smudge"))], "doc_id long, seq long, tool string, cx double, cy double, radius double, hardness double, strength double, pull_x int, pull_y int")
    return N.apply_sequential(_framed(p), todo, w, h)


framed("frame_blur_sharpen_smudge", _tool, None)

# -- pipelines ------------------------------------------------------------------------------
register("pipeline_demo", lambda s, sf: V.explode_scan(P.demo(s)))
framed("pipeline_thumbnail", lambda s, p, w, h: P.thumbnail(p, w, h, 320, 180), None)
_greened = lambda p: p.select("x", "y", "r", F.when(F.col("x") < 8, 255).otherwise(F.col("g")).alias("g"), F.when(F.col("x") < 8, 0).otherwise(F.col("b")).alias("b"), "a").withColumn("r", F.when(F.col("x") < 8, 0).otherwise(F.col("r")))
framed("pipeline_headline", lambda s, p, w, h: P.headline_thumbnail(_greened(p), w, h, p, w, h), None)
framed("pipeline_fit", lambda s, p, w, h: P.fit_inside(p, w, h, 32, 24), None)
_frames = lambda s, sf: V.scan(s, sf).withColumn("doc_id", F.lit(0).cast("long"))
register("pipeline_retouch", lambda s, sf: P.retouch(_frames(s, sf), W, V.height(s, sf)))
register("pipeline_auto_retouch", lambda s, sf: V.explode_scan(P.auto_retouch(_frames(s, sf), W, V.height(s, sf))))
framed("pipeline_retouch_error", lambda s, p, w, h: Y.mean_absolute_error(P.retouch(P.to_scan(_framed(p), w, h, ("doc_id",)), w, h).drop("doc_id"), p, w, h), None)


def _every_filter(spark, p, w, h):
    """What each filter of the dispatcher makes of the frame, in sums."""
    px, out = _framed(p), None
    for kind in [*P.FILTERS, "chroma", "none"]:
        one = P.apply_filter(px, kind, w, h).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgba"])
        out = one if out is None else out.unionByName(one)
    return out


framed("filter_dispatch", _every_filter, None)
register("pipeline_flagship", lambda s, sf: flagship(s, sf))
framed(
    "pipeline_layer_split",
    lambda s, p, w, h: P.layer_split(p, p.select("x", "y", A.colour_class(R, G, BL, YY).col.alias("class"))).groupBy("class").agg(F.count("*").alias("n"), F.sum("r").alias("r")),
    f"SELECT class, count(*) AS n, sum(r)::BIGINT AS r FROM (SELECT r, {A.colour_class(R, G, BL, YY).duck} AS class FROM px) GROUP BY class",
)


def _rebuilt(spark, p, w, h):
    """How far the frame that is rebuilt from its layers is from the frame itself: no pixel differs."""
    split = P.layer_split(p, p.select("x", "y", A.colour_class(R, G, BL, YY).col.alias("class")))
    return Y.percent_different(P.layer_rebuild(split, w, h), p, w, h)


framed("pipeline_layer_rebuild", _rebuilt, ", one AS (SELECT 1 AS k) SELECT 0.0::DOUBLE AS percent FROM one")

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.layers(spark, sf_dir)
    rows = int(px.agg(F.max("y")).first()[0]) + 1
    return V.explode_scan(P.flagship(px, 128, rows))


_FLAT = K.flatten_sql(V.LAYERS, [L(1), L(2, "multiply", 0.5), L(3, "screen", 0.8), L(4, "overlay")])
SQL["pipeline_flagship"] = (
    f"WITH ly AS ({V.LAYERS}), hh AS (SELECT max(y) + 1 AS h FROM ly), fl AS MATERIALIZED ({_FLAT}), "
    "px AS MATERIALIZED (SELECT t.x, t.y, coalesce(f.r, 0) AS r, coalesce(f.g, 0) AS g, coalesce(f.b, 0) AS b, coalesce(f.a, 0) AS a FROM (SELECT unnest(range(128))::INT AS x, y FROM (SELECT unnest(range((SELECT h FROM hh)))::INT AS y)) t LEFT JOIN fl f ON f.x = t.x AND f.y = t.y), "
    + two_pass([1.0] * 5, _mean, _mean, "rgb").replace("least(64 - 1", "least(128 - 1")
    + " SELECT x, y, blur.r AS r, blur.g AS g, blur.b AS b, px.a AS a FROM blur JOIN px USING (x, y)"
)
