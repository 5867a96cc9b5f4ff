"""Adjustments and point filters: formulas from one pixel to one pixel.

Two families share names but not rounding: adjustments (usable as layers) round
halves up; filters write clamped bytes, some half-to-even, some cut.
"""

from __future__ import annotations

import math

from .color import REC601, from_byte, luma, to_byte, to_srgb
from .dual import Steps, X, byte_cut, byte_even, byte_up, call, clamp, dbl, greatest, half_up, least, lit, name, pick, when

RGB = "rgb"


def _each(f, r, g, b) -> dict[str, X]:
    return dict(zip(RGB, (f(r), f(g), f(b))))


def _grey(v) -> dict[str, X]:
    return {"r": v, "g": v, "b": v}


# -- adjustments --------------------------------------------------------------


def brightness_contrast(r, g, b, brightness=0.0, contrast=0.0):
    return _each(lambda v: half_up(clamp((dbl(v) / 255.0 - 0.5) * (1.0 + contrast) + 0.5 + brightness, 0.0, 1.0) * 255.0), r, g, b)


def invert(r, g, b):
    return _each(lambda v: 255 - lit(v), r, g, b)


def grayscale(r, g, b):
    return _grey(half_up(luma(r, g, b)))


def hue_saturation(r, g, b, hue=0.0, sat=0.0, light=0.0, steps: Steps | None = None, tag: str = "hs"):
    """Saturation about the luma, hue as a rotation of I and Q, lightness added; all in linear light."""
    keep = (lambda n, v: steps.keep(f"{tag}_{n}", v)) if steps else (lambda n, v: v)
    lin = [keep(f"l{k}", from_byte(v)) for k, v in zip(RGB, (r, g, b))]
    if sat:
        grey = keep("grey", luma(*lin))
        lin = [keep(f"s{k}", grey + (v - grey) * (1.0 + sat / 100.0)) for k, v in zip(RGB, lin)]
    if hue:
        c, s = math.cos(math.radians(hue)), math.sin(math.radians(hue))
        y = keep("y", luma(*lin, weights=REC601))
        i = keep("i", 0.596 * lin[0] - 0.274 * lin[1] - 0.322 * lin[2])
        q = keep("q", 0.211 * lin[0] - 0.523 * lin[1] + 0.312 * lin[2])
        i, q = keep("i2", i * c - q * s), keep("q2", i * s + q * c)
        lin = [keep(f"h{k}", v) for k, v in zip(RGB, (y + 0.956 * i + 0.621 * q, y - 0.272 * i - 0.647 * q, y - 1.106 * i + 1.702 * q))]
    return {k: to_byte(keep(f"o{k}", v + light / 100.0)) for k, v in zip(RGB, lin)}


def levels(r, g, b, shadows=0, highlights=255, gamma=1.0):
    span = float(highlights - shadows) or 1.0
    f = lambda v: half_up(call("power", when((lit(v) < shadows, 0.0), (lit(v) > highlights, 1.0), other=(dbl(v) - float(shadows)) / span), 1.0 / gamma) * 255.0)
    return _each(f, r, g, b)


def threshold(r, g, b, at=128):
    return _grey(when((half_up(luma(r, g, b)) < at, 0), other=255))


def spline_table(points) -> list[int]:
    """256 bytes of a Catmull-Rom curve through byte points; the identity without points."""
    pts = sorted((x / 255, y / 255) for x, y in points)
    if not pts:
        return list(range(256))
    knots = [pts[0], *pts, pts[-1]]
    last = len(knots) - 1

    def at(t: float) -> float:
        inside = (k for k in range(last) if knots[k][0] <= t <= knots[k + 1][0])
        k = last - 1 if t > knots[last][0] else next(inside, 0)
        a, (x1, y1), (x2, y2), d = knots[max(0, k - 1)][1], knots[k], knots[k + 1], knots[min(last, k + 2)][1]
        u = (t - x1) / ((x2 - x1) or 1e-6)
        poly = (2 * y1, y2 - a, 2 * a - 5 * y1 + 4 * y2 - d, 3 * y1 - a - 3 * y2 + d)
        return 0.5 * (poly[0] + poly[1] * u + poly[2] * (u * u) + poly[3] * (u * u * u))

    return [min(255, max(0, math.floor(at(i / 255) * 255 + 0.5))) for i in range(256)]


def linear_table(points) -> list[int]:
    """256 bytes of a polyline through byte points, with (0, 0) and (255, 255) added."""
    pts = sorted([(0, 0), *points, (255, 255)], key=lambda p: p[0])
    out = []
    for i in range(256):
        k = next((k for k in range(len(pts) - 2) if i <= pts[k + 1][0]), len(pts) - 2)
        (x0, y0), (x1, y1) = pts[k], pts[k + 1]
        f = 0 if x1 == x0 else (i - x0) / (x1 - x0)
        out.append(min(255, max(0, math.floor(y0 + (y1 - y0) * f + 0.5))))
    return out


def table(r, g, b, tr=None, tg=None, tb=None):
    """Each channel through its own table of 256 bytes, where it has one."""
    return {c: pick(t, v, "INT") if t else lit(v) for c, v, t in zip(RGB, (r, g, b), (tr, tg, tb))}


def exposure(r, g, b, ev=0.0):
    return _each(lambda v: byte_up(to_srgb(from_byte(v) * 2.0**ev) * 255.0), r, g, b)


def vibrance(r, g, b, amount=0.4):
    s = amount * (1.0 - dbl(greatest(r, g, b) - least(r, g, b)) / 255.0)
    grey = luma(r, g, b, (0.213, 0.715, 0.072))
    return _each(lambda v: byte_up(grey + (v - grey) * (1.0 + s)), r, g, b)


ADJUSTMENTS = {
    "brightness": (brightness_contrast, {"brightness": 0.1, "contrast": 0.25}),
    "invert": (invert, {}),
    "grayscale": (grayscale, {}),
    "hue": (hue_saturation, {"hue": 40.0, "sat": 20.0, "light": 5.0}),
    "levels": (levels, {"shadows": 20, "highlights": 230, "gamma": 1.2}),
    "threshold": (threshold, {"at": 128}),
    "curves": (table, {c: spline_table([(0, 40), (128, 140), (255, 215)]) for c in ("tr", "tg", "tb")}),
    "exposure": (exposure, {"ev": 0.5}),
    "vibrance": (vibrance, {"amount": 0.4}),
}


# -- filters ------------------------------------------------------------------


def f_grayscale(r, g, b):
    return _grey(byte_cut(luma(r, g, b)))


def f_brightness_contrast(r, g, b, brightness=0.0, contrast=0.0):
    return _each(lambda v: byte_even((lit(v) - 128) * (contrast + 1.0) + 128.0 + brightness * 255.0), r, g, b)


def f_threshold(r, g, b, at=128.0):
    return _grey(when((luma(r, g, b) < at, 0), other=255))


#: The sepia matrix.
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


def f_sepia(r, g, b):
    return {c: byte_even(luma(r, g, b, m)) for c, m in zip(RGB, SEPIA)}


def f_posterize(r, g, b, levels=4):
    step = 255 / (max(2, levels) - 1)
    return _each(lambda v: byte_cut(call("floor", call("floor", dbl(v) / step + 0.5) * step + 0.5)), r, g, b)


def f_thermal(r, g, b):
    t = luma(r, g, b, REC601) / 255.0
    part = lambda k: (t - k * 0.25) / 0.25
    four = lambda *v: byte_even(when((t < 0.25, v[0]), (t < 0.5, v[1]), (t < 0.75, v[2]), other=v[3]))
    return {
        "r": four(lit(0.0), part(1) * 255.0, lit(255.0), lit(255.0)),
        "g": four(lit(0.0), lit(0.0), part(2) * 128.0, 128.0 + part(3) * 127.0),
        "b": four(128.0 + t / 0.25 * 127.0, 255.0 - part(1) * 128.0, lit(0.0), part(3) * 255.0),
        "a": lit(255),
    }


def f_vaporwave(r, g, b, shift=0.15):
    t = luma(r, g, b, REC601) / 255.0
    return {"r": byte_cut((255.0 - t * 60.0) * (1.0 - shift) + t * 255.0 * 0.9), "g": byte_cut(t * 120.0 + 40.0), "b": byte_cut(t * 255.0 + 60.0)}


def f_color_balance(r, g, b, shadows=(0.0, 0.0, 0.0), mids=(0.0, 0.0, 0.0), highs=(0.0, 0.0, 0.0)):
    unit = [dbl(v) / 255.0 for v in (r, g, b)]
    t = luma(*unit, weights=(0.3, 0.6, 0.1))
    end = lambda k: when((t < 0.5, (1.0 - t * 2.0) * shadows[k]), other=(t - 0.5) * 2.0 * highs[k])
    mid = 1.0 - call("abs", t * 2.0 - 1.0)
    return {c: byte_cut((v + (end(k) + mid * mids[k]) / 100.0) * 255.0) for k, (c, v) in enumerate(zip(RGB, unit))}


def f_gradient_map(r, g, b, low=(0.0, 0.0, 30.0), high=(255.0, 180.0, 60.0)):
    t = luma(r, g, b, REC601) / 255.0
    return {c: byte_even(lit(lo) + (hi - lo) * t) for c, lo, hi in zip(RGB, low, high)}


def f_exposure(r, g, b, ev=0.0):
    return _each(lambda v: byte_even(lit(v) * float(2.0**ev)), r, g, b)


def f_vibrance(r, g, b, amount=0.0):
    unit = [dbl(v) / 255.0 for v in (r, g, b)]
    hi, lo = greatest(*unit), least(*unit)
    mean = (hi + lo) / 2.0
    s = when((hi.eq(0.0), 0.0), other=(hi - lo) / when((hi.eq(0.0), 1.0), other=hi))
    scale = 1.0 + amount * (1.0 - s) if amount >= 0 else lit(1.0 + amount)
    return {c: byte_up((mean + (v - mean) * scale) * 255.0) for c, v in zip(RGB, unit)}


def f_vignette(r, g, b, x, y, w, h, strength=0.8, radius=1.0):
    cx, cy = w / 2, h / 2
    far = math.hypot(cx, cy) * radius
    dx, dy = dbl(x) - cx, dbl(y) - cy
    d = call("sqrt", dx * dx + dy * dy) / far
    v = 1.0 - least(1.0, greatest(0.0, d - 0.2) / 0.8) * strength
    return _each(lambda c: byte_cut(dbl(c) * v), r, g, b)


def f_tone_map(steps: Steps, r, g, b, contrast=1.12, brightness=8.0, sat=1.15):
    """Contrast about the middle, cut to bytes, then saturation about the luma of those bytes."""
    steps.let(**{f"t{c}": byte_cut(((dbl(v) / 255.0 - 0.5) * contrast + 0.5 + brightness / 255.0) * 255.0) for c, v in zip(RGB, (r, g, b))})
    own = [name(f"t{c}") for c in RGB]
    grey = luma(*own, weights=REC601)
    return {c: byte_cut(grey + (v - grey) * sat) for c, v in zip(RGB, own)}


def f_dark_gradient(r, g, b, y, h, top=0.6, strength=0.55):
    """Darkens towards the bottom, from the row at ``top`` of the height."""
    start = h * top
    k = when((lit(y) < math.floor(start), 1.0), other=1.0 - (dbl(y) - start) / (h - start) * strength)
    return _each(lambda v: byte_even(dbl(v) * k), r, g, b)


def f_dodge_burn(r, g, b, x, y, w, h, strength=1.0):
    """Brightens inside an ellipse about the upper middle and darkens outside it."""
    dx, dy = (dbl(x) - 0.5 * w) / (0.34 * w), (dbl(y) - 0.45 * h) / (0.42 * h)
    d2 = dx * dx + dy * dy
    k = when((d2 <= 1.0, 1.0 + 0.12 * strength * (1.0 - d2)), other=1.0 - 0.10 * strength * least(1.0, (call("sqrt", d2) - 1.0) * 1.5))
    return _each(lambda v: byte_up(dbl(v) * k), r, g, b)


def colour_class(r, g, b, y) -> X:
    """First rule that holds: gold, red, green, title or banner text; else none. Fixed limits."""
    hi, lo = greatest(r, g, b), least(r, g, b)
    r, g, b, y = lit(r), lit(g), lit(b), lit(y)
    gold = (r > 130) & (g > 120)
    return when(
        (gold & (b < 95) & (r - b > 80), "banner"),
        ((r > 200) & (g < 100) & (b < 100), "red"),
        ((g > 100) & (g > r + 30) & (g > b + 25) & ~gold, "green"),
        ((hi > 205) & (hi - lo < 48) & (y >= 250) & (y <= 440), "title"),
        ((hi < 105) & (y >= 372) & (y <= 472), "banner_text"),
        ((hi < 75) & (y >= 250) & (y <= 445), "title"),
        other="none",
    )


def is_skin(r, g, b) -> X:
    y = luma(r, g, b, REC601)
    return (lit(r) > lit(b) + 8) & (lit(g) > lit(b) + 2) & (lit(r) > lit(g) + 2) & (y > 45.0) & (y < 245.0)


# -- tone curves on 0..1 -------------------------------------------------------


def brightness_of(v, amount=0.0) -> X:
    return clamp(lit(v) * (1.0 + amount), 0.0, 1.0)


def gamma_of(v, gamma=1.0) -> X:
    return call("power", v, 1.0 / (gamma if gamma > 0 else 1.0))


def curve_of(v, points) -> X:
    if not points:
        return lit(v)
    v = lit(v)
    parts = [(v <= points[0][0], lit(float(points[0][1])))]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        parts.append((v <= x1, float(y0) + (v - x0) / (x1 - x0) * float(y1 - y0)))
    return when(*parts, other=float(points[-1][1]))


def hsl_of(v, pivot, sat=1.0, light=0.0) -> X:
    return clamp((lit(v) + light - pivot) * sat + pivot, 0.0, 1.0)

