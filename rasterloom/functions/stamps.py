"""What one stamp of a tool does to one pixel, as formulas.

``at`` holds the stamp's centre, radius and hardness. A pixel outside the stamp,
or one that it covers with nothing, keeps its colour.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import blend
from .color import REC709, from_byte, luma, to_byte
from .dual import Steps, X, call, clamp, dbl, greatest, half_up, lit, when


@dataclass(frozen=True)
class Stamp:
    cx: float
    cy: float
    radius: float
    hardness: float = 0.8
    square: bool = False

    @property
    def reach(self) -> float:
        return max(1.0, self.radius / 2 if self.square else self.radius)

    def distance(self, x, y) -> X:
        """From the centre, the rim being 1."""
        dx, dy = dbl(x) - float(self.cx), dbl(y) - float(self.cy)
        d = greatest(call("abs", dx), call("abs", dy)) if self.square else call("sqrt", dx * dx + dy * dy)
        return d / float(self.reach)

    def coverage(self, d: X) -> X:
        """Share of the pixel that is covered: a hard rim, a soft curve, or a mix of both."""
        aa = min(1.0, 1 / self.reach)
        hard = clamp(1.0 - (d - (1.0 - aa)) / aa, 0.0, 1.0)
        soft = call("power", greatest(0.0, 1.0 - d), 1.6)
        if self.hardness >= 1:
            return hard
        return soft if self.hardness <= 0 else hard * self.hardness + soft * (1.0 - self.hardness)


def _kept(steps: Steps, hit: X, new: dict[str, X], old: list[X]) -> dict[str, X]:
    steps.let(hit=hit)
    on = X("hit")
    return {k: when((on, new[k]), other=o) for k, o in zip("rgba", old)}


def _covered(steps: Steps, at: Stamp, x, y) -> tuple[X, X]:
    d = steps.keep("d", at.distance(x, y))
    return d, steps.keep("cov", when((d <= 1.0, at.coverage(d)), other=0.0))


def _laid(steps: Steps, px: list[X], top: list[X], alpha: X, inside: X) -> dict[str, X]:
    a = steps.keep("sa", alpha)
    return _kept(steps, inside & (a > 0), blend.over_bytes(steps, "normal", px, [*top, a]), px)


def brush(steps: Steps, px: list[X], x, y, at: Stamp, color, alpha: float = 1.0) -> dict[str, X]:
    """A round or square stamp of one colour."""
    d, cov = _covered(steps, at, x, y)
    k = clamp01(color[3] / 255) * clamp01(alpha)
    return _laid(steps, px, [lit(c) for c in color[:3]], half_up(cov * k * 255.0), d <= 1.0)


def pencil(steps: Steps, px: list[X], x, y, at: Stamp, color, alpha: float = 1.0) -> dict[str, X]:
    """Every pixel of the disc at one strength."""
    d = steps.keep("d", at.distance(x, y))
    k = clamp01(color[3] / 255) * clamp01(alpha)
    return _laid(steps, px, [lit(c) for c in color[:3]], half_up(lit(k) * 255.0), d <= 1.0)


def erase(steps: Steps, px: list[X], x, y, at: Stamp, strength: float = 1.0) -> dict[str, X]:
    """Alpha falls by the covered share."""
    d, cov = _covered(steps, at, x, y)
    new = dict(zip("rgb", px[:3])) | {"a": half_up(dbl(px[3]) * (1.0 - cov * strength))}
    return _kept(steps, d <= 1.0, new, px)


def clone(steps: Steps, px: list[X], src: list[X], x, y, at: Stamp, alpha: float = 1.0) -> dict[str, X]:
    """The source pixel (by an offset join) laid over."""
    d, cov = _covered(steps, at, x, y)
    return _laid(steps, px, src[:3], half_up(cov * (dbl(src[3]) / 255.0) * clamp01(alpha) * 255.0), (d <= 1.0) & (src[3] > 0))


def heal(steps: Steps, px: list[X], src: list[X], x, y, at: Stamp, alpha: float = 1.0) -> dict[str, X]:
    """The source's luma with the pixel's own colour."""
    d, cov = _covered(steps, at, x, y)
    grey = steps.keep("grey", luma(*[dbl(v) for v in src[:3]], weights=REC709))
    r, g, b = (dbl(v) for v in px[:3])
    i = steps.keep("hi", 0.596 * r - 0.274 * g - 0.322 * b)
    q = steps.keep("hq", 0.211 * r - 0.523 * g + 0.312 * b)
    mixed = (grey + 0.956 * i + 0.621 * q, grey - 0.272 * i - 0.647 * q, grey - 1.106 * i + 1.702 * q)
    top = [steps.keep(f"heal_{k}", half_up(clamp(v, 0.0, 255.0))) for k, v in zip("rgb", mixed)]
    return _laid(steps, px, top, half_up(cov * clamp01(alpha) * 255.0), (d <= 1.0) & (src[3] > 0) & (px[3] > 0))


def dodge_burn(steps: Steps, px: list[X], x, y, at: Stamp, exposure: float, tones: str = "midtones") -> dict[str, X]:
    """Lighter (or, below 0, darker) by tone range, in linear light."""
    d, cov = _covered(steps, at, x, y)
    lin = [steps.keep(f"lin_{k}", from_byte(v)) for k, v in zip("rgb", px)]
    y_ = steps.keep("tone", luma(*lin))
    weight = {"shadows": 1.0 - y_, "highlights": y_}.get(tones, clamp((1.0 - call("abs", y_ - 0.5) * 2.0) * 1.4, 0.0, 1.0))
    k = steps.keep("wt", weight * (cov * min(1.0, abs(exposure))))
    new = {c: to_byte(1.0 - (1.0 - v) * (1.0 - k) if exposure >= 0 else v * (1.0 - k)) for c, v in zip("rgb", lin)} | {"a": px[3]}
    return _kept(steps, (d <= 1.0) & (cov > 0.0) & (px[3] > 0), new, px)


def clamp01(v: float) -> float:
    return min(1.0, max(0.0, v))


