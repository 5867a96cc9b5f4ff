"""Blend modes and source-over compositing as formulas over linear light."""

from __future__ import annotations

from .color import BLEND_LUMA, from_byte, luma, to_byte
from .dual import Steps, X, call, clamp, dbl, greatest, half_up, least, lit, name, when

#: Channel by channel: backdrop ``b``, source ``s``.
SEPARABLE = {
    "normal": lambda b, s: s,
    "dissolve": lambda b, s: s,
    "darken": lambda b, s: least(b, s),
    "multiply": lambda b, s: b * s,
    "colorBurn": lambda b, s: _burn(b, s),
    "linearBurn": lambda b, s: greatest(0.0, b + s - 1.0),
    "lighten": lambda b, s: greatest(b, s),
    "screen": lambda b, s: b + s - b * s,
    "colorDodge": lambda b, s: _dodge(b, s),
    "linearDodge": lambda b, s: least(1.0, b + s),
    "overlay": lambda b, s: _hard(s, b),
    "softLight": lambda b, s: _soft(b, s),
    "hardLight": lambda b, s: _hard(b, s),
    "vividLight": lambda b, s: when((s <= 0.5, _burn(b, 2.0 * s)), other=_dodge(b, 2.0 * s - 1.0)),
    "linearLight": lambda b, s: clamp(b + 2.0 * s - 1.0, 0.0, 1.0),
    "pinLight": lambda b, s: when((s <= 0.5, least(b, 2.0 * s)), other=greatest(b, 2.0 * s - 1.0)),
    "hardMix": lambda b, s: when((b + s >= 1.0, 1.0), other=0.0),
    "difference": lambda b, s: call("abs", b - s),
    "exclusion": lambda b, s: b + s - 2.0 * b * s,
    "subtract": lambda b, s: greatest(0.0, b - s),
    "divide": lambda b, s: when((s <= 0.0, 1.0), other=least(1.0, b / s)),
}
NON_SEPARABLE = ("hue", "saturation", "color", "luminosity", "darkerColor", "lighterColor")
MODES = (*SEPARABLE, *NON_SEPARABLE)


def _burn(b, s) -> X:
    return when((s <= 0.0, 0.0), other=1.0 - least(1.0, (1.0 - b) / s))


def _dodge(b, s) -> X:
    return when((s >= 1.0, 1.0), other=least(1.0, b / (1.0 - s)))


def _hard(b, s) -> X:
    return when((s <= 0.5, 2.0 * b * s), other=1.0 - 2.0 * (1.0 - b) * (1.0 - s))


def _soft(b, s) -> X:
    curve = when((b <= 0.25, ((16.0 * b - 12.0) * b + 4.0) * b), other=call("sqrt", b))
    return when((s <= 0.5, b - (1.0 - 2.0 * s) * b * (1.0 - b)), other=b + (2.0 * s - 1.0) * (curve - b))


def _lum(c) -> X:
    return luma(*c, weights=BLEND_LUMA)


def _three(prefix: str) -> list[X]:
    return [name(f"{prefix}{k}") for k in "rgb"]


def _set(steps: Steps, prefix: str, values) -> list[X]:
    steps.let(**{f"{prefix}{k}": v for k, v in zip("rgb", values)})
    return _three(prefix)


def set_lum(steps: Steps, colour, target, tag: str) -> list[X]:
    """``colour`` moved to the luma ``target`` and pulled back into range; values land in ``{tag}r`` and so on."""
    own = _set(steps, f"{tag}_c", colour)
    steps.let(**{f"{tag}_d": target - _lum(own)})
    own = _set(steps, f"{tag}_s", [v + name(f"{tag}_d") for v in own])
    steps.let(**{f"{tag}_l": _lum(own), f"{tag}_n": least(*own)})
    low, n = name(f"{tag}_l"), name(f"{tag}_n")
    own = _set(steps, f"{tag}_u", [when((n < 0.0, low + (v - low) * low / (low - n)), other=v) for v in own])
    steps.let(**{f"{tag}_x": greatest(*own)})
    x = name(f"{tag}_x")
    return _set(steps, tag, [when((x > 1.0, low + (v - low) * (1.0 - low) / (x - low)), other=v) for v in own])


def set_sat(colour, target) -> list[X]:
    """``colour`` stretched so that its range is ``target`` and its least channel 0."""
    hi, lo = greatest(*colour), least(*colour)
    return [when((hi > lo, (v - lo) * target / when((hi > lo, hi - lo), other=1.0)), other=0.0) for v in colour]


def blend(steps: Steps, mode: str, back: list[X], src: list[X], tag: str = "m") -> list[X]:
    """The three blended channels; helper columns are added to ``steps`` where a mode needs them."""
    if mode in SEPARABLE:
        return _set(steps, tag, [SEPARABLE[mode](b, s) for b, s in zip(back, src)])
    spread = lambda c: greatest(*c) - least(*c)
    if mode == "hue":
        return set_lum(steps, _set(steps, f"{tag}_h", set_sat(src, spread(back))), _lum(back), tag)
    if mode == "saturation":
        return set_lum(steps, _set(steps, f"{tag}_h", set_sat(back, spread(src))), _lum(back), tag)
    if mode == "color":
        return set_lum(steps, src, _lum(back), tag)
    if mode == "luminosity":
        return set_lum(steps, back, _lum(src), tag)
    darker = _lum(src) < _lum(back) if mode == "darkerColor" else _lum(src) > _lum(back)
    return _set(steps, tag, [when((darker, s), other=b) for b, s in zip(back, src)])


def over(steps: Steps, mode: str, back: list[X], ab: X, src: list[X], alpha: X, tag: str = "q") -> list[X]:
    """Source over backdrop, straight alpha: columns ``{tag}r, {tag}g, {tag}b, {tag}a``.

    Where the source is clear the backdrop stays; where the backdrop is clear the source counts alone.
    """
    mixed = blend(steps, mode, back, src, f"{tag}m")
    steps.let(**{f"{tag}_sa": alpha, f"{tag}_ba": ab})
    sa, ba = name(f"{tag}_sa"), name(f"{tag}_ba")
    steps.let(**{f"{tag}_ao": sa + ba * (1.0 - sa)})
    ao = name(f"{tag}_ao")
    whole = when((ao > 0.0, ao), other=1.0)

    def value(b: X, s: X, m: X) -> X:
        if SEPARABLE.get(mode) is SEPARABLE["normal"]:
            return when((sa <= 0.0, b), (ba <= 0.0, s), other=(sa * s + (1.0 - sa) * ba * b) / whole)
        return when((sa <= 0.0, b), (ba <= 0.0, s), other=(sa * (1.0 - ba) * s + sa * ba * m + (1.0 - sa) * ba * b) / whole)

    steps.let(**{f"{tag}{k}": value(b, s, m) for k, b, s, m in zip("rgb", back, src, mixed)}, **{f"{tag}a": when((sa <= 0.0, ba), other=ao)})
    return [*_three(tag), name(f"{tag}a")]


def over_bytes(steps: Steps, mode: str, back: list[X], top: list[X], opacity: float = 1.0, tag: str = "q") -> dict[str, X]:
    """Two RGBA byte colours composited in linear light; bytes again."""
    lb = _set(steps, f"{tag}_lb", [from_byte(v) for v in back[:3]])
    ls = _set(steps, f"{tag}_ls", [from_byte(v) for v in top[:3]])
    out = over(steps, mode, lb, dbl(back[3]) / 255.0, ls, dbl(top[3]) / 255.0 * lit(float(opacity)), tag)
    return {k: to_byte(v) for k, v in zip("rgb", out)} | {"a": half_up(clamp(out[3], 0.0, 1.0) * 255.0)}
