"""Colour arithmetic as formulas over bytes (0..255) and linear light (0..1)."""

from __future__ import annotations

from .dual import Steps, X, byte_up, call, clamp, dbl, greatest, half_up, least, lit, when

#: Fixed values of the sRGB transfer function and of the luma weights.
SRGB_CUT, SRGB_SLOPE, SRGB_OFFSET, SRGB_GAMMA = 0.04045, 12.92, 0.055, 2.4
LINEAR_CUT = 0.0031308
REC709 = (0.2126, 0.7152, 0.0722)
REC601 = (0.299, 0.587, 0.114)
BLEND_LUMA = (0.3, 0.59, 0.11)


def _linear(v: float) -> float:
    return v / SRGB_SLOPE if v <= SRGB_CUT else ((v + SRGB_OFFSET) / (1 + SRGB_OFFSET)) ** SRGB_GAMMA


#: Linear light of each byte, for what is computed on the driver.
LINEAR = [_linear(i / 255) for i in range(256)]


def from_byte(v, single: bool = False) -> X:
    """Linear light of a byte; ``single``: rounded to single precision, as the compositor's table is."""
    unit = dbl(v) / 255.0
    out = when((unit <= SRGB_CUT, unit / SRGB_SLOPE), other=call("power", (unit + SRGB_OFFSET) / (1 + SRGB_OFFSET), SRGB_GAMMA))
    return X(f"CAST(CAST({out.spark} AS FLOAT) AS DOUBLE)", f"CAST(CAST({out.duck} AS FLOAT) AS DOUBLE)") if single else out


def to_linear(v) -> X:
    v = clamp(v, 0.0, 1.0)
    return when((v <= SRGB_CUT, v / SRGB_SLOPE), other=call("power", (v + SRGB_OFFSET) / (1 + SRGB_OFFSET), SRGB_GAMMA))


def to_srgb(v) -> X:
    v = lit(v)
    curve = (1 + SRGB_OFFSET) * call("power", v, 1 / SRGB_GAMMA) - SRGB_OFFSET
    return when((v >= 1.0, 1.0), (v <= 0.0, 0.0), (v <= LINEAR_CUT, v * SRGB_SLOPE), other=curve)


def to_byte(v) -> X:
    """Byte of a linear value, halves up."""
    return half_up(to_srgb(v) * 255.0)


def luma(r, g, b, weights=REC709) -> X:
    return lit(weights[0]) * r + lit(weights[1]) * g + lit(weights[2]) * b


def rgb_to_hsl(r, g, b) -> dict[str, X]:
    r, g, b = (dbl(v) / 255.0 for v in (r, g, b))
    hi, lo = greatest(r, g, b), least(r, g, b)
    mid, d = (hi + lo) / 2.0, hi - lo
    s = when((hi.eq(lo), 0.0), (mid > 0.5, d / (2.0 - hi - lo)), other=d / (hi + lo))
    return {"h": _hue(r, g, b, hi, lo), "s": s, "l": mid}


def rgb_to_hsv(r, g, b) -> dict[str, X]:
    r, g, b = (dbl(v) / 255.0 for v in (r, g, b))
    hi, lo = greatest(r, g, b), least(r, g, b)
    return {"h": _hue(r, g, b, hi, lo), "s": when((hi.eq(0.0), 0.0), other=(hi - lo) / hi), "v": hi}


def _hue(r, g, b, hi, lo) -> X:
    d = hi - lo
    sector = when((hi.eq(r), (g - b) / d + when((g < b, 6.0), other=0.0)), (hi.eq(g), (b - r) / d + 2.0), other=(r - g) / d + 4.0)
    return when((hi.eq(lo), 0.0), other=60.0 * sector)


def hsl_to_rgb(h, s, l) -> dict[str, X]:  # noqa: E741
    """Bytes; ``h`` in degrees 0..360."""
    h, s, l = lit(h), lit(s), lit(l)  # noqa: E741
    turn = h % 360.0 / 360.0
    q = when((l < 0.5, l * (1.0 + s)), other=l + s - l * s)
    p = 2.0 * l - q

    def channel(shift: float) -> X:
        t = turn + shift
        t = when((t < 0.0, t + 1.0), (t > 1.0, t - 1.0), other=t)
        return when((t < 1 / 6, p + (q - p) * 6.0 * t), (t < 0.5, q), (t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6.0), other=p)

    return {c: half_up(when((s.eq(0.0), l), other=channel(k)) * 255.0) for c, k in (("r", 1 / 3), ("g", 0.0), ("b", -1 / 3))}


def lerp(c1, c2, t) -> X:
    """Between two bytes, in linear light."""
    a, b = from_byte(c1), from_byte(c2)
    return byte_up(to_srgb(a + (b - a) * t) * 255.0)


def to_hex(r, g, b) -> X:
    one = [byte_up(v) for v in (r, g, b)]
    s = ", ".join(f"lpad(lower(hex({v.spark})), 2, '0')" for v in one)
    d = ", ".join(f"printf('%02x', {v.duck})" for v in one)
    return X(f"concat('#', {s})", f"concat('#', {d})")


def from_hex(text) -> dict[str, X]:
    """Bytes of a colour of 3 or 6 hexadecimal digits, null where it is not one."""
    t = lit(text)
    s = f"regexp_replace(trim({t.spark}), '^#', '')"
    d = f"regexp_replace(trim({t.duck}), '^#', '')"
    wide = X(
        f"(CASE WHEN length({s}) = 3 THEN regexp_replace({s}, '(.)', '$1$1') ELSE {s} END)",
        f"(CASE WHEN length({d}) = 3 THEN regexp_replace({d}, '(.)', '\\1\\1', 'g') ELSE {d} END)",
    )
    ok_s, ok_d = f"{wide.spark} RLIKE '^[0-9a-fA-F]{{6}}$'", f"regexp_full_match({wide.duck}, '[0-9a-fA-F]{{6}}')"
    return {
        c: X(
            f"(CASE WHEN {ok_s} THEN CAST(conv(substr({wide.spark}, {1 + 2 * k}, 2), 16, 10) AS INT) END)",
            f"(CASE WHEN {ok_d} THEN CAST(('0x' || substr({wide.duck}, {1 + 2 * k}, 2))::INT AS INT) END)",
        )
        for k, c in enumerate("rgb")
    }


def u8_to_u16(v) -> X:
    return lit(v) * 257


def u16_to_u8(v) -> X:
    v = lit(v)
    return X(f"shiftright({v.spark}, 8)", f"({v.duck} >> 8)")


def cmyk_to_rgb(c, m, y, k) -> dict[str, X]:
    """From planes stored inverted (255 = no ink)."""
    return {o: half_up(dbl(v) * k / 255.0) for o, v in zip("rgb", (lit(c), lit(m), lit(y)))}


def rgb_to_cmyk(r, g, b) -> dict[str, X]:
    """Ink amounts (255 = full)."""
    full = greatest(r, g, b)
    ink = lambda v: when((full.eq(0), 0), other=half_up(dbl(full - v) * 255.0 / greatest(full, 1)))
    return {"cyan": ink(lit(r)), "magenta": ink(lit(g)), "yellow": ink(lit(b)), "black": 255 - full}


def f32_to_byte(v) -> X:
    return half_up(clamp(v, 0.0, 1.0) * 255.0)


#: White of D50, adaptation from D50 to D65, XYZ (D65) to linear sRGB, and the two limits of the Lab curve.
D50 = (0.9642, 1.0, 0.8249)
D50_TO_D65 = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.020483, 1.3299098))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
LAB_EPSILON, LAB_KAPPA = 0.008856, 903.3


def lab_to_rgb(steps: Steps, lightness, a, b) -> dict[str, X]:
    """Bytes from Lab bytes: L scaled to 0..100, a and b offset by 128."""
    scaled = steps.keep("lab_l", dbl(lightness) * 100.0 / 255.0)
    fy = steps.keep("lab_fy", (scaled + 16.0) / 116.0)
    fx, fz = steps.keep("lab_fx", fy + (dbl(a) - 128.0) / 500.0), steps.keep("lab_fz", fy - (dbl(b) - 128.0) / 200.0)
    cube = lambda f: f * f * f
    inverse = lambda f: when((cube(f) > LAB_EPSILON, cube(f)), other=(116.0 * f - 16.0) / LAB_KAPPA)
    xyz = [w * v for w, v in zip(D50, (inverse(fx), when((scaled > 8.0, cube(fy)), other=scaled / LAB_KAPPA), inverse(fz)))]
    for n, rows in enumerate((D50_TO_D65, XYZ_TO_RGB)):
        own = [steps.keep(f"lab_{n}{k}", v) for k, v in enumerate(xyz)]
        xyz = [steps.keep(f"lab_{n}m{k}", m[0] * own[0] + m[1] * own[1] + m[2] * own[2]) for k, m in enumerate(rows)]
    return {o: to_byte(v) for o, v in zip("rgb", xyz)}


def hash2(x, y) -> X:
    """A fraction from two whole coordinates, with 32-bit wrap-around; products beyond 2^53 round as doubles do.

    ``x`` and ``y`` are small and not negative, so only the second product is that large.
    """
    wrap = lambda v: X(f"CAST(pmod({v.spark}, 4294967296) AS BIGINT)", f"CAST((({v.duck}) % 4294967296 + 4294967296) % 4294967296 AS BIGINT)")
    big = lambda v: X(f"CAST({lit(v).spark} AS BIGINT)", f"CAST({lit(v).duck} AS BIGINT)")
    xor = lambda v, k: X(f"({v.spark} ^ shiftright({v.spark}, {k}))", f"xor({v.duck}, {v.duck} >> {k})")
    signed = lambda v: when((v >= 2147483648, v - 4294967296), other=v)
    h = wrap(big(x) * 374761393 + big(y) * 668265263)
    h = signed(xor(h, 13))
    h = wrap(big(dbl(h) * 1274126177.0))
    return dbl(xor(h, 16)) / 4294967296.0


def bit_to_byte(v, k: int) -> X:
    """Bit ``k`` from the left of a packed byte: 1 is black, 0 white."""
    v = lit(v)
    bit = X(f"(shiftright({v.spark}, {7 - k}) & 1)", f"(({v.duck} >> {7 - k}) & 1)")
    return when((bit.eq(1), 0), other=255)
