"""Flattening a stack of layers.

The stack is a short list known when the plan is made; pixels are data. One
aggregation brings a coordinate's layers together: each layer is one packed
integer, taken with ``max`` under a condition, so partial sums run before the
shuffle and no list is collected. The fold over the layers, whose order
matters, is then unrolled into projections inside whole-stage code.

``render`` returns the columns of both engines' plans: a Spark frame, or SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blend as B
from ..functions.adjust import ADJUSTMENTS
from ..functions.color import from_byte, to_byte, to_srgb
from ..functions.dual import Steps, X, clamp, dbl, half_up, name, when

TILE = 256


@dataclass(frozen=True)
class Layer:
    """One entry of the stack, bottom first. ``kind``: paint, adjust, group or end."""

    z: int = 0
    mode: str = "normal"
    opacity: float = 1.0
    visible: bool = True
    ox: int = 0
    oy: int = 0
    clip: bool = False
    masked: bool = False
    vector_masked: bool = False
    kind: str = "paint"
    adjust: str | Callable | None = None
    params: dict = field(default_factory=dict)


def coerce_opacity(v) -> float:
    """Not finite: 1; else within 0 to 1."""
    import math

    try:
        v = float(v)
    except (TypeError, ValueError):
        return 1.0
    return min(1.0, max(0.0, v)) if math.isfinite(v) else 1.0


def effective(stack: list[Layer]) -> list[tuple[Layer, float]]:
    """Layers that can show, with their opacity times that of all open groups; a hidden group counts 0, its mode is ignored."""
    groups, out = [1.0], []
    for layer in stack:
        if layer.kind == "end":
            groups = groups[:-1] or [1.0]
        elif layer.kind == "group":
            groups.append(groups[-1] * (coerce_opacity(layer.opacity) if layer.visible else 0.0))
        elif layer.visible and coerce_opacity(layer.opacity) > 0 and groups[-1] > 0:
            out.append((layer, coerce_opacity(layer.opacity) * groups[-1]))
    return out


def fold(stack: list[Layer]) -> Steps:
    """From columns p{z} (packed colour), m{z} (mask) and v{z} (vector mask) to r, g, b, a."""
    s = Steps().let(c_r=0.0, c_g=0.0, c_b=0.0, c_a=0.0)
    for n, (layer, opacity) in enumerate(effective(stack)):
        back = [name(f"c_{k}") for k in "rgb"]
        ba, t = name("c_a"), f"k{n}"
        if layer.kind == "adjust":
            f, params = ADJUSTMENTS[layer.adjust] if isinstance(layer.adjust, str) else (layer.adjust, {})
            s.let(**{f"{t}{k}": half_up(clamp(to_srgb(v), 0.0, 1.0) * 255.0) for k, v in zip("rgb", back)})
            more = {"steps": s, "tag": t} if "steps" in f.__code__.co_varnames[: f.__code__.co_argcount] else {}
            out = f(*[name(f"{t}{k}") for k in "rgb"], **(layer.params or params), **more)
            out = {k: s.keep(f"{t}b{k}", v) for k, v in out.items()}
            new = {f"{t}o{k}": when((ba > 0.0, from_byte(out[k])), other=c) for k, c in zip("rgb", back)}
            s.let(**new, **{f"{t}oa": when((ba > 0.0, dbl(half_up(ba * 255.0)) / 255.0), other=ba)})
            _rename(s, t)
            continue
        p = name(f"p{layer.z}")
        byte = lambda k, p=p: X(f"CAST(shiftright({p.spark}, {k}) & 255 AS INT)", f"CAST(({p.duck} >> {k}) & 255 AS INT)")
        s.let(**{f"{t}_sa": when((X(f"{p.spark} IS NULL"), 0), other=byte(0))})
        sa = name(f"{t}_sa")
        if layer.clip:
            sa = _step(s, f"{t}_clip", when((ba <= 0.0, 0), other=half_up(dbl(sa) * ba)))
        if layer.masked:
            m = name(f"coalesce(m{layer.z}, 0)")
            sa = _step(s, f"{t}_mask", half_up(dbl(sa) / 255.0 * (dbl(m) / 255.0) * 255.0))
        if layer.vector_masked:
            sa = _step(s, f"{t}_vec", when((name(f"coalesce(v{layer.z}, 0)") > 0, sa), other=0))
        if opacity < 1:
            sa = _step(s, f"{t}_op", half_up(dbl(sa) * opacity))
        s.let(**{f"{t}_s{k}": when((sa > 0, from_byte(byte(b), single=True)), other=0.0) for k, b in zip("rgb", (24, 16, 8))})
        B.over(s, layer.mode, back, ba, [name(f"{t}_s{k}") for k in "rgb"], dbl(sa) / 255.0, f"{t}o")
        _rename(s, t)
    return s.let(**{f"o_{k}": when((name("c_a") > 0.0, to_byte(name(f"c_{k}"))), other=0) for k in "rgb"}, o_a=half_up(clamp(name("c_a"), 0.0, 1.0) * 255.0))


def _step(s: Steps, column: str, value: X) -> X:
    s.let(**{column: value})
    return name(column)


def _rename(s: Steps, t: str) -> None:
    """The layer's result becomes the running colour."""
    s.steps.append({f"c_{k}": name(f"{t}o{k}") for k in "rgba"})


def flatten(pixels: DataFrame, stack: list[Layer], keys: tuple[str, ...] = (), masks: DataFrame | None = None, regions: DataFrame | None = None, clip: tuple[int, int, int, int] | None = None, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """(keys, x, y, r, g, b, a) of the visible stack.

    ``pixels``: keys, x, y, z and bytes r, g, b, a; a layer without a row at a
    coordinate is clear there. ``masks``: keys, x, y, z, m; ``regions``: keys, x,
    y, z (members of vector masks). ``clip`` is x, y, w, h; ``tiles`` limits the
    work to dirty tiles.
    """
    shown = [layer for layer, _ in effective(stack) if layer.kind == "paint"]
    at = [*keys, "x", "y"]
    move = lambda c, pick: F.col(c) + F.coalesce(F.create_map(*[F.lit(v) for layer in shown for v in (layer.z, pick(layer))])[F.col("z")], F.lit(0))
    moved = lambda d: d.filter(F.col("z").isin([layer.z for layer in shown])).withColumns({"x": move("x", lambda v: v.ox), "y": move("y", lambda v: v.oy)})
    packed = (F.col("r").cast("long") * (1 << 24) + F.col("g") * (1 << 16) + F.col("b") * (1 << 8) + F.col("a")).alias("v")
    rows = moved(pixels.filter("a > 0")).select(*at, "z", F.lit("p").alias("plane"), packed)
    if masks is not None:
        rows = rows.unionByName(moved(masks).select(*at, "z", F.lit("m").alias("plane"), F.col("m").cast("long").alias("v")))
    if regions is not None:
        rows = rows.unionByName(moved(regions).select(*at, "z", F.lit("v").alias("plane"), F.lit(1).cast("long").alias("v")))
    if clip:
        x, y, w, h = clip
        rows = rows.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    if tiles is not None:
        rows = rows.filter(F.struct(F.floor(F.col("x") / TILE).cast("int"), F.floor(F.col("y") / TILE).cast("int")).isin([F.struct(F.lit(a), F.lit(b)) for a, b in tiles]))
    need = [(k, layer.z) for layer in shown for k in ("p", *(["m"] if layer.masked else []), *(["v"] if layer.vector_masked else []))]
    aggs = [F.max(F.when((F.col("plane") == k) & (F.col("z") == z), F.col("v"))).alias(f"{k}{z}") for k, z in dict.fromkeys(need)]
    out = fold(stack).spark(rows.groupBy(*at).agg(*aggs))
    return out.filter("o_a > 0").select(*at, *[F.col(f"o_{k}").alias(k) for k in "rgba"])


def flatten_sql(pixels: str, stack: list[Layer], masks: str | None = None, regions: str | None = None, where: str = "true") -> str:
    """The checking engine's form of ``flatten``."""
    shown = [layer for layer, _ in effective(stack) if layer.kind == "paint"]
    shift = lambda c, pick: f"{c} + CASE z " + " ".join(f"WHEN {layer.z} THEN {pick(layer)}" for layer in shown) + " ELSE 0 END"
    zs = ", ".join(str(layer.z) for layer in shown)
    xy = f"{shift('x', lambda v: v.ox)} AS x, {shift('y', lambda v: v.oy)} AS y"
    rows = f"SELECT {xy}, z, 'p' AS plane, r::BIGINT * 16777216 + g * 65536 + b * 256 + a AS v FROM ({pixels}) WHERE a > 0 AND z IN ({zs})"
    if masks:
        rows += f" UNION ALL SELECT {xy}, z, 'm', m::BIGINT FROM ({masks}) WHERE z IN ({zs})"
    if regions:
        rows += f" UNION ALL SELECT {xy}, z, 'v', 1::BIGINT FROM ({regions}) WHERE z IN ({zs})"
    need = dict.fromkeys((k, layer.z) for layer in shown for k in ("p", *(["m"] if layer.masked else []), *(["v"] if layer.vector_masked else [])))
    aggs = ", ".join(f"max(CASE WHEN plane = '{k}' AND z = {z} THEN v END) AS {k}{z}" for k, z in need)
    return f"SELECT x, y, o_r AS r, o_g AS g, o_b AS b, o_a AS a FROM ({fold(stack).duck(f'SELECT x, y, {aggs} FROM ({rows}) WHERE {where} GROUP BY x, y')}) WHERE o_a > 0"


def over_gamma(back: DataFrame, top: DataFrame, fx: int, fy: int, brightness: float = 1.0, opaque: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``top`` laid on ``back`` at (fx, fy) in gamma space; bytes half-to-even."""
    t = top.filter("a > 0").select(*keys, (F.col("x") + fx).alias("x"), (F.col("y") + fy).alias("y"), *[F.col(c).alias(f"t_{c}") for c in "rgba"])
    joined = back.join(t, [*keys, "x", "y"], "left")
    k = F.col("t_a") / 255.0
    mix = lambda c: F.when(F.col("t_a").isNull(), F.col(c)).otherwise(F.rint(F.least(F.lit(255.0), F.col(f"t_{c}") * F.lit(brightness) * k + F.col(c) * (1 - k))).cast("int"))
    a = F.when(F.col("t_a").isNull(), F.col("a")).otherwise(F.lit(255)) if opaque else F.col("a")
    return joined.select(*keys, "x", "y", *[mix(c).alias(c) for c in "rgb"], a.alias("a"))


def dirty_tiles(x: int, y: int, w: int, h: int, tiles_x: int, tiles_y: int) -> list[tuple[int, int]]:
    """Tiles that a changed rectangle touches."""
    span = lambda a, n, most: range(max(0, a // TILE), min(most - 1, (a + n - 1) // TILE) + 1)
    return [(tx, ty) for ty in span(y, h, tiles_y) for tx in span(x, w, tiles_x)]


def refresh(cached: DataFrame, pixels: DataFrame, stack: list[Layer], tiles: list[tuple[int, int]], **more) -> DataFrame:
    """A flattened frame after a change: dirty tiles are made anew, the others kept."""
    tile = F.struct(F.floor(F.col("x") / TILE).cast("int"), F.floor(F.col("y") / TILE).cast("int"))
    kept = cached.filter(~tile.isin([F.struct(F.lit(a), F.lit(b)) for a, b in tiles]))
    return kept.unionByName(flatten(pixels, stack, tiles=tiles, **more))

