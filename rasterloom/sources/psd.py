"""Layered documents: records, channels, masks and groups, from the public format description.

Written: eight bits, RGB, channels raw or run-length packed. Read: every mode and
depth of ``codecs.PSD_PLANES``; channels raw, packed, deflated and deflated with
differences. Groups are section markers around their members, as in the stack of
``operators.composite``; a group's name, mode and opacity stand on its upper
marker and are read onto the lower one; a closed folder hides its members.
Layers may be adjustments, and may carry a style and a vector mask, of which the
box is kept.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import adjust as A
from ..operators.composite import Layer
from . import blocks, codecs
from .blocks import Reader as _Reader
from .codecs import FormatError

#: Four-letter keys of the blend modes.
MODE_KEYS = {
    "normal": "norm",
    "dissolve": "diss",
    "darken": "dark",
    "multiply": "mul ",
    "colorBurn": "idiv",
    "linearBurn": "lbrn",
    "darkerColor": "dkCl",
    "lighten": "lite",
    "screen": "scrn",
    "colorDodge": "div ",
    "linearDodge": "lddg",
    "lighterColor": "lgCl",
    "overlay": "over",
    "softLight": "sLit",
    "hardLight": "hLit",
    "vividLight": "vLit",
    "linearLight": "lLit",
    "pinLight": "pLit",
    "hardMix": "hMix",
    "difference": "diff",
    "exclusion": "smud",
    "subtract": "fsub",
    "divide": "fdiv",
    "hue": "hue ",
    "saturation": "sat ",
    "color": "colr",
    "luminosity": "lum ",
}
_MODES = {v: k for k, v in MODE_KEYS.items()} | {"pass": "normal"}


@dataclass
class Record:
    """One layer, bottom first; ``rgba`` covers the box, ``mask`` likewise where there is one."""

    name: str = ""
    kind: str = "paint"
    mode: str = "normal"
    opacity: float = 1.0
    visible: bool = True
    clip: bool = False
    x: int = 0
    y: int = 0
    w: int = 0
    h: int = 0
    rgba: bytes = b""
    mask: bytes | None = None
    adjust: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    style: dict[str, dict[str, Any]] = field(default_factory=dict)
    box: tuple[int, int, int, int] | None = None


def _plane(raw: bytes, w: int, h: int, depth: int = 8) -> np.ndarray:
    """One channel, by its own compression."""
    wide = codecs.psd_row(w, depth)
    if w == 0 or h == 0:
        return np.zeros((h, w), np.uint8)
    how, body = struct.unpack(">H", raw[:2])[0], raw[2:]
    if how == 0:
        out = body
    elif how == 1:
        counts = struct.unpack(f">{h}H", body[: 2 * h])
        at, rows = 2 * h, []
        for c in counts:
            rows.append(codecs.unpack_bits(body[at : at + c], wide))
            at += c
        out = b"".join(rows)
    elif how in (2, 3):
        out = codecs.inflate(body)
    else:
        raise FormatError("channel compression is not supported")
    if len(out) < wide * h:
        raise FormatError("channel data is short")
    return codecs.psd_samples(out, w, h, depth, how == 3)


def _packed(plane: np.ndarray, packed: bool) -> bytes:
    if not packed:
        return b"\0\0" + plane.tobytes()
    rows = [codecs.pack_bits(r.tobytes()) for r in plane]
    return b"\0\1" + struct.pack(f">{len(rows)}H", *map(len, rows)) + b"".join(rows)


def _pascal(name: str) -> bytes:
    raw = name.encode("ascii", "replace")[:255]
    return (bytes((len(raw),)) + raw).ljust(-(-(len(raw) + 1) // 4) * 4, b"\0")


def _block(key: bytes, data: bytes) -> bytes:
    data += b"\0" * (len(data) % 2)
    return b"8BIM" + key + struct.pack(">I", len(data)) + data


def encode(w: int, h: int, layers: list[Record], merged: bytes | None = None, packed: bool = True) -> bytes:
    """A layered document; ``merged`` is its flattened RGBA (clear where not given)."""
    codecs.check_size(w, h)
    heads, bodies = [], []
    for r in _swapped(layers):
        group, end = r.kind == "group", r.kind == "end"
        planes = {}
        if r.kind == "paint" and r.w and r.h:
            px = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
            planes = {-1: px[:, :, 3], 0: px[:, :, 0], 1: px[:, :, 1], 2: px[:, :, 2]}
            if r.mask is not None:
                planes[-2] = np.frombuffer(r.mask, np.uint8).reshape(r.h, r.w)
        else:
            planes = dict.fromkeys((-1, 0, 1, 2), np.zeros((0, 0), np.uint8))
        data = {k: _packed(v, packed) if v.size else b"\0\0" for k, v in planes.items()}
        box = struct.pack(">4i", r.y, r.x, r.y + r.h, r.x + r.w) if r.kind == "paint" else bytes(16)
        head = box + struct.pack(">H", len(data)) + b"".join(struct.pack(">hI", k, len(v)) for k, v in data.items())
        flags = (0 if r.visible else 2) | (16 if r.kind != "paint" else 0)
        head += b"8BIM" + MODE_KEYS[r.mode].encode() + struct.pack(">4B", round(r.opacity * 255), int(r.clip), flags, 0)
        mask = struct.pack(">4iBBxx", r.y, r.x, r.y + r.h, r.x + r.w, 0, 0) if -2 in data else b""
        extra = struct.pack(">I", len(mask)) + mask + struct.pack(">I", 0) + _pascal(r.name)
        extra += _block(b"luni", struct.pack(">I", len(r.name.encode("utf-16-be")) // 2) + r.name.encode("utf-16-be"))
        if group or end:
            # the marker below the members closes the section, the one above them opens it
            extra += _block(b"lsct", struct.pack(">I", 3 if group else 1))
        if r.adjust:
            extra += _block(*blocks.write_adjustment(r.adjust, r.params))
        if r.style:
            extra += _block(b"lfx2", blocks.write_style(r.style)) + _block(b"lrFX", blocks.write_old_style(r.style))
        if r.box:
            extra += _block(b"vmsk", blocks.write_path_box(r.box, w, h))
        heads.append(head + struct.pack(">I", len(extra)) + extra)
        bodies.append(b"".join(data.values()))
    info = struct.pack(">h", len(heads)) + b"".join(heads) + b"".join(bodies)
    info += b"\0" * (len(info) % 2)
    section = struct.pack(">I", len(info)) + info + struct.pack(">I", 0)
    flat = codecs.psd_encode(w, h, merged or bytes(w * h * 4), packed)
    return flat[:34] + struct.pack(">I", len(section)) + section + flat[38:]


def _swapped(layers: list[Record]) -> list[Record]:
    """Each group's marks with each other's name, mode, opacity and visibility; marks without a partner stay."""
    out, opened = [replace(r) for r in layers], []
    for r in out:
        if r.kind == "group":
            opened.append(r)
        elif r.kind == "end" and opened:
            g = opened.pop()
            for k in ("name", "mode", "opacity", "visible"):
                mine, other = getattr(r, k), getattr(g, k)
                setattr(r, k, other)
                setattr(g, k, mine)
    return out


def decode(data: bytes) -> tuple[int, int, list[Record]]:
    """Width, height and layers, bottom first."""
    head = codecs.psd_header(data)
    codecs.psd_check(head)
    mode, depth = head["mode"], head["depth"]
    palette, _, layer_info, _ = codecs._psd_sections(data)
    section = _Reader(layer_info)
    if not section.data or section.num("I")[0] == 0:
        return head["width"], head["height"], []
    count = abs(section.num("h")[0])
    found = [_record(section, head["width"], head["height"]) for _ in range(count)]
    used = codecs.PSD_PLANES[mode]
    for r, channels, box in found:
        planes = {}
        for k, n in channels:
            w, h = box if k == -2 and box else (r.w, r.h)
            planes[k] = _plane(section.take(n), w, h, depth)
        if r.kind == "paint":
            px = np.full((r.h, r.w, 4), 255, np.uint8)
            if all(k in planes for k in range(used)) and px.size:
                px[:, :, :3] = codecs.psd_colours(np.stack([planes[k] for k in range(used)]), mode, palette).transpose(1, 2, 0)
            if -1 in planes:
                px[:, :, 3] = planes[-1]
            r.rgba = px.tobytes()
            if -2 in planes:
                r.mask = planes[-2].tobytes()
    return head["width"], head["height"], _swapped([r for r, _, _ in found])


def _record(s: _Reader, width: int, height: int) -> tuple[Record, list[tuple[int, int]], tuple[int, int] | None]:
    top, left, bottom, right, n = s.num("4iH")
    if bottom < top or right < left:
        raise FormatError("bad layer box")
    if bottom > top and right > left:
        codecs.check_size(right - left, bottom - top)
    channels = [s.num("hI") for _ in range(n)]
    if s.take(4) != b"8BIM":
        raise FormatError("bad layer record")
    mode = s.take(4).decode("latin-1")
    opacity, clip, flags, _ = s.num("4B")
    extra = _Reader(s.take(s.num("I")[0]))
    mask = _Reader(extra.take(extra.num("I")[0]))
    box = None
    if len(mask.data) >= 16:
        t, le, b, r = mask.num("4i")
        box = (max(0, r - le), max(0, b - t))
    extra.take(extra.num("I")[0])
    size = extra.num("B")[0]
    name = extra.take(size).decode("latin-1")
    extra.take(-(size + 1) % 4)
    kind, folded, adjust, styles, path = "paint", False, None, {}, None
    while extra.at + 12 <= len(extra.data):
        extra.take(4)
        key, n = extra.take(4), extra.num("I")[0]
        body = extra.take(n)
        extra.take(min(n % 2, len(extra.data) - extra.at))
        if key == b"luni":
            chars = struct.unpack(">I", body[:4])[0]
            name = body[4 : 4 + 2 * chars].decode("utf-16-be", "replace").rstrip("\0")
        elif key == b"lsct":
            mark = struct.unpack(">I", body[:4])[0]
            kind, folded = {3: "group", 1: "end", 2: "end"}.get(mark, "paint"), mark == 2
        elif key in (b"lfx2", b"lmfx"):
            styles = blocks.read_style(body) or styles
        elif key == b"lrFX":
            styles = styles or blocks.read_old_style(body)
        elif key in (b"vmsk", b"vsms"):
            path = blocks.read_path_box(body, width, height) or path
        else:
            adjust = blocks.read_adjustment(key, body) or adjust
    if adjust and kind == "paint":
        kind = "adjust"
    if path and (path[0] >= path[2] or path[1] >= path[3]):
        path = None
    out = Record(name, kind, _MODES.get(mode, "normal"), opacity / 255, not (flags & 2 or folded), bool(clip), left, top, right - left, bottom - top)
    out.adjust, out.params = adjust or (None, {})
    out.style, out.box = styles, path
    return out, channels, box


LAYERS = (
    "path string, z int, name string, kind string, mode string, opacity double, visible boolean, clip boolean, x int, y int, w int, h int, data binary, mask binary, "
    "adjust string, params string, style string, box array<int>, error string"
)


def read_layers(files: DataFrame) -> DataFrame:
    """A row for each layer of each file (path, content), bottom first; a damaged file gives one row with its error.

    ``params`` and ``style`` are JSON (``parse_json`` makes variants of them);
    ``box`` is left, top, right and bottom of a vector mask.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = []
                try:
                    for z, r in enumerate(decode(bytes(content))[2]):
                        more = (r.adjust, json.dumps(r.params) if r.adjust else None, json.dumps(r.style) if r.style else None, list(r.box) if r.box else None)
                        rows.append((path, z, r.name, r.kind, r.mode, r.opacity, r.visible, r.clip, r.x, r.y, r.w, r.h, r.rgba, r.mask, *more, None))
                except (FormatError, struct.error, IndexError, ValueError, zlib.error) as e:
                    rows = [(path, *[None] * 17, str(e))]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in LAYERS.split(", ")])
                yield out.astype({c: "Int32" for c in ("z", "x", "y", "w", "h")} | {"opacity": "Float64", "visible": "boolean", "clip": "boolean"})

    return files.select("path", "content").mapInPandas(run, LAYERS)


def stack(layers: list) -> list[Layer]:
    """The layers of one document (records, or rows of ``read_layers``), as ``composite.flatten`` takes them."""
    out = []
    for z, r in enumerate(layers):
        params = r.params if isinstance(r.params, dict) else json.loads(r.params or "{}")
        curve = params.get("table") or (A.spline_table(params["points"]) if "points" in params else None)
        params = dict.fromkeys(("tr", "tg", "tb"), curve) if curve else params
        out.append(Layer(z, r.mode, r.opacity, r.visible, clip=r.clip, masked=r.mask is not None, vector_masked=r.box is not None, kind=r.kind, adjust=r.adjust, params=params))
    return out


def layer_pixels(layers: DataFrame) -> DataFrame:
    """(path, x, y, z, r, g, b, a) on the document's canvas, clear pixels left out; a row of bytes at a time."""
    line = F.substring("data", F.col("j") * F.col("w") * 4 + 1, F.col("w") * 4)
    rows = layers.filter("kind = 'paint' AND w > 0 AND h > 0").select("path", "z", "x", "y", "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j"))
    rows = rows.select("path", "z", "x", (F.col("y") + F.col("j")).alias("y"), "w", line.alias("line"))
    px = rows.select("path", "z", "x", "y", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("i"))
    byte = lambda k: F.expr(f"CAST(conv(hex(substring(line, i * 4 + {k + 1}, 1)), 16, 10) AS INT)")
    return px.select("path", (F.col("x") + F.col("i")).alias("x"), "y", "z", *[byte(k).alias(c) for k, c in enumerate("rgba")]).filter("a > 0")


def vector_regions(layers: DataFrame, w: int, h: int) -> DataFrame:
    """(path, x, y, z): members of the layers' vector masks inside the canvas."""
    side = lambda lo, hi, n: F.explode(F.sequence(F.greatest(F.lit(0), F.col("box")[lo]), F.least(F.lit(n), F.col("box")[hi]) - 1))
    inside = layers.filter(f"box IS NOT NULL AND greatest(0, box[0]) < least({w}, box[2]) AND greatest(0, box[1]) < least({h}, box[3])")
    return inside.withColumn("vx", side(0, 2, w)).withColumn("vy", side(1, 3, h)).select("path", F.col("vx").alias("x"), F.col("vy").alias("y"), "z")


def from_images(files: DataFrame, key: str = "doc_id", packed: bool = True) -> DataFrame:
    """(key, content): one layered document of each key's images (key, z, name, mode, opacity, content), bottom first.

    The canvas is as large as the largest image. One task builds a document; a
    document's images together are bounded by the format's size limits.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = []
        for r in pdf.sort_values(["z", "name"]).itertuples():
            w, h, rgba = codecs.decode(bytes(r.content))
            records.append(Record(r.name, mode=r.mode, opacity=r.opacity, w=w, h=h, rgba=rgba))
        size = max(r.w for r in records), max(r.h for r in records)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(*size, records, packed=packed)]})

    return files.select(key, "z", "name", "mode", "opacity", "content").groupBy(key).applyInPandas(run, f"{key} {dict(files.dtypes)[key]}, content binary")
