"""Tagged blocks of layered documents, from the public format description.

Descriptors (typed trees), layer styles (as a descriptor, and in the older form
of fixed records), adjustment layers and vector masks. Each has a reader and a
writer. A tree becomes JSON, so that Spark holds it as a variant.

Numbers in files and in ``functions.adjust`` differ in scale for brightness,
contrast and vibrance: files hold whole hundredths.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass, field
from typing import Any

from .codecs import FormatError

#: Objects within objects that a descriptor may hold.
DEEPEST = 32


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise FormatError("layer data is short")
        self.at += n
        return out

    def num(self, form: str) -> tuple:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))

    def key(self) -> str:
        n = self.num("I")[0]
        return self.take(n or 4).decode("latin-1")

    def text(self) -> str:
        n = self.num("I")[0]
        return self.take(2 * n).decode("utf-16-be", "replace").rstrip("\0")


# -- descriptors ----------------------------------------------------------------------------


@dataclass
class Tree:
    """An object: a class and named values."""

    kind: str
    items: dict[str, Any] = field(default_factory=dict)
    name: str = ""


@dataclass(frozen=True)
class Unit:
    unit: str
    value: float


@dataclass(frozen=True)
class Choice:
    """A value of an enumeration."""

    kind: str
    value: str


@dataclass(frozen=True)
class Kind:
    """A class as a value."""

    name: str
    kind: str


def read_tree(s: Reader, depth: int = 0) -> Tree:
    if depth > DEEPEST:
        raise FormatError("descriptor is too deep")
    out = Tree(name=s.text(), kind=s.key())
    for _ in range(s.num("I")[0]):
        key = s.key()
        out.items[key] = _read_value(s, depth)
    return out


def _read_value(s: Reader, depth: int) -> Any:
    kind = s.take(4).decode("latin-1")
    if kind in ("Objc", "GlbO"):
        return read_tree(s, depth + 1)
    if kind == "VlLs":
        if depth > DEEPEST:
            raise FormatError("descriptor is too deep")
        return [_read_value(s, depth + 1) for _ in range(s.num("I")[0])]
    plain = {"long": "i", "doub": "d", "comp": "q"}
    if kind in plain:
        return s.num(plain[kind])[0]
    if kind == "bool":
        return s.num("B")[0] != 0
    if kind == "TEXT":
        return s.text()
    if kind == "UntF":
        return Unit(s.take(4).decode("latin-1"), s.num("d")[0])
    if kind == "enum":
        return Choice(s.key(), s.key())
    if kind in ("Clss", "type"):
        return Kind(s.text(), s.key())
    raise FormatError(f"descriptor value {kind!r} is not supported")


def _key(k: str) -> bytes:
    raw = k.encode("latin-1")
    return (struct.pack(">I", 0 if len(raw) == 4 else len(raw))) + raw


def _text(t: str) -> bytes:
    raw = (t + "\0").encode("utf-16-be")
    return struct.pack(">I", len(raw) // 2) + raw


def write_tree(t: Tree) -> bytes:
    return _text(t.name) + _key(t.kind) + struct.pack(">I", len(t.items)) + b"".join(_key(k) + _value(v) for k, v in t.items.items())


def _value(v: Any) -> bytes:
    if isinstance(v, bool):
        return b"bool" + bytes([v])
    if isinstance(v, int):
        return b"long" + struct.pack(">i", v) if -(1 << 31) <= v < 1 << 31 else b"comp" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"doub" + struct.pack(">d", v)
    if isinstance(v, str):
        return b"TEXT" + _text(v)
    if isinstance(v, Unit):
        return b"UntF" + v.unit.encode("latin-1") + struct.pack(">d", v.value)
    if isinstance(v, Choice):
        return b"enum" + _key(v.kind) + _key(v.value)
    if isinstance(v, Kind):
        return b"type" + _text(v.name) + _key(v.kind)
    if isinstance(v, Tree):
        return b"Objc" + write_tree(v)
    return b"VlLs" + struct.pack(">I", len(v)) + b"".join(map(_value, v))


def read_descriptor(data: bytes) -> Tree:
    """A descriptor behind its two version numbers."""
    s = Reader(data)
    s.num("II")
    return read_tree(s)


def write_descriptor(t: Tree) -> bytes:
    return struct.pack(">II", 0, 16) + write_tree(t)


def to_json(v: Any) -> str:
    """A tree for ``parse_json``: an object's class is ``_class``, units and choices are objects of two fields."""

    def plain(v: Any) -> Any:
        if isinstance(v, Tree):
            return {"_class": v.kind} | ({"_name": v.name} if v.name else {}) | {k.strip(): plain(x) for k, x in v.items.items()}
        if isinstance(v, Unit):
            return {"unit": v.unit, "value": plain(v.value)}
        if isinstance(v, Choice):
            return {"enum": v.kind.strip(), "value": v.value.strip()}
        if isinstance(v, Kind):
            return {"name": v.name, "class": v.kind.strip()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(plain(v))


# -- layer styles ---------------------------------------------------------------------------

#: Blend modes as descriptors name them, in the files' own naming of the two burns and dodges.
STYLE_MODES = {
    "Nrml": "normal",
    "Mltp": "multiply",
    "Scrn": "screen",
    "Ovrl": "overlay",
    "Drkn": "darken",
    "Lghn": "lighten",
    "CBrn": "colorDodge",
    "idiv": "colorBurn",
    "lddg": "linearDodge",
    "lbrn": "linearBurn",
    "SftL": "softLight",
    "HrdL": "hardLight",
    "Dfrn": "difference",
    "Xclu": "exclusion",
    "hue": "hue",
    "sat": "saturation",
    "colr": "color",
    "Lmns": "luminosity",
}
_STYLE_KEYS = {v: k for k, v in STYLE_MODES.items()}
#: Where a stroke lies.
STROKE_AT = {"OutF": "outside", "InsF": "inside", "CtrF": "center"}
_STROKE_KEYS = {v: k for k, v in STROKE_AT.items()}


def _first(tree: Tree, *keys: str) -> Tree | None:
    """The last object under any of the keys: later ones win."""
    found = [x for k in keys for v in [tree.items.get(k)] for x in (v if isinstance(v, list) else [v]) if isinstance(x, Tree)]
    return found[-1] if found else None


def _number(t: Tree, key: str, default: float) -> float:
    v = t.items.get(key)
    if isinstance(v, Unit):
        return v.value
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def _common(t: Tree, mode: str, colour: tuple[int, int, int]) -> dict[str, Any]:
    picked, c, on = t.items.get("Md  "), t.items.get("Clr "), t.items.get("enab")
    parts = [c.items.get(k) for k in ("Rd  ", "Grn ", "Bl  ")] if isinstance(c, Tree) else []
    parts = [p if isinstance(p, (int, float)) else None for p in parts]
    return {
        "color": [p or 0 for p in parts] if any(p is not None for p in parts) else list(colour),
        "opacity": _number(t, "Opct", 100) / 100,
        "mode": STYLE_MODES.get(picked.value.strip() if isinstance(picked, Choice) else mode, "normal"),
        "enabled": on if isinstance(on, bool) else True,
    }


def _offset(angle: float, distance: float) -> dict[str, float]:
    return {"angle": angle, "distance": distance, "dx": math.cos(math.radians(angle)) * distance, "dy": math.sin(math.radians(angle)) * distance}


def read_style(data: bytes) -> dict[str, dict[str, Any]]:
    """Shadow, stroke and overlay of a layer; an unreadable descriptor is no style."""
    try:
        tree = read_descriptor(data)
    except (FormatError, struct.error, UnicodeDecodeError):
        return {}
    out = {}
    if (t := _first(tree, "DrSh", "IrSh")) is not None:
        out["drop_shadow"] = _common(t, "Mltp", (0, 0, 0)) | _offset(_number(t, "lagl", 0), _number(t, "Dstn", 0)) | {"blur": _number(t, "blur", 0), "spread": _number(t, "Ckmt", 0)}
    if (t := _first(tree, "FrFX")) is not None:
        at = t.items.get("Styl")
        out["stroke"] = _common(t, "Nrml", (0, 0, 0)) | {"size": _number(t, "Sz  ", 1), "position": STROKE_AT.get(at.value if isinstance(at, Choice) else "OutF", "outside")}
    if (t := _first(tree, "SoFi")) is not None:
        out["color_overlay"] = _common(t, "Nrml", (255, 0, 0))
    return out


def write_style(style: dict[str, dict[str, Any]]) -> bytes:
    """The descriptor of a style."""

    def effect(kind: str, s: dict[str, Any], mode: str, **more: Any) -> Tree:
        colour = Tree("RGBC", {k: float(v) for k, v in zip(("Rd  ", "Grn ", "Bl  "), s.get("color", (0, 0, 0)))})
        return Tree(kind, {"enab": s.get("enabled", True), "Md  ": Choice("BlnM", _STYLE_KEYS.get(s.get("mode", mode), "Nrml")), "Clr ": colour, "Opct": Unit("#Prc", float(round(s.get("opacity", 1) * 100))), **more})

    out = Tree("Lefx", {"Scl ": Unit("#Prc", 100.0), "masterFXSwitch": True})
    if s := style.get("drop_shadow"):
        more = {"lagl": Unit("#Ang", float(s.get("angle", 0))), "Dstn": Unit("#Pxl", float(s.get("distance", 0))), "Ckmt": Unit("#Pxl", float(s.get("spread", 0))), "blur": Unit("#Pxl", float(s.get("blur", 0)))}
        out.items["DrSh"] = effect("DrSh", s, "multiply", **more)
    if s := style.get("stroke"):
        out.items["FrFX"] = effect("FrFX", s, "normal", **{"Styl": Choice("FStl", _STROKE_KEYS.get(s.get("position"), "OutF")), "Sz  ": Unit("#Pxl", float(s.get("size", 1)))})
    if s := style.get("color_overlay"):
        out.items["SoFi"] = effect("SoFi", s, "normal")
    return write_descriptor(out)


def read_old_style(data: bytes) -> dict[str, dict[str, Any]]:
    """The older records: shadow and overlay, numbers as 16.16, colours of 16 bits."""
    out: dict[str, dict[str, Any]] = {}
    try:
        s = Reader(data)
        for _ in range(s.num("2H")[1]):
            key, n = s.num("4x4sI")
            body = s.take(n)
            colour = lambda at, body=body: [math.floor(v / 257 + 0.5) for v in struct.unpack(">3H", body[at + 2 : at + 8])]
            if key in (b"dsdw", b"isdw"):
                blur, angle, distance = (v / 65536 for v in struct.unpack(">I4xII", body[4:20]))
                out["drop_shadow"] = {"color": colour(20), "opacity": body[40] / 255, "blur": blur, "spread": 0.0, **_offset(angle, distance)}
            elif key == b"sofi":
                out["color_overlay"] = {"color": colour(12), "opacity": body[22] / 255}
    except (FormatError, struct.error, IndexError):
        return {}
    return out


def write_old_style(style: dict[str, dict[str, Any]]) -> bytes:
    fixed = lambda v: struct.pack(">I", round(v * 65536))
    colour = lambda s: struct.pack(">5H", 0, *[round(v) * 257 for v in s.get("color", (0, 0, 0))], 0)
    opacity = lambda s: bytes([round(s.get("opacity", 1) * 255)])
    records = []
    if s := style.get("drop_shadow"):
        numbers = fixed(s.get("blur", 0)) + bytes(4) + fixed(s.get("angle", 0) % 360) + fixed(s.get("distance", 0))
        records.append((b"dsdw", bytes(4) + numbers + colour(s) + b"8BIMmul " + b"\1\0" + opacity(s) + colour(s)))
    if s := style.get("color_overlay"):
        records.append((b"sofi", struct.pack(">I", 2) + b"8BIMnorm" + colour(s) + opacity(s) + b"\1" + colour(s)))
    return struct.pack(">2H", 0, len(records)) + b"".join(b"8BIM" + k + struct.pack(">I", len(b)) + b for k, b in records)


# -- adjustments ----------------------------------------------------------------------------


def read_adjustment(key: bytes, data: bytes) -> tuple[str, dict[str, Any]] | None:
    """Name and parameters as ``functions.adjust`` takes them; None where the block is no adjustment."""
    s = Reader(data)
    if key == b"nvrt":
        return "invert", {}
    if key == b"gryc":
        return "grayscale", {}
    if key == b"thrs":
        return "threshold", {"at": s.num("2H")[1] if len(data) >= 4 else s.num("H")[0]}
    if key == b"brit":
        b, c = s.num("2h")
        return "brightness", {"brightness": b / 100, "contrast": c / 100}
    if key == b"hue2":
        return "hue", dict(zip(("hue", "sat", "light"), map(float, s.num("3h"))))
    if key == b"levl":
        low, high, gamma = s.num("2H12xH")
        return "levels", {"shadows": low, "highlights": high, "gamma": gamma / 100 or 1.0}
    if key == b"expA":
        return "exposure", {"ev": s.num("i")[0] / 65536}
    if key == b"vibr":
        return "vibrance", {"amount": s.num("h")[0] / 100}
    if key == b"curv":
        mapped, version, bits = s.num("BHI")
        if not (bits.bit_count() if version == 1 else bits):
            return None
        if mapped:
            return "curves", {"table": list(s.take(256))}
        points = [(x, y) for y, x in (s.num("2H") for _ in range(s.num("H")[0]))]
        return "curves", {"points": points if len(points) >= 2 else [(0, 0), (255, 255)]}
    return None


def write_adjustment(name: str, p: dict[str, Any]) -> tuple[bytes, bytes]:
    pack = struct.pack
    return {
        "invert": lambda: (b"nvrt", b""),
        "grayscale": lambda: (b"gryc", b""),
        "threshold": lambda: (b"thrs", pack(">2H", 1, p.get("at", 128))),
        "brightness": lambda: (b"brit", pack(">4h", round(p.get("brightness", 0) * 100), round(p.get("contrast", 0) * 100), 0, 0)),
        "hue": lambda: (b"hue2", pack(">4h4x", *[round(p.get(k, 0)) for k in ("hue", "sat", "light")], 0)),
        "levels": lambda: (b"levl", pack(">2H", p.get("shadows", 0), p.get("highlights", 255)) * 4 + pack(">3H", round(p.get("gamma", 1) * 100), 0, 0)),
        "exposure": lambda: (b"expA", pack(">i8x", round(p.get("ev", 0) * 65536))),
        "vibrance": lambda: (b"vibr", pack(">2h", round(p.get("amount", 0) * 100), 0)),
        "curves": lambda: (b"curv", pack(">BHIH", 0, 1, 1, len(p["points"])) + b"".join(pack(">2H", y, x) for x, y in p["points"])),
    }[name]()


# -- vector masks ---------------------------------------------------------------------------

#: Selectors of path records that are knots, linked or not, of closed and open paths.
KNOTS = (1, 2, 4, 5)


def read_path_box(data: bytes, w: int, h: int) -> tuple[int, int, int, int] | None:
    """Left, top, right and bottom of a path's knots and handles, stored as 8.24 fractions of the document."""
    xs, ys = [], []
    for at in range(8, len(data) - 25, 26):
        if struct.unpack(">H", data[at : at + 2])[0] in KNOTS:
            v = struct.unpack(">6i", data[at + 2 : at + 26])
            for y, x in zip(v[::2], v[1::2]):
                if x or y:
                    xs.append(x / (1 << 24) * w)
                    ys.append(y / (1 << 24) * h)
    return (math.floor(min(xs)), math.floor(min(ys)), math.ceil(max(xs)), math.ceil(max(ys))) if xs else None


def write_path_box(box: tuple[int, int, int, int], w: int, h: int) -> bytes:
    """A closed rectangle; fractions round inwards, so that a reader's rounding outwards gives the box back."""
    left, right = -(-box[0] * (1 << 24) // w), box[2] * (1 << 24) // w
    top, bottom = -(-box[1] * (1 << 24) // h), box[3] * (1 << 24) // h
    knots = [struct.pack(">H6i", 1, *[y, x] * 3) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]
    return struct.pack(">II", 3, 0) + struct.pack(">H24x", 6) + struct.pack(">HHhH18x", 0, len(knots), 1, 1) + b"".join(knots)
