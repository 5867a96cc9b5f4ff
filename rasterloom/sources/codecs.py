"""Image codecs over bytes, written from the public format descriptions.

A decoded image is (width, height, RGBA bytes). Decoders refuse images beyond
the size limits before they allocate anything.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAX_EDGE, MAX_PIXELS = 32_768, 100_000_000
#: Decompressed data beyond this is refused.
MAX_INFLATED = 256 << 20

Image = tuple[int, int, bytes]


class FormatError(ValueError):
    pass


def check_size(w: int, h: int) -> None:
    if w <= 0 or h <= 0 or w > MAX_EDGE or h > MAX_EDGE or w * h > MAX_PIXELS:
        raise FormatError(f"size {w} x {h} is out of range")


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MAX_INFLATED)
    if d.unconsumed_tail:
        raise FormatError("too much data")
    return out


#: Leading bytes of each format.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "png"),
    (b"\xff\xd8\xff", "jpeg"),
    (b"BM", "bmp"),
    (b"qoif", "qoi"),
    (b"8BPS", "psd"),
    (b"GIF8", "gif"),
    (b"II*\x00", "tiff"),
    (b"MM\x00*", "tiff"),
)


def sniff(data: bytes) -> str | None:
    """Format by leading bytes."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return next((name for magic, name in MAGIC if data.startswith(magic)), None)


# -- PackBits, LZW, predictor ------------------------------------------------------


def unpack_bits(data: bytes, size: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (size is None or len(out) < size):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out if size is None else out[:size])


def pack_bits(data: bytes, shortest: int = 2) -> bytes:
    """Runs of at least ``shortest`` equal bytes are packed, the rest copied."""
    out, i, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        while plain:
            part = plain[:128]
            out.append(len(part) - 1)
            out.extend(part)
            del plain[:128]

    while i < len(data):
        j = i
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= shortest:
            flush()
            out += bytes((257 - (j - i), data[i]))
            i = j
        else:
            plain.append(data[i])
            i += 1
    flush()
    return bytes(out)


def un_lzw(data: bytes) -> bytes:
    """Most significant bit first, codes widen one early."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held & (1 << width) - 1
            bits &= (1 << held) - 1
            if code == end:
                return bytes(out)
            if code == clear:
                table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
                continue
            if not table:
                raise FormatError("LZW data starts without a clear code")
            if code < len(table):
                entry = table[code]
            elif last:
                entry = last + last[:1]
            else:
                raise FormatError("bad LZW code")
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + (len(table) + 1 >= 512) + (len(table) + 1 >= 1024) + (len(table) + 1 >= 2048)
    return bytes(out)


def delta_encode(rows: np.ndarray) -> np.ndarray:
    """Each byte less the one before it in its row, modulo 256."""
    return np.diff(rows, axis=1, prepend=np.uint8(0)).astype(np.uint8)


def delta_decode(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=np.uint8)


# -- PNG ------------------------------------------------------------------------------


def png_decode(data: bytes) -> Image:
    if not data.startswith(MAGIC[0][0]):
        raise FormatError("not a PNG")
    at, parts, head, palette, clear = 8, [], None, b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    if head is None:
        raise FormatError("no header")
    w, h, depth, kind, _, _, interlace = head
    check_size(w, h)
    if interlace:
        raise FormatError("interlaced PNG is not supported")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if samples is None or depth not in (1, 2, 4, 8, 16):
        raise FormatError("bad colour type or depth")
    stride, step = (w * samples * depth + 7) // 8, max(1, samples * depth // 8)
    raw = np.frombuffer(inflate(b"".join(parts)), np.uint8)
    if len(raw) < h * (stride + 1):
        raise FormatError("image data is short")
    rows = raw[: h * (stride + 1)].reshape(h, stride + 1)
    v = _samples(_unfilter(rows, stride, step), w, samples, depth)
    return w, h, _png_rgba(v, kind, depth, palette, clear).tobytes()


def _unfilter(rows: np.ndarray, stride: int, step: int) -> np.ndarray:
    out, up = np.zeros((len(rows), stride), np.uint8), np.zeros(stride, np.uint8)
    for y, row in enumerate(rows):
        f, line = row[0], row[1:].copy()
        if f == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            line = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif f == 2:
            line = line + up
        elif f in (3, 4):
            line = _by_byte(line, up, step, int(f))
        elif f:
            raise FormatError("bad filter")
        out[y] = up = line
    return out


def _by_byte(line: np.ndarray, up: np.ndarray, step: int, f: int) -> np.ndarray:
    cur, above = line.tolist(), up.tolist()
    for i in range(len(cur)):
        a, b = (cur[i - step] if i >= step else 0), above[i]
        if f == 3:
            cur[i] = (cur[i] + (a + b) // 2) & 255
        else:
            c = above[i - step] if i >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            cur[i] = (cur[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.array(cur, np.uint8)


def _samples(rows: np.ndarray, w: int, samples: int, depth: int) -> np.ndarray:
    """(h, w, samples) as stored values."""
    n = w * samples
    if depth == 8:
        v = rows
    elif depth == 16:
        v = rows.reshape(len(rows), n, 2).astype(np.uint16)
        v = v[:, :, 0] << 8 | v[:, :, 1]
    else:
        bits = np.unpackbits(rows, axis=1)[:, : n * depth].reshape(len(rows), n, depth)
        v = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)
    return v[:, :n].reshape(len(rows), w, samples).astype(np.uint16)


def _png_rgba(v: np.ndarray, kind: int, depth: int, palette: bytes, clear: bytes) -> np.ndarray:
    h, w = v.shape[:2]
    out = np.full((h, w, 4), 255, np.uint8)
    byte = (v >> 8 if depth == 16 else v * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if kind == 3:
        table = np.zeros((256, 4), np.uint8)
        rgb = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        table[: len(rgb), :3], table[:, 3] = rgb, 255
        table[: len(clear), 3] = np.frombuffer(clear[:256], np.uint8)
        return table[v[:, :, 0]]
    out[:, :, :3] = byte[:, :, :3] if kind in (2, 6) else byte[:, :, :1]
    if kind in (4, 6):
        out[:, :, 3] = byte[:, :, -1]
    elif clear:
        key = np.array(struct.unpack(f">{len(clear) // 2}H", clear[: len(clear) // 2 * 2]), np.uint16)
        out[:, :, 3] = np.where((v[:, :, : len(key)] == key).all(axis=2), 0, 255)
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(w: int, h: int, rgba: bytes, icc: bytes | None = None) -> bytes:
    """Eight bits RGBA, every row as its difference to the one above."""
    check_size(w, h)
    rows = np.frombuffer(rgba, np.uint8).reshape(h, w * 4)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, w * 4), np.uint8)).astype(np.uint8)
    body = np.concatenate((np.full((h, 1), 2, np.uint8), up), axis=1).tobytes()
    extra = _chunk(b"iCCP", b"ICC\0\0" + zlib.compress(icc)) if icc else b""
    gamma = _chunk(b"gAMA", struct.pack(">I", 45455))
    return MAGIC[0][0] + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + extra + gamma + _chunk(b"IDAT", zlib.compress(body)) + _chunk(b"IEND", b"")


# -- BMP ------------------------------------------------------------------------------


def bmp_decode(data: bytes) -> Image:
    if data[:2] != b"BM" or len(data) < 54:
        raise FormatError("not a BMP")
    start, _, w, h, _, bits, how = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or how not in (0, 3):
        raise FormatError("only 24 and 32 bit BMP without compression")
    check_size(w, abs(h))
    n = bits // 8
    stride = (w * n + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, offset=start)
    if len(raw) < stride * abs(h):
        raise FormatError("image data is short")
    rows = raw[: stride * abs(h)].reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    rows = rows[::-1] if h > 0 else rows
    out = np.full((abs(h), w, 4), 255, np.uint8)
    out[:, :, :3] = rows[:, :, 2::-1]
    if n == 4:
        out[:, :, 3] = rows[:, :, 3]
    return w, abs(h), out.tobytes()


def bmp_encode(w: int, h: int, rgba: bytes) -> bytes:
    check_size(w, h)
    px = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[::-1, :, [2, 1, 0, 3]].tobytes()
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 32, 0, len(px), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(px), 0, 0, 54) + head + px


# -- QOI ------------------------------------------------------------------------------


def _slot(p: tuple[int, int, int, int]) -> int:
    return (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64


def qoi_encode(w: int, h: int, rgba: bytes) -> bytes:
    check_size(w, h)
    out, seen, last, run = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, 4, 0)), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    px = list(struct.iter_unpack("4B", rgba))
    for k, p in enumerate(px):
        if p == last:
            run += 1
            if run == 62 or k == len(px) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        i = _slot(p)
        if seen[i] == p:
            out.append(i)
        elif p[3] != last[3]:
            out += bytes((0xFF, *p))
        else:
            dr, dg, db = ((p[c] - last[c] + 128) % 256 - 128 for c in range(3))
            if all(-2 <= d <= 1 for d in (dr, dg, db)):
                out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((0xFE, *p[:3]))
        seen[i] = last = p
    return bytes(out) + bytes(7) + b"\x01"


def qoi_decode(data: bytes) -> Image:
    if data[:4] != b"qoif" or len(data) < 22:
        raise FormatError("not a QOI")
    w, h = struct.unpack(">II", data[4:12])
    check_size(w, h)
    out, seen, p, i, need = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, w * h * 4
    while len(out) < need:
        if i >= len(data) - 8:
            raise FormatError("image data is short")
        b = data[i]
        i += 1
        n = 1
        if b == 0xFE:
            p, i = (*data[i : i + 3], p[3]), i + 3
        elif b == 0xFF:
            p, i = tuple(data[i : i + 4]), i + 4
        elif b >> 6 == 0:
            p = seen[b]
        elif b >> 6 == 1:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b >> 6 == 2:
            g, c = (b & 63) - 32, data[i]
            i += 1
            p = ((p[0] + g + (c >> 4) - 8) & 255, (p[1] + g) & 255, (p[2] + g + (c & 15) - 8) & 255, p[3])
        else:
            n = (b & 63) + 1
        seen[_slot(p)] = p
        out += bytes(p) * n
    return w, h, bytes(out[:need])


# -- TIFF -----------------------------------------------------------------------------

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first directory."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(data[:4])
    if order is None:
        raise FormatError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = _SIZES.get(kind, 1) * n
        where = at + 10 + 12 * k
        if size > 4:
            where = struct.unpack(order + "I", data[where : where + 4])[0]
        raw = data[where : where + size]
        out[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw) if kind in _CODES else (raw,)
    return order, out


def tiff_decode(data: bytes) -> Image:
    order, t = tiff_tags(data)
    w, h = t[256][0], t[257][0]
    check_size(w, h)
    depth, samples, how, photo, predictor = t.get(258, (1,))[0], t.get(277, (1,))[0], t.get(259, (1,))[0], t.get(262, (1,))[0], t.get(317, (1,))[0]
    if depth not in (8, 16) or t.get(284, (1,))[0] != 1:
        raise FormatError("only chunky 8 and 16 bit TIFF")
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (w, min(h, t.get(278, (h,))[0]))
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    out = np.zeros((h, w, samples), np.uint16)
    across = -(-w // tw)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        x, y = k % across * tw, k // across * th
        rows = th if tiled else min(th, h - y)
        raw = _tiff_block(data[o : o + n], how, rows * tw * samples * depth // 8)
        v = np.frombuffer(raw, np.uint8 if depth == 8 else order + "u2").reshape(rows, tw, samples)
        if predictor == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype)
        out[y : y + rows, x : x + tw] = v[: h - y, : w - x]
    byte = (out >> 8 if depth == 16 else out).astype(np.uint8)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if photo == 3:
        table = (np.array(t[320], np.uint16).reshape(3, -1).T >> 8).astype(np.uint8)
        rgba[:, :, :3] = table[out[:, :, 0]]
    elif photo == 2:
        rgba[:, :, : min(4, samples)] = byte[:, :, :4]
    else:
        grey = byte[:, :, :1] if photo == 1 else 255 - byte[:, :, :1]
        rgba[:, :, :3] = grey
        if samples > 1:
            rgba[:, :, 3] = byte[:, :, 1]
    return w, h, rgba.tobytes()


def _tiff_block(raw: bytes, how: int, size: int) -> bytes:
    if how == 1:
        out = raw
    elif how == 5:
        out = un_lzw(raw)
    elif how == 32773:
        out = unpack_bits(raw, size)
    elif how in (8, 32946):
        out = inflate(raw)
    else:
        raise FormatError(f"TIFF compression {how} is not supported")
    if len(out) < size:
        raise FormatError("image data is short")
    return out[:size]


def tiff_encode(w: int, h: int, rgba: bytes, icc: bytes | None = None) -> bytes:
    """RGBA without compression, one strip."""
    check_size(w, h)
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8, 8, 8, 8)), (259, 3, (1,)), (262, 3, (2,)), (273, 4, (8,)), (277, 3, (4,)), (278, 4, (h,)), (279, 4, (len(rgba),)), (284, 3, (1,)), (338, 3, (2,))]
    body, at, rows = bytearray(rgba), 8 + len(rgba), []
    if icc:
        tags.append((34675, 7, icc))
    for tag, kind, values in tags:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
        if len(raw) > 4:
            rows.append(struct.pack("<HHII", tag, kind, len(values), at))
            body += raw + b"\0" * (len(raw) % 2)
            at += len(raw) + len(raw) % 2
        else:
            rows.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", at) + bytes(body) + struct.pack("<H", len(rows)) + b"".join(rows) + bytes(4)


def is_dng(data: bytes) -> bool:
    """A TIFF that carries the raw-image version tag."""
    try:
        return 50706 in tiff_tags(data)[1]
    except (FormatError, struct.error, KeyError):
        return False


# -- flat PSD ---------------------------------------------------------------------------


def psd_header(data: bytes) -> dict[str, int]:
    if data[:4] != b"8BPS" or len(data) < 26:
        raise FormatError("not a PSD")
    version, channels, h, w, depth, mode = struct.unpack(">H6xHIIHH", data[4:26])
    if version != 1:
        raise FormatError("large documents are not supported")
    check_size(w, h)
    return {"channels": channels, "width": w, "height": h, "depth": depth, "mode": mode}


def _psd_sections(data: bytes) -> list[bytes]:
    at, out = 26, []
    for _ in range(3):
        n = struct.unpack(">I", data[at : at + 4])[0]
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return [*out, data[at:]]


def psd_has_layers(data: bytes) -> bool:
    """Whether the layer section announces any layer."""
    section = _psd_sections(data)[2]
    return len(section) >= 6 and struct.unpack(">I", section[:4])[0] > 0 and struct.unpack(">h", section[4:6])[0] != 0


#: Colour planes of each mode (bitmap, grey, indexed, RGB, CMYK, duotone, Lab), and its depths.
PSD_PLANES = {0: 1, 1: 1, 2: 1, 3: 3, 4: 4, 8: 1, 9: 3}


def psd_check(head: dict[str, int]) -> None:
    if head["mode"] not in PSD_PLANES or head["depth"] not in ((1,) if head["mode"] == 0 else (8, 16, 32)):
        raise FormatError(f"mode {head['mode']} at {head['depth']} bits is not supported")


def psd_row(w: int, depth: int) -> int:
    """Bytes of a row of samples."""
    return -(-w // 8) if depth == 1 else w * depth // 8


def psd_samples(raw: bytes, w: int, rows: int, depth: int, differences: bool = False) -> np.ndarray:
    """Rows of bytes from samples of any depth: the high byte of 16 bits, a clamped fraction of 32; a set bit is black.

    ``differences``: each row holds steps between samples; those of 32 bits are
    steps between bytes, all high bytes of the row first.
    """
    v = np.frombuffer(raw, np.uint8, rows * psd_row(w, depth)).reshape(rows, -1)
    if depth == 1:
        return 255 - 255 * np.unpackbits(v, axis=1)[:, :w]
    if depth == 8:
        return delta_decode(v) if differences else v
    if depth == 16:
        wide = v.view(">u2")
        return ((np.cumsum(wide, axis=1, dtype=np.uint16) if differences else wide) >> 8).astype(np.uint8)
    if differences:
        v = np.ascontiguousarray(delta_decode(v).reshape(rows, 4, w).transpose(0, 2, 1)).reshape(rows, -1)
    f = np.nan_to_num(v.view(">f4").astype(float), nan=0.0, posinf=1.0, neginf=0.0)
    return np.floor(np.clip(f, 0, 1) * 255 + 0.5).astype(np.uint8)


def lab_bytes(planes: np.ndarray) -> np.ndarray:
    """RGB planes from Lab planes, as ``functions.color.lab_to_rgb`` has it."""
    from ..functions import color as K

    light, a, b = planes.astype(float)
    light = light * 100 / 255
    fy = (light + 16) / 116
    fx, fz = fy + (a - 128) / 500, fy - (b - 128) / 200
    back = lambda f: np.where(f**3 > K.LAB_EPSILON, f**3, (116 * f - 16) / K.LAB_KAPPA)
    xyz = np.stack([back(fx), np.where(light > 8, fy**3, light / K.LAB_KAPPA), back(fz)]) * np.array(K.D50)[:, None, None]
    lin = np.clip(np.tensordot(np.array(K.XYZ_TO_RGB), np.tensordot(np.array(K.D50_TO_D65), xyz, 1), 1), 0, 1)
    return np.floor(np.where(lin <= 0.0031308, lin * 12.92, 1.055 * lin ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)


def psd_colours(planes: np.ndarray, mode: int, palette: bytes = b"") -> np.ndarray:
    """(3, h, w) RGB from the colour planes of a mode."""
    if mode == 3:
        return planes
    if mode == 4:
        return np.floor(planes[:3].astype(float) * planes[3] / 255 + 0.5).astype(np.uint8)
    if mode == 9:
        return lab_bytes(planes)
    if mode == 2:
        return np.frombuffer(palette[:768].ljust(768, b"\0"), np.uint8).reshape(3, 256)[:, planes[0]]
    return np.repeat(planes[:1], 3, axis=0)


def psd_decode(data: bytes) -> Image:
    """The merged image: any mode of ``PSD_PLANES``, 1, 8, 16 or 32 bits, raw, run-length or deflated."""
    head = psd_header(data)
    psd_check(head)
    w, h, n, mode, depth = (head[k] for k in ("width", "height", "channels", "mode", "depth"))
    palette, _, _, body = _psd_sections(data)
    how, wide = struct.unpack(">H", body[:2])[0], psd_row(w, depth)
    if how == 0:
        raw = body[2 : 2 + n * h * wide]
    elif how == 1:
        counts = struct.unpack(f">{n * h}H", body[2 : 2 + 2 * n * h])
        at, rows = 2 + 2 * n * h, []
        if at + sum(counts) > len(body):
            raise FormatError("image data is short")
        for c in counts:
            rows.append(unpack_bits(body[at : at + c], wide).ljust(wide, b"\0")[:wide])
            at += c
        raw = b"".join(rows)
    elif how in (2, 3):
        raw = inflate(body[2:])
    else:
        raise FormatError("compression is not supported")
    if len(raw) < n * h * wide or n < PSD_PLANES[mode]:
        raise FormatError("image data is short")
    planes = psd_samples(raw, w, n * h, depth, how == 3).reshape(n, h, w)
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = psd_colours(planes[: PSD_PLANES[mode]], mode, palette).transpose(1, 2, 0)
    if mode != 4 and n > PSD_PLANES[mode]:
        out[:, :, 3] = planes[PSD_PLANES[mode]]
    return w, h, out.tobytes()


def psd_encode(w: int, h: int, rgba: bytes, packed: bool = True) -> bytes:
    """A flat RGBA document."""
    check_size(w, h)
    planes = np.frombuffer(rgba, np.uint8).reshape(h, w, 4).transpose(2, 0, 1)
    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 4, h, w, 8, 3) + struct.pack(">III", 0, 0, 0)
    if not packed:
        return head + b"\0\0" + planes.tobytes()
    rows = [pack_bits(planes[c, y].tobytes()) for c in range(4) for y in range(h)]
    return head + b"\0\1" + struct.pack(f">{len(rows)}H", *map(len, rows)) + b"".join(rows)


# -- colour profiles ----------------------------------------------------------------------


def _s15(v: float) -> bytes:
    return struct.pack(">i", round(v * 65536))


#: sRGB primaries and white adapted to D50, as profiles store them.
PROFILE_WHITE = (0.9642, 1.0, 0.8249)
PROFILE_RGB = {"rXYZ": (0.4360747, 0.2225045, 0.0139322), "gXYZ": (0.3850649, 0.7168786, 0.0971045), "bXYZ": (0.1430804, 0.0606169, 0.7141733)}


def icc_srgb() -> bytes:
    """A version 2 display profile for sRGB, with a sampled transfer curve."""
    from ..functions.color import _linear

    text = b"sRGB"
    desc = b"desc" + bytes(4) + struct.pack(">I", len(text) + 1) + text + b"\0" + bytes(78)
    curve = b"curv" + bytes(4) + struct.pack(">I", 1024) + b"".join(struct.pack(">H", round(_linear(i / 1023) * 65535)) for i in range(1024))
    xyz = lambda v: b"XYZ " + bytes(4) + b"".join(map(_s15, v))
    tags = [(b"desc", desc), (b"cprt", b"text" + bytes(4) + b"Public domain\0"), (b"wtpt", xyz(PROFILE_WHITE)), *((k.encode(), xyz(v)) for k, v in PROFILE_RGB.items()), (b"rTRC", curve)]
    at, table, body, trc = 128 + 4 + 12 * (len(tags) + 2), b"", b"", (0, 0)
    for name, raw in tags:
        table += name + struct.pack(">II", at, len(raw))
        trc = (at, len(raw))
        padded = raw + b"\0" * (-len(raw) % 4)
        body, at = body + padded, at + len(padded)
    table += b"".join(n + struct.pack(">II", *trc) for n in (b"gTRC", b"bTRC"))
    head = struct.pack(">I4sI4s4s4s", at, bytes(4), 0x02100000, b"mntr", b"RGB ", b"XYZ ") + bytes(12) + b"acsp" + bytes(28) + b"".join(map(_s15, PROFILE_WHITE)) + bytes(48)
    return head + struct.pack(">I", len(tags) + 2) + table + body


def icc_describe(data: bytes) -> dict[str, str | int]:
    if len(data) < 132 or data[36:40] != b"acsp":
        raise FormatError("not a colour profile")
    out: dict[str, str | int] = {"size": struct.unpack(">I", data[:4])[0], "class": data[12:16].decode(), "space": data[16:20].decode().strip()}
    for k in range(struct.unpack(">I", data[128:132])[0]):
        name, at, n = struct.unpack(">4sII", data[132 + 12 * k : 144 + 12 * k])
        if name == b"desc" and data[at : at + 4] == b"desc":
            size = struct.unpack(">I", data[at + 8 : at + 12])[0]
            out["description"] = data[at + 12 : at + 11 + size].decode("ascii", "replace")
    return out


def icc_extract(data: bytes) -> bytes | None:
    """The profile inside a PNG, TIFF, JPEG or PSD."""
    kind = sniff(data)
    if kind == "tiff":
        found = tiff_tags(data)[1].get(34675)
        return found[0] if found else None
    if kind == "jpeg":
        return _jpeg_profile(data)
    if kind == "psd":
        return _psd_profile(_psd_sections(data)[1])
    if kind == "png":
        at = 8
        while at + 8 <= len(data):
            n, name = struct.unpack(">I4s", data[at : at + 8])
            if name == b"iCCP":
                body = data[at + 8 : at + 8 + n]
                return inflate(body[body.index(b"\0") + 2 :])
            at += 12 + n
    return None


def _jpeg_profile(data: bytes) -> bytes | None:
    """Parts in application segments, joined in the order of their numbers."""
    parts, at, mark = {}, 2, b"ICC_PROFILE\0"
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        if data[at + 1] == 0xE2 and body.startswith(mark) and len(body) >= len(mark) + 2:
            parts[body[len(mark)]] = body[len(mark) + 2 :]
        at += 2 + n
    return b"".join(parts[k] for k in sorted(parts)) or None


def _psd_profile(resources: bytes) -> bytes | None:
    at = 0
    while at + 12 <= len(resources) and resources[at : at + 4] == b"8BIM":
        name = resources[at + 6] + 1
        start = at + 6 + name + name % 2
        n = struct.unpack(">I", resources[start : start + 4])[0]
        if struct.unpack(">H", resources[at + 4 : at + 6])[0] == 1039:
            return resources[start + 4 : start + 4 + n]
        at = start + 4 + n + n % 2
    return None


DECODERS = {"png": png_decode, "bmp": bmp_decode, "qoi": qoi_decode, "tiff": tiff_decode, "psd": psd_decode}
ENCODERS = {"png": png_encode, "bmp": bmp_encode, "qoi": qoi_encode, "tiff": tiff_encode, "psd": psd_encode}


def decode(data: bytes) -> Image:
    from . import jpeg

    kind = sniff(data)
    known = DECODERS | {"jpeg": jpeg.decode}
    if kind not in known:
        raise FormatError(f"no decoder for {kind or 'unknown data'}")
    try:
        return known[kind](data)
    except (struct.error, IndexError, KeyError, ValueError, zlib.error) as e:
        raise e if isinstance(e, FormatError) else FormatError(f"damaged {kind}: {e}") from e


def encode(kind: str, w: int, h: int, rgba: bytes) -> bytes:
    from . import jpeg

    known = ENCODERS | {"jpeg": jpeg.encode}
    if kind not in known:
        raise FormatError(f"no encoder for {kind}")
    return known[kind](w, h, rgba)
