"""Baseline JPEG, from the public description of the format.

Decoding: eight bits, sequential, Huffman, any sampling factors, grey or YCbCr.
Progressive files and restart intervals are refused. Encoding: 4:2:0 with the
example tables of the standard.
"""

from __future__ import annotations

import struct

import numpy as np

from .codecs import FormatError, Image, check_size


def _zigzag() -> np.ndarray:
    """Order of the 64 coefficients: diagonals, in turn up and down."""
    at = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([8 * y + x for y, x in at])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)

#: The example quantisation tables of the standard, row by row.
LUMA_Q = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62]
    + [18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
CHROMA_Q = np.full(64, 99)
CHROMA_Q[[0, 1, 2, 3, 8, 9, 10, 11, 16, 17, 18, 24, 25]] = [17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 47, 66]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            byte = 0
            if self.at < len(self.data):
                byte = self.data[self.at]
                self.at += 1
                if byte == 0xFF:
                    if self.at < len(self.data) and self.data[self.at] == 0:
                        self.at += 1
                    else:
                        raise FormatError("marker inside image data")
            else:
                self.over = getattr(self, "over", 0) + 1
                if self.over > 64:
                    raise FormatError("image data is short")
                byte = 0xFF
            self.bits, self.held = (self.bits << 8 | byte) & 0xFFFFFFFFFF, self.held + 8

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        self.need(n)
        self.held -= n
        return self.bits >> self.held & (1 << n) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise FormatError("bad Huffman code")

    def value(self, n: int) -> int:
        v = self.take(n)
        return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise FormatError("not a JPEG")
    at, quant, tables, frame = 2, {}, {}, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise FormatError("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                raw = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8)
                table = np.zeros(64)
                table[ZIGZAG] = raw
                quant[body[0] & 15] = table.reshape(8, 8)
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif kind in (0xC0, 0xC1):
            depth, h, w, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or parts not in (1, 3):
                raise FormatError("only 8 bit grey and colour")
            check_size(w, h)
            frame = (w, h, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)])
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise FormatError("only baseline JPEG")
        elif kind == 0xDD and struct.unpack(">H", body[:2])[0]:
            raise FormatError("restart intervals are not supported")
        elif kind == 0xDA:
            if frame is None:
                raise FormatError("no frame")
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            return _scan(data[at:], frame, chosen, quant, tables)
    raise FormatError("no image data")


def _scan(raw: bytes, frame, chosen, quant, tables) -> Image:
    w, h, parts = frame
    end = raw.rfind(b"\xff\xd9")
    if end < 0:
        raise FormatError("image data is short")
    bits = _Bits(raw[:end])
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-w // (8 * hm)), -(-h // (8 * vm))
    blocks = [np.zeros((rows * p[2], cols * p[1], 64)) for p in parts]
    last = [0] * len(parts)
    for my in range(rows):
        for mx in range(cols):
            for k, (ident, ph, pv, _) in enumerate(parts):
                dc, ac = tables[chosen[ident] >> 4], tables[0x10 | chosen[ident] & 15]
                for j in range(pv):
                    for i in range(ph):
                        block = blocks[k][my * pv + j, mx * ph + i]
                        last[k] += bits.value(bits.symbol(dc))
                        block[0], n = last[k], 1
                        while n < 64:
                            s = bits.symbol(ac)
                            if s == 0:
                                break
                            n += s >> 4
                            if n > 63:
                                raise FormatError("too many coefficients")
                            if s & 15:
                                block[ZIGZAG[n]] = bits.value(s & 15)
                            elif s != 0xF0:
                                raise FormatError("bad run")
                            n += 1
    planes = []
    for (_, ph, pv, q), b in zip(parts, blocks):
        spatial = DCT.T @ (b.reshape(*b.shape[:2], 8, 8) * quant[q]) @ DCT
        plane = spatial.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8) + 128
        planes.append(plane.repeat(vm // pv, axis=0).repeat(hm // ph, axis=1)[:h, :w])
    out = np.full((h, w, 4), 255, np.uint8)
    if len(planes) == 1:
        out[:, :, :3] = _byte(planes[0])[:, :, None]
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out[:, :, 0], out[:, :, 1], out[:, :, 2] = _byte(y + 1.402 * cr), _byte(y - 0.344136 * cb - 0.714136 * cr), _byte(y + 1.772 * cb)
    return w, h, out.tobytes()


def _byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)


def _flat_table(symbols: list[int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """A Huffman table in which all symbols have one of two lengths; code of all ones stays free."""
    n = max(2, (len(symbols) + 1).bit_length())
    short = min(len(symbols), (1 << n) - 1 - len(symbols))
    short = max(0, min(short, (1 << n - 1) - 1))
    counts = bytearray(16)
    counts[n - 2], counts[n - 1] = short, len(symbols) - short
    codes = {s: nc for nc, s in _codes(bytes(counts), bytes(symbols)).items()}
    return bytes(counts), bytes(symbols), codes


def encode(w: int, h: int, rgba: bytes, quality: int = 90) -> bytes:
    """Colour with halved chroma; alpha is dropped."""
    check_size(w, h)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((q * scale + 50) / 100), 1, 255).reshape(8, 8) for q in (LUMA_Q, CHROMA_Q)]
    px = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[:, :, :3].astype(float)
    px = np.pad(px, ((0, -h % 16), (0, -w % 16), (0, 0)), "edge")
    r, g, b = px[:, :, 0], px[:, :, 1], px[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    half = lambda v: v.reshape(v.shape[0] // 2, 2, v.shape[1] // 2, 2).mean(axis=(1, 3))
    planes = [y - 128, half((b - y) / 1.772), half((r - y) / 1.402)]
    coded = []
    for plane, q in zip(planes, (tables[0], tables[1], tables[1])):
        cells = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        coded.append(np.rint(DCT @ cells @ DCT.T / q).astype(int).reshape(*cells.shape[:2], 64)[:, :, ZIGZAG])
    dc = _flat_table(list(range(12)))
    ac = _flat_table([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
    bits: list[str] = []
    last = [0, 0, 0]

    def put(code: tuple[int, int]) -> None:
        bits.append(format(code[1], f"0{code[0]}b"))

    def number(v: int) -> int:
        size = abs(v).bit_length()
        return size

    def tail(v: int, size: int) -> None:
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    def block(k: int, c: np.ndarray) -> None:
        v = int(c[0]) - last[k]
        last[k] = int(c[0])
        put(dc[2][number(v)])
        tail(v, number(v))
        run, values = 0, c[1:].tolist()
        while values and values[-1] == 0:
            values.pop()
        for v in values:
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(ac[2][0xF0])
                run -= 16
            put(ac[2][run << 4 | number(v)])
            tail(v, number(v))
            run = 0
        if len(values) < 63:
            put(ac[2][0])

    for my in range(coded[1].shape[0]):
        for mx in range(coded[1].shape[1]):
            for j in (0, 1):
                for i in (0, 1):
                    block(0, coded[0][2 * my + j, 2 * mx + i])
            for k in (1, 2):
                block(k, coded[k][my, mx])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda kind, data: b"\xff" + bytes((kind,)) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, q in enumerate(tables):
        out += part(0xDB, bytes((k,)) + q.ravel()[ZIGZAG].astype(np.uint8).tobytes())
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes((1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1)))
    for kind, (counts, values, _) in ((0x00, dc), (0x10, ac)):
        out += part(0xC4, bytes((kind,)) + counts + values)
    return out + part(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))) + body + b"\xff\xd9"
