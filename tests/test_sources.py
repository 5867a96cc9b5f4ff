import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.sources import codecs as C
from rasterloom.sources import images

RNG = np.random.default_rng(5)


def image(w, h):
    a = np.zeros((h, w, 4), np.uint8)
    a[:, : w // 3] = (10, 200, 30, 255)
    a[:, w // 3 : 2 * w // 3, 0] = np.arange(h)[:, None]
    a[:, w // 3 : 2 * w // 3, 3] = 255
    a[:, 2 * w // 3 :] = RNG.integers(0, 256, (h, w - 2 * w // 3, 4))
    return a.tobytes()


@pytest.mark.parametrize("kind", C.DECODERS)
@pytest.mark.parametrize("size", [(1, 1), (7, 5), (64, 48)])
def test_round_trip(kind, size):
    rgba = image(*size)
    data = C.encode(kind, *size, rgba)
    assert C.sniff(data) == kind
    assert C.decode(data) == (*size, rgba)
    with pytest.raises(C.FormatError):
        C.decode(data[: len(data) // 2])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.sampled_from([2, 3]))
def test_pack_bits(data, shortest):
    assert C.unpack_bits(C.pack_bits(data, shortest)) == data


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_noise_is_refused(data):
    for kind, magic in (("png", b"\x89PNG\r\n\x1a\n"), ("bmp", b"BM"), ("qoi", b"qoif"), ("tiff", b"II*\0"), ("psd", b"8BPS")):
        with pytest.raises(C.FormatError):
            C.decode(magic + data)
            raise C.FormatError(kind)


def lzw(data):
    """A plain encoder for the test."""
    table, out, width, w = {bytes((i,)): i for i in range(256)}, [(256, 9)], 9, b""
    n = 258
    for b in data:
        c = w + bytes((b,))
        if c in table:
            w = c
            continue
        out.append((table[w], width))
        table[c] = n
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
        if n >= 4094:
            out.append((256, width))
            table, n, width = {bytes((i,)): i for i in range(256)}, 258, 9
        w = bytes((b,))
    if w:
        out.append((table[w], width))
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
    out.append((257, width))
    bits = "".join(format(c, f"0{k}b") for c, k in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200).map(lambda b: b * 9))
def test_lzw(data):
    assert C.un_lzw(lzw(data)) == data


def png(kind, depth, rows, extra=b"", w=None):
    h = len(rows)
    body = zlib.compress(b"".join(rows))
    return b"\x89PNG\r\n\x1a\n" + C._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + C._chunk(b"IDAT", body) + C._chunk(b"IEND", b"")


def test_png_kinds():
    grey1 = png(0, 1, [b"\0\xa0"], w=3)
    assert C.decode(grey1)[2] == bytes([255] * 3 + [255] + [0] * 3 + [255] + [255] * 4)
    pal = png(3, 2, [b"\0\x1b"], C._chunk(b"PLTE", bytes(range(12))) + C._chunk(b"tRNS", b"\x07"), w=4)
    assert C.decode(pal)[2] == bytes([0, 1, 2, 7, 3, 4, 5, 255, 6, 7, 8, 255, 9, 10, 11, 255])
    deep = png(6, 16, [b"\0" + bytes([1, 99, 2, 99, 3, 99, 4, 99])], w=1)
    assert C.decode(deep)[2] == bytes([1, 2, 3, 4])
    keyed = png(2, 8, [b"\0\1\2\3\4\5\6"], C._chunk(b"tRNS", struct.pack(">3H", 1, 2, 3)), w=2)
    assert C.decode(keyed)[2] == bytes([1, 2, 3, 0, 4, 5, 6, 255])
    rows = [b"\1\5\5\5", b"\2\1\1\1", b"\3\4\4\4", b"\4\1\2\3"]
    assert len(C.decode(png(0, 8, rows, w=3))[2]) == 48


def test_tiff_blocks():
    strip = bytes(range(12))
    for how, packed in ((1, strip), (32773, C.pack_bits(strip)), (8, zlib.compress(strip)), (5, lzw(strip))):
        tags = [(256, 4), (257, 2), (258, 8), (259, how), (262, 2), (273, 8), (277, 3), (278, 2), (279, len(packed))]
        tags[0] = (256, 2)
        raw = b"II*\0" + struct.pack("<I", 8 + len(packed)) + packed + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
        w, h, data = C.decode(raw)
        assert (w, h) == (2, 2) and np.frombuffer(data, np.uint8).reshape(4, 4)[:, :3].tobytes() == strip


def test_limits():
    with pytest.raises(C.FormatError):
        C.check_size(40_000, 1)
    with pytest.raises(C.FormatError):
        C.decode(struct.pack(">4sIIBB", b"qoif", 20_000, 20_000, 4, 0) + bytes(16))


def test_profiles():
    icc = C.icc_srgb()
    assert C.icc_describe(icc)["description"] == "sRGB"
    rgba = image(4, 4)
    assert C.icc_extract(C.png_encode(4, 4, rgba, icc)) == icc
    assert C.icc_extract(C.tiff_encode(4, 4, rgba, icc)) == icc
    assert C.icc_extract(C.bmp_encode(4, 4, rgba)) is None


def test_delta():
    rows = RNG.integers(0, 256, (5, 9)).astype(np.uint8)
    assert (C.delta_decode(C.delta_encode(rows)) == rows).all()


def test_files(spark, tmp_path):
    rgba = image(6, 4)
    for kind in C.ENCODERS:
        (tmp_path / f"a.{kind}").write_bytes(C.encode(kind, 6, 4, rgba))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    frames = images.read_images(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in frames.collect()}
    assert rows["bad.png"]["error"] and rows["bad.png"]["w"] is None
    assert all(bytes(rows[f"a.{k}"]["data"]) == rgba for k in C.ENCODERS)
    px = images.to_pixels(frames.filter("path like '%a.png'"), drop_clear=False)
    assert px.count() == 24
    out = images.write_images(images.encode(px.withColumnRenamed("path", "doc_id").selectExpr("1L as doc_id", "x", "y", "r", "g", "b", "a"), "qoi", 6, 4), f"file://{tmp_path}/out", "qoi").collect()
    assert out[0]["bytes"] > 0 and C.decode((tmp_path / "out/1.qoi").read_bytes()) == (6, 4, rgba)


def test_flat_document(tmp_path):
    rgba = image(5, 3)
    for packed in (False, True):
        data = C.psd_encode(5, 3, rgba, packed)
        assert C.decode(data) == (5, 3, rgba) and not C.psd_has_layers(data)


@pytest.mark.parametrize("size", [(64, 48), (17, 9), (1, 1)])
def test_jpeg(size):
    w, h = size
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    a = np.stack(((7 * x) // 4 % 256, (11 * y) // 4 % 256, (x + y) * 2 % 256, np.full_like(x, 255)), axis=2).astype(np.uint8)
    data = C.encode("jpeg", w, h, a.tobytes())
    assert C.sniff(data) == "jpeg"
    got = np.frombuffer(C.decode(data)[2], np.uint8).reshape(h, w, 4)
    assert np.abs(got.astype(int) - a)[:, :, :3].mean() < 10
    with pytest.raises(C.FormatError):
        C.decode(data[: len(data) // 2])
    with pytest.raises(C.FormatError):
        C.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def layered():
    from rasterloom.sources.psd import Record

    return [
        Record("ground", x=0, y=0, w=6, h=4, rgba=image(6, 4)),
        Record("gröup ☃", "group", opacity=0.6),
        Record("inner", mode="multiply", opacity=128 / 255, clip=True, x=1, y=-2, w=3, h=5, rgba=image(3, 5), mask=bytes(range(15))),
        Record("close", "end"),
        Record("top", mode="luminosity", visible=False, x=2, y=2, w=1, h=1, rgba=image(1, 1)),
    ]


@pytest.mark.parametrize("packed", [False, True])
def test_layered_document(spark, packed):
    from rasterloom.sources import psd

    layers = layered()
    data = psd.encode(6, 4, layers, image(6, 4) and bytes(96), packed)
    assert C.psd_has_layers(data) and C.decode(data)[:2] == (6, 4)
    w, h, got = psd.decode(data)
    assert (w, h) == (6, 4) and len(got) == 5
    for a, b in zip(layers, got):
        assert (a.name, a.kind, a.mode, a.visible, a.clip) == (b.name, b.kind, b.mode, b.visible, b.clip)
        assert abs(a.opacity - b.opacity) < 0.003
        if a.kind == "paint":
            assert (a.x, a.y, a.w, a.h, a.rgba, a.mask) == (b.x, b.y, b.w, b.h, b.rgba, b.mask)
    rows = psd.read_layers(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:200]))], "path string, content binary")).collect()
    assert [r["name"] for r in rows if r["path"] == "a"] == [r.name for r in layers]
    assert [bool(r["error"]) for r in rows if r["path"] == "b"] == [True]


def test_every_mode_has_a_key():
    from rasterloom.functions.blend import MODES
    from rasterloom.sources.psd import MODE_KEYS

    assert set(MODE_KEYS) == set(MODES) and len(set(MODE_KEYS.values())) == len(MODES)


def test_blocks_round_trip():
    from rasterloom.sources import blocks as B

    adjustments = {
        "invert": {}, "grayscale": {}, "threshold": {"at": 99}, "brightness": {"brightness": 0.2, "contrast": -0.3}, "hue": {"hue": 40.0, "sat": -20.0, "light": 5.0},
        "levels": {"shadows": 20, "highlights": 230, "gamma": 1.2}, "exposure": {"ev": -0.5}, "vibrance": {"amount": 0.4}, "curves": {"points": [(0, 40), (128, 140), (255, 215)]},
    }
    for name, params in adjustments.items():
        assert B.read_adjustment(*B.write_adjustment(name, params)) == (name, params)
    assert B.read_adjustment(b"luni", b"") is None
    for box in ((0, 0, 1, 1), (3, 2, 40, 30), (0, 0, 64, 50), (7, 11, 13, 49)):
        assert B.read_path_box(B.write_path_box(box, 64, 50), 64, 50) == box
    tree = B.Tree("root", {"flag": True, "n": 7, "big": 1 << 40, "f": 0.5, "Txt ": "größ ☃", "u": B.Unit("#Prc", 40.0), "e": B.Choice("BlnM", "Mltp"), "k": B.Kind("", "layr"), "list": [1, B.Tree("leaf", {"x": 1.5}), "y"]}, "name")
    assert B.read_descriptor(B.write_descriptor(tree)) == tree
    assert '"u": {"unit": "#Prc", "value": 40.0}' in B.to_json(tree)
    style = {"drop_shadow": {"color": [1, 2, 3], "opacity": 0.5, "angle": 30.0, "distance": 10.0, "blur": 4.0}, "color_overlay": {"color": [255, 0, 128], "opacity": 0.25}}
    new, old = B.read_style(B.write_style(style)), B.read_old_style(B.write_old_style(style))
    for kind, want in style.items():
        for k, v in want.items():
            assert new[kind][k] == v and (old[kind][k] == v or abs(old[kind][k] - v) < 0.003)
    assert abs(new["drop_shadow"]["dx"] - 8.660254) < 1e-6 and abs(old["drop_shadow"]["dy"] - 5) < 1e-6
    assert B.read_style(b"\0" * 9) == {} and B.read_old_style(b"\0\0\0\2junk") == {}


def test_groups_adjustments_and_masks_of_a_document():
    from rasterloom.sources import psd

    records = [
        psd.Record("ground", w=6, h=4, rgba=image(6, 4), box=(1, 1, 5, 3)),
        psd.Record("outer", "group", "screen", opacity=0.6),
        psd.Record("inner", "group", opacity=0.2, visible=False),
        psd.Record("inner close", "end"),
        psd.Record("outer close", "end"),
        psd.Record("tone", "adjust", adjust="curves", params={"points": [(0, 40), (255, 215)]}),
    ]
    data = psd.encode(6, 4, records)
    got = psd.decode(data)[2]
    assert [(r.name, r.kind, r.mode, r.visible, r.box, r.adjust) for r in got] == [(r.name, r.kind, r.mode, r.visible, r.box, r.adjust) for r in records]
    assert [round(r.opacity, 2) for r in got] == [1.0, 0.6, 0.2, 1.0, 1.0, 1.0]
    stack = psd.stack(got)
    assert [s.kind for s in stack] == ["paint", "group", "group", "end", "end", "adjust"] and stack[0].vector_masked and len(stack[-1].params["tr"]) == 256


def _merged(mode, depth, planes, w, h, how, palette=b""):
    """A flat document from rows of samples (h, bytes of a row) of each plane."""
    import struct
    import zlib

    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, len(planes), h, w, depth, mode) + struct.pack(">I", len(palette)) + palette + struct.pack(">II", 0, 0)
    rows = [r.tobytes() for p in planes for r in p]
    if how == 0:
        return head + b"\0\0" + b"".join(rows)
    if how == 1:
        packed = [C.pack_bits(r) for r in rows]
        return head + b"\0\1" + struct.pack(f">{len(packed)}H", *map(len, packed)) + b"".join(packed)
    if how == 2:
        return head + b"\0\2" + zlib.compress(b"".join(rows))
    out = b""
    for r in rows:  # differences, sample by sample
        if depth == 16:
            v = np.frombuffer(r, ">u2").astype(int)
            out += np.diff(v, prepend=0).astype(np.uint16).astype(">u2").tobytes()
        else:
            v = np.frombuffer(r, np.uint8)
            v = v.reshape(-1, 4).T.ravel() if depth == 32 else v
            out += np.diff(v.astype(int), prepend=0).astype(np.uint8).tobytes()
    return head + b"\0\3" + zlib.compress(out)


@pytest.mark.parametrize("how", [0, 1, 2, 3])
@pytest.mark.parametrize("depth", [8, 16, 32])
@pytest.mark.parametrize("mode", [1, 2, 3, 4, 8, 9])
def test_modes_and_depths(mode, depth, how):
    w, h = 5, 3
    n = C.PSD_PLANES[mode]
    rng = np.random.default_rng(mode * 100 + depth)
    v = rng.integers(0, 256, (n, h, w)).astype(np.uint8)
    wide = {8: v, 16: (v.astype(np.uint16) * 256 + 200).astype(">u2"), 32: (v / 255).astype(">f4")}[depth]
    palette = bytes(range(256)) + bytes(range(255, -1, -1)) + bytes(256)
    got = C.decode(_merged(mode, depth, list(wide), w, h, how, palette if mode == 2 else b""))
    px = np.frombuffer(got[2], np.uint8).reshape(h, w, 4).astype(int)
    assert got[:2] == (w, h) and (px[:, :, 3] == 255).all()
    x = v.astype(int)
    if mode == 3:
        want = x
    elif mode == 4:
        want = np.floor(x[:3] * x[3] / 255 + 0.5)
    elif mode == 2:
        want = np.stack([x[0], 255 - x[0], 0 * x[0]])
    elif mode == 9:
        grey = v.copy()
        grey[1:] = 128
        even = np.frombuffer(C.decode(_merged(9, 8, list(grey), w, h, 0))[2], np.uint8).reshape(h, w, 4).astype(int)
        assert np.ptp(even[:, :, :3], axis=2).max() <= 1  # no colour: grey
        want = px[:, :, :3].transpose(2, 0, 1)
    else:
        want = np.repeat(x, 3, axis=0)
    assert (px[:, :, :3].transpose(2, 0, 1) == want).all()


@pytest.mark.parametrize("how", [0, 1, 2])
def test_bitmaps(how):
    bits = np.random.default_rng(1).integers(0, 2, (4, 11)).astype(np.uint8)
    got = C.decode(_merged(0, 1, [np.packbits(bits, axis=1)], 11, 4, how))
    px = np.frombuffer(got[2], np.uint8).reshape(4, 11, 4)
    assert (px[:, :, 0] == 255 - 255 * bits).all()


def test_lab_is_the_column_formula(spark):
    from rasterloom.functions import color as K
    from rasterloom.functions.dual import Steps, names

    v = np.random.default_rng(2).integers(0, 256, (3, 4, 8)).astype(np.uint8)
    steps = Steps()
    out = K.lab_to_rgb(steps, *names("l", "u", "v"))
    rows = spark.createDataFrame([tuple(map(int, p)) for p in v.reshape(3, -1).T], "l int, u int, v int")
    want = [tuple(r) for r in steps.spark(rows.coalesce(1)).select(*[out[c].col.alias(c) for c in "rgb"]).collect()]
    assert [tuple(map(int, p)) for p in C.lab_bytes(v).reshape(3, -1).T] == want


def test_profiles_inside_jpeg_and_psd():
    import struct

    icc = C.icc_srgb()
    parts = [icc[:700], icc[700:]]
    segment = lambda k, p: b"\xff\xe2" + struct.pack(">H", len(p) + 16) + b"ICC_PROFILE\0" + bytes((k, 2)) + p
    assert C.icc_extract(b"\xff\xd8" + segment(2, parts[1]) + segment(1, parts[0]) + b"\xff\xd9") == icc
    flat = C.psd_encode(5, 3, image(5, 3))
    block = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + struct.pack(">I", 3) + b"abc\0" + b"8BIM" + struct.pack(">H", 1039) + b"\0\0" + struct.pack(">I", len(icc)) + icc + b"\0" * (len(icc) % 2)
    assert C.icc_extract(flat[:30] + struct.pack(">I", len(block)) + block + flat[34:]) == icc
    assert C.icc_extract(flat) is None and C.icc_extract(b"\xff\xd8\xff\xd9") is None
