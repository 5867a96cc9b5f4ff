"""Operators that have no SQL form, and edges of those that have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import geometry as Y
from rasterloom.operators import history as H
from rasterloom.operators import region as Z
from rasterloom.operators import sequential as Q
from rasterloom.operators import shapes as S
from rasterloom.operators import stencil as T
from rasterloom.operators import strokes as N
from rasterloom.plans import pipelines as P

PX = "x int, y int, r int, g int, b int, a int"


def frame(spark, w, h, f):
    return spark.createDataFrame([(x, y, *f(x, y)) for y in range(h) for x in range(w)], PX)


def test_region_of_two_tones(spark):
    px = frame(spark, 20, 10, lambda x, y: (255, 0, 0, 255) if x < 10 else (0, 0, 255, 255))
    b = Z.bounds(Z.region_grow(px, 20, 10, 2, 3, 0)).first()
    assert tuple(b) == (100, 0, 0, 10, 10)
    assert Z.region_grow(px, 20, 10, 99, 3, 0).count() == 0
    assert Z.magic_eraser(px, 20, 10, 2, 3, 0).count() == 100


def test_region_spiral(spark):
    """A path far longer than the frame is wide."""
    grid = ["########", ".......#", "######.#", "#....#.#", "#.##.#.#", "#.#..#.#", "#.####.#", "#......#"]
    px = frame(spark, 8, 8, lambda x, y: (255, 255, 255, 255) if grid[y][x] == "." else (0, 0, 0, 255))
    assert Z.region_grow(px, 8, 8, 0, 1, 0).count() == sum(r.count(".") for r in grid)


def test_chroma_key(spark):
    px = frame(spark, 8, 8, lambda x, y: (200, 0, 0, 255) if 1 <= x <= 4 and 1 <= y <= 4 else (0, 255, 0, 255))
    got = {(r["x"], r["y"]): r["a"] for r in Z.chroma_key(px, 8, 8).collect()}
    assert got[7, 7] == 0 and got[2, 2] == 255


def test_inpaint_hole():
    img = np.full((9, 9, 4), 200.0)
    img[4, 4, :3] = 0
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert np.abs(Q.inpaint_frame(img, mask)[4, 4, :3] - 200).max() <= 1


def test_inpaint_sees_its_own_wave():
    img, mask = np.zeros((1, 5, 4)), np.array([[False, True, True, False, False]])
    img[0, :, 0] = [100, 0, 0, 40, 40]
    out = Q.inpaint_frame(img, mask, 2)[0, :, 0]
    first = (100 / 2 + 40 / 5) / (1 / 2 + 1 / 5)
    assert out[1] == np.rint(first)
    assert out[2] == np.rint((100 / 5 + out[1] / 2 + 40 / 2 + 40 / 5) / (1 / 5 + 1 / 2 + 1 / 2 + 1 / 5))


def test_dither_mean_and_alpha():
    img = np.full((40, 40, 4), 200.0)
    img[:, :, 3] = 77
    out = Q.dither_frame(img)
    assert set(np.unique(out[:, :, 0])) <= {0, 255} and abs(out[:, :, 0].mean() - 200) < 12 and (out[:, :, 3] == 77).all()


def test_rain_and_grain_repeat():
    img = np.full((30, 20, 4), 100.0)
    assert (Q.rain_frame(img, 0.05) == Q.rain_frame(img, 0.05)).all() and (Q.rain_frame(img, 0.05) != img).any()
    s = (1337 * 22695477 + 1) % 2**32
    n = (s / 2**32 - 0.5) * 36
    assert Q.grain_frame(img)[0, 0, 0] == np.floor(100 + n)
    assert (Q.grain_frame(img, 0) == img).all()


def test_stroke_order_matters(spark):
    px = frame(spark, 9, 9, lambda x, y: (0, 0, 0, 255))
    cols = "seq long, cx double, cy double, radius double, hardness double, r int, g int, b int, a int, alpha double"
    one, two = (1, 4.0, 4.0, 2.0, 1.0, 255, 0, 0, 255, 1.0), (2, 4.0, 4.0, 2.0, 1.0, 0, 0, 255, 255, 1.0)
    mid = lambda df: tuple(df.filter("x = 4 and y = 4").first())[2:]
    assert mid(N.apply_stamps(px, spark.createDataFrame([two, one], cols), 9, 9)) == (0, 0, 255, 255)
    swapped = [(2, *one[1:]), (1, *two[1:])]
    assert mid(N.apply_stamps(px, spark.createDataFrame(swapped, cols), 9, 9)) == (255, 0, 0, 255)
    assert N.apply_stamps(px, spark.createDataFrame([], cols), 9, 9).count() == 81


def test_live_stamps():
    from types import SimpleNamespace

    img = np.zeros((7, 7, 4))
    img[:, :, 3] = 255
    img[3, 3, :3] = 90
    s = SimpleNamespace(cx=3, cy=3, radius=1, hardness=1.0, strength=0.5, pull_x=1, pull_y=0)
    for tool in N.TOOLS.values():
        out = img.copy()
        tool(out, s)
        assert ((out >= 0) & (out <= 255)).all() and (out[:, :, 3] == 255).all()


def test_stroke_points(spark):
    path = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 10, 0), (0, 3, 10, 5), (1, 1, 4, 4)], "stroke int, seq int, x int, y int")
    got = sorted((r["stroke"], r["n"], r["x"], r["y"]) for r in N.stroke_points(path, 5.0).collect())
    assert got == [(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.0), (0, 2, 10.0, 0.0), (0, 3, 10.0, 5.0), (1, 0, 4.0, 4.0)]


def test_history(spark):
    log = [(0, i, k) for i, k in enumerate(["push", "push", "undo", "undo", "undo", "redo", "push", "redo"])]
    r = H.in_force(spark.createDataFrame(log, "doc int, seq long, kind string")).first()
    assert (r["done"], r["redo"]) == ([0, 6], [])
    many = spark.createDataFrame([(0, i, "push") for i in range(7)], "doc int, seq long, kind string")
    assert H.in_force(many, limit=3).first()["done"] == [4, 5, 6]
    assert H.to_depth(1, 3) == ["undo", "undo"]
    assert H.memory_estimate(512, 512, 1) == {"tiled": 2_097_152, "plain": 2_097_152}


def test_affine():
    m = Y.about(3, 4, 0.7, 2, 0.5, 1, -1)
    i = Y.invert(m)
    assert np.allclose(Y.multiply(m, i), Y.IDENTITY, atol=1e-9)
    assert Y.invert((1, 1, 1, 1, 0, 0)) is None


def test_polygon_and_lines(spark):
    square = Z.polygon_mask(spark, 10, 10, [(2, 2), (6, 2), (6, 6), (2, 6)])
    assert square.count() == 20 and Z.polygon_mask(spark, 10, 10, [(1, 1), (2, 2)]).count() == 0
    assert S.draw_line(spark, 3, 3, 3, 3, (1, 2, 3, 4)).count() == 1
    assert S.draw_line(spark, 0, 0, 4, 0, (1, 2, 3, 4), 3).count() == 21


def test_star_is_inside_its_circle(spark):
    rows = S.draw_star(spark, 60, 60, 30, 30, 20).collect()
    assert rows and all((r["x"] - 30) ** 2 + (r["y"] - 30) ** 2 <= 21**2 for r in rows)


@pytest.mark.parametrize("h", [1, 3, 600])
def test_bands_do_not_show(spark, h):
    """A frame taller than a band, and one lower than the stencil."""
    rows = spark.range(h).select(F.col("id").cast("int").alias("y"), *[F.array([((F.col("id") * 7 + k * 13) % 251).cast("int") for k in range(6)]).alias(c) for c in "rgba"])
    src = {r["y"]: r["r"] for r in rows.collect()}
    got = {r["y"]: r["r"] for r in T.box_blur(rows, 6, h, 2).collect()}
    at = lambda v, n: min(n - 1, max(0, v))
    flat = {y: [np.rint(sum(src[y][at(x + d, 6)] for d in range(-2, 3)) / 5) for x in range(6)] for y in src}
    for y in got:
        assert got[y] == [np.rint(sum(flat[at(y + d, h)][x] for d in range(-2, 3)) / 5) for x in range(6)]


def test_kernels():
    for k in (T.gaussian_kernel(4), T.frequency_kernel(4), T.glow_kernel(4)):
        assert abs(sum(k) - 1) < 1e-6 and k == k[::-1]


def lines(text, width):
    """The rule in plain Python, one unit a character."""
    import re

    out = []
    for p in (text or "").split("\n"):
        if width <= 0:
            out.append(p)
            continue
        cur = ""
        for t in re.split(r"(\s+)", p):
            if len(cur + t) > width and cur.strip():
                out.append(re.sub(r"\s+$", "", cur))
                cur = re.sub(r"^\s+", "", t)
            else:
                cur += t
        out.append(cur)
    return out


def test_layout_lines(spark):
    from rasterloom.operators import text as X

    texts = ["the quick  brown fox\njumps over", "", None, "   lead and trail   ", "averyveryverylongword next", "a b c d e f g h i j k", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for width in (0, 7, 12):
        got = {r["i"]: r["l"] for r in df.select("i", X.layout_lines(F.col("t"), F.lit(float(width)), F.lit(1.0)).alias("l")).collect()}
        assert [got[i] for i in range(len(texts))] == [lines(t, width) for t in texts]


# -- bands ------------------------------------------------------------------------


def gray_rows(spark, w, h, seed=5):
    rng = np.random.default_rng(seed)
    img = {c: rng.integers(0, 256, (h, w)) for c in "rgba"}
    return img, spark.createDataFrame([(y, *[img[c][y].tolist() for c in "rgba"]) for y in range(h)], "y int, r array<int>, g array<int>, b array<int>, a array<int>").repartition(3)


def collected(df, c="r"):
    return np.array([r[c] for r in sorted(df.collect(), key=lambda r: r["y"])])


@pytest.mark.parametrize("radius", [255, 256, 257, 280, 600])
def test_any_reach(spark, radius):
    w, h = 2, 900
    img, rows = gray_rows(spark, w, h)
    near = np.clip(np.arange(h)[:, None] + np.arange(-radius, radius + 1), 0, h - 1)
    wide = np.clip(np.arange(w)[:, None] + np.arange(-radius, radius + 1), 0, w - 1)
    across = np.rint(img["r"][:, wide].sum(axis=2) / (2 * radius + 1))
    want = np.rint(across[near].sum(axis=1) / (2 * radius + 1))
    assert np.array_equal(collected(T.box_blur(rows, w, h, radius)), want)


@pytest.mark.parametrize("reach", [255, 256, 257, 600])
def test_any_motion(spark, reach):
    w, h = 3, 900
    img, rows = gray_rows(spark, w, h)
    length = 2 * reach
    got = collected(T.motion_blur(rows, w, h, length, 90.0))
    at = lambda y: np.clip(math.floor(y), 0, h - 1)
    for y in (0, 1, 255, 256, 257, 511, 512, 640, 899):
        taps = [at(y + (t / length * 2 - 1) * length * 0.5 + 0.5) for t in range(length)]
        assert np.array_equal(got[y], np.rint(img["r"][taps].sum(axis=0) / length))


def test_a_missing_or_repeated_row_is_an_error(spark):
    _, rows = gray_rows(spark, 4, 20)
    for bad in (rows.filter("y <> 7"), rows.union(rows.filter("y = 7"))):
        with pytest.raises(Exception, match="missing or repeated"):
            T.box_blur(bad, 4, 20, 2).collect()


STEPS = {
    "zoom": lambda d, w, h: T.motion_blur(d, w, h, 5, 20.0, 0.3),
    "shadow": lambda d, w, h: T.drop_shadow(d, w, h, 2, -9, 6),
    "sobel": lambda d, w, h: T.sobel_edge(d, w, h),
    "median": lambda d, w, h: T.median_filter(d, w, h, 2),
    "kuwahara": lambda d, w, h: T.kuwahara(d, w, h, 2),
    "wrap": lambda d, w, h: T.convolve(d, w, h, [0.2] * 25, 5, "wrap"),
    "mirror": lambda d, w, h: T.convolve(d, w, h, list(range(25)), 5, "mirror", 0.01),
    "extend": lambda d, w, h: T.convolve(d, w, h, list(range(25)), 5, "extend", 0.01),
    "auto": lambda d, w, h: P.auto_retouch(d.withColumn("doc_id", F.lit(1).cast("long")), w, h),
    "retouch": lambda d, w, h: P.to_scan(P.retouch(d.withColumn("doc_id", F.lit(1).cast("long")), w, h), w, h),
}


@pytest.mark.parametrize("step", STEPS)
def test_bands_do_not_matter(spark, monkeypatch, step):
    """A frame in one band, and in many that are lower than the halo."""
    w, h = 9, 61
    _, rows = gray_rows(spark, w, h)
    whole = [collected(STEPS[step](rows, w, h), c) for c in "rgba"]
    monkeypatch.setattr(T, "BAND", 4)
    cut = [collected(STEPS[step](rows, w, h), c) for c in "rgba"]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_zoom_equals_the_gather(spark):
    w, h = 12, 40
    _, rows = gray_rows(spark, w, h)
    px = P.to_pixels(rows)
    one = P.to_pixels(T.motion_blur(rows, w, h, 7, 30.0, 0.05))
    assert not one.exceptAll(Y.motion_zoom(px, w, h, 7, 30.0, 0.05).select(one.columns)).count()


def test_retouch_leaves_what_is_not_skin(spark):
    w, h = 24, 20
    rows = spark.createDataFrame([(y, [40] * w, [90] * w, [160] * w, [255] * w) for y in range(h)], "y int, r array<int>, g array<int>, b array<int>, a array<int>")
    rows = rows.withColumn("doc_id", F.lit(3).cast("long"))
    out = P.retouch(rows, w, h).collect()
    assert len(out) == w * h and all(abs(r["r"] - 40) <= 4 and abs(r["b"] - 160) <= 4 and r["doc_id"] == 3 for r in out)
    skin = spark.createDataFrame([(y, [200 if (x, y) != (12, 10) else 20 for x in range(w)], [150] * w, [120] * w, [255] * w) for y in range(h)], "y int, r array<int>, g array<int>, b array<int>, a array<int>")
    skin = skin.withColumn("doc_id", F.lit(3).cast("long")).withColumn("r", F.when(F.col("y") == 10, F.transform("r", lambda v: v)).otherwise(F.col("r")))
    got = {(r["x"], r["y"]): r["r"] for r in P.to_pixels(P.auto_retouch(skin, w, h)).collect()}
    assert abs(got[3, 3] - 200) <= 1


def test_every_filter_keeps_the_frame(spark):
    w, h = 16, 12
    _, rows = gray_rows(spark, w, h)
    px = P.to_pixels(rows).withColumn("doc_id", F.lit(0).cast("long"))
    assert len(P.FILTERS) == 32
    for kind in ("sepia", "median", "pixelate", "kaleido", "thermal", "curves", "freqsep", "unheard of"):
        assert P.apply_filter(px, kind, w, h).count() == w * h


def test_regions_over_many_bands(spark, monkeypatch):
    """A comb: teeth that meet only in the last row."""
    monkeypatch.setattr(Z, "BAND", 3)
    w, h = 9, 40
    px = frame(spark, w, h, lambda x, y: (255, 255, 255, 255) if x % 2 == 0 or y == h - 1 else (0, 0, 0, 255))
    grown = Z.region_grow(px, w, h, 0, 0, 1)
    assert grown.count() == 5 * (h - 1) + w
    apart = frame(spark, w, h, lambda x, y: (255, 255, 255, 255) if x % 2 == 0 else (0, 0, 0, 255))
    assert Z.region_grow(apart, w, h, 4, 7, 1).count() == h


def test_rectangles():
    assert Z.contains((2, 3, 4, 5), 2, 3) and not Z.contains((2, 3, 4, 5), 6, 3)
    assert Z.intersect((0, 0, 4, 4), (2, 1, 9, 2)) == (2, 1, 2, 2) and Z.intersect((0, 0, 2, 2), (2, 0, 2, 2)) is None


def test_split_and_rebuild(spark):
    w, h = 10, 8
    px = frame(spark, w, h, lambda x, y: (220, 20, 20, 255) if 3 <= x <= 4 and 3 <= y <= 4 else (90, 90, 90, 255))
    classes = px.select("x", "y", F.when(F.col("r") > 200, "red").otherwise("none").alias("class"))
    split = P.layer_split(px, classes)
    assert not P.layer_rebuild(split, w, h).select(px.columns).exceptAll(px).count()
    ground = P.layer_ground(split, w, h)
    assert ground.filter("r <> 90").count() == 0 and ground.count() == w * h


def test_bitmap_text(spark):
    """Against cells drawn one by one."""
    from rasterloom.operators.text import GLYPHS, bitmap_text, text_size

    size, gap, pad, rim = 31, 0.18, 5, 2
    cell, between = size // 9, int(size * gap)
    texts = [(1, "Go 2!"), (2, None), (3, "?é"), (4, "")]
    got = {}
    for r in bitmap_text(spark.createDataFrame(texts, "k int, text string"), size, (1, 2, 3), (7, 8, 9), gap, pad, rim, ("k",)).collect():
        assert (r["k"], r["x"], r["y"]) not in got and r["a"] == 255
        got[r["k"], r["x"], r["y"]] = (r["r"], r["g"], r["b"])
    want = {}
    for k, t in texts:
        w, h = text_size(t or "", size, gap, pad)
        for own in (False, True):
            grow = 0 if own else rim
            for n, c in enumerate((t or "").upper()):
                for cy, row in enumerate(GLYPHS.get(c, GLYPHS[" "]).split()):
                    for cx, bit in enumerate(row):
                        px, py = pad + n * (6 * cell + between) + cx * cell, cy * cell
                        for y in range(py - grow, py + cell + grow):
                            for x in range(px - grow, px + cell + grow):
                                if bit == "1" and 0 <= x < w and 0 <= y < h:
                                    want[k, x, y] = (1, 2, 3) if own else (7, 8, 9)
    assert got == want and {k for k, _, _ in got} == {1, 3}


def test_headline_thumbnail(spark):
    """Title, badge and gradient are where they belong; a subject stands on the gradient."""
    from rasterloom.plans import pipelines as P

    green = [(x, y, 0, 255, 0, 255) if x < 3 or x > 16 or y < 3 else (x, y, 90, 60, 200, 255) for x in range(20) for y in range(18)]
    px = spark.createDataFrame(green, "x int, y int, r int, g int, b int, a int")
    out = P.headline_thumbnail(px, 20, 18, px, 20, 18, "HI", "OK!").cache()
    assert out.count() == 1280 * 720 and out.select("x", "y").distinct().count() == 1280 * 720
    at = lambda x, y: tuple(out.filter(f"x = {x} AND y = {y}").select("r", "g", "b", "a").first())
    assert at(120, 110) == (255, 210, 0, 255) and at(250, 60) == (255, 255, 255, 255)
    assert out.filter("r = 255 AND g = 255 AND b = 255 AND y > 500 AND x < 400").count() > 1000
    assert abs(at(200, 500)[2] - 200 * 1.12) < 8  # the subject's blue, brighter
    assert at(640, 5)[2] == 0 or at(640, 5)[2] < 30
    out.unpersist()


def test_history_of_whole_documents(spark):
    log = spark.createDataFrame(
        [(1, 1, "push", "paint"), (1, 2, "push", "fill"), (1, 3, "undo", None), (1, 4, "push", "blur"), (1, 5, "undo", None), (1, 6, "redo", None), (2, 1, "push", "paint"), (2, 2, "undo", None), (3, 1, "undo", None)],
        "doc int, seq long, kind string, label string",
    )
    labels = {}
    for r in H.labels(log).orderBy("doc", "depth").collect():
        labels.setdefault(r["doc"], []).append(r["label"])
    assert labels == {1: ["Open", "paint", "blur"], 2: ["Open"], 3: ["Open"]}
    snaps = spark.createDataFrame([(d, s, f"{d}.{s}") for d in (1, 2, 3) for s in (0, 1, 2, 4)], "doc int, seq long, v string")
    assert {r["v"] for r in H.restore(log, snaps).collect()} == {"1.4", "2.0", "3.0"}
    layers = spark.createDataFrame([(0, "paint", "a", True), (1, "paint", "b", None), (2, "paint", "c", False)], "z int, kind string, name string, clip boolean")
    show = lambda d: [tuple(r) for r in d.orderBy("z").collect()]
    assert show(H.group_layer(layers, 1)) == [(0, "paint", "a", True), (1, "group", "Group", None), (2, "paint", "b", None), (3, "end", "Group", None), (4, "paint", "c", False)]
    assert show(H.group_layer(layers, 9)) == show(layers) == show(H.rename_layer(layers, 1, ""))
    assert [r[3] for r in show(H.toggle_layer(layers, 1, "clip"))] == [True, True, False]
    assert [r[2] for r in show(H.duplicate_layer(layers, 1))] == ["a", "b", "b", "c"]
    px = spark.createDataFrame([(0, 0, 1, 1, 1, 255), (300, 5, 2, 2, 2, 9), (1, 0, 3, 3, 3, 0)], "x int, y int, r int, g int, b int, a int")
    tiles = H.capture_tiles(px)
    assert tiles.count() == 2 and H.restore_tiles(tiles).count() == 2
    copy = H.written(px, spark.createDataFrame([(0, 0, 9, 9, 9, 255), (7, 7, 8, 8, 8, 255)], px.schema))
    assert {(r["x"], r["r"]) for r in copy.collect()} == {(0, 9), (7, 8), (300, 2), (1, 3)} and px.count() == 3
