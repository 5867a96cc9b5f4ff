"""Frames higher than an image file may be: files come in strips, tools that work frame by frame take them whole."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import sequential as Q
from rasterloom.plans import views as V
from rasterloom.queries import QUERIES
from rasterloom.sources import images as IM

H = 32_784
#: What each query gives of such a frame; ``same``: its pixels.
TALL = {
    "codec_bmp": "same",
    "codec_layered_blocks": H * 64,
    "codec_qoi": "same",
    "filter_dispatch": 34,
    "frame_inpaint": H * 64,
    "pipeline_headline": 1280 * 720,
    "pipeline_retouch": H * 64,
    "codec_jpeg": H * 64,
    "codec_png": "same",
    "codec_sniff": 5,
    "frame_dither": H * 64,
    "frame_rain": H * 64,
    "pipeline_layer_rebuild": 1,
    "pipeline_retouch_error": 1,
    "codec_layer_styles": 1,
    "codec_psd": "same",
    "codec_tiff": "same",
    "frame_grain": H * 64,
    "pipeline_auto_retouch": H * 64,
    "pipeline_layered_file": 11,
}


@pytest.fixture(scope="session")
def tall(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tall"))
    row = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (((F.col("vec_id") * 131 + i * i * 17) % 241) / 400.0 - 0.3).cast("float"))
    spark.range(H).select(F.col("id").alias("vec_id")).select("vec_id", row.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{sf}/embeddings.parquet")
    key = F.when(F.col("id") < 4, F.col("id")).otherwise((F.col("id") % 8) * 600_011)
    lines = spark.range(64).select(key.alias("l_orderkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"), *[(F.col("id") % 7 * k).cast("double").alias(c) for c, k in (("l_quantity", 5.0), ("l_tax", 0.01), ("l_extendedprice", 91.0))], F.lit(0.1).alias("l_discount"))
    lines.write.parquet(f"{sf}/lineitem.parquet")
    return sf


@pytest.mark.parametrize("key", TALL)
def test_tall_frames(spark, tall, key):
    out, want = QUERIES[key](spark, tall), TALL[key]
    if want == "same":
        digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("x", "y", "r", "g", "b", "a").cast("decimal(38,0)"))).first()
        assert digest(out) == digest(V.pixels(spark, tall))
    else:
        assert out.count() == want


@pytest.mark.parametrize("kind", ["png", "jpeg", "psd"])
def test_strips_hold_what_the_whole_file_does(spark, monkeypatch, kind):
    w, h = 20, 70
    px = V.pixels(spark, "/root/testdata/sf0.001").filter(f"x < {w} AND y < {h} AND (y < 16 OR y > 31)").withColumn("doc_id", F.lit(5).cast("long"))
    read = lambda files: IM.to_pixels(IM.decode(files)).withColumn("y", F.col("y") + F.col("path").cast("int")).drop("path")
    whole = read(IM.encode(px, kind, w, h).select(F.lit("0").alias("path"), "content"))
    monkeypatch.setattr(IM, "strip_height", lambda w, h: 16)
    files = IM.encode_strips(px, kind, w, h).cache()
    assert sorted(r["top"] for r in files.select("top").collect()) == [0, 16, 32, 48, 64]
    cut = read(files.select(F.col("top").cast("string").alias("path"), "content"))
    assert whole.count() and not whole.exceptAll(cut).count() and not cut.exceptAll(whole).count()


def test_errors_are_spread_as_floats():
    """The errors of dithering add up as rows of float arrays do."""
    img = np.random.default_rng(4).integers(0, 256, (9, 11, 4)).astype(float)
    want, err = img.copy(), np.zeros((10, 13, 3), np.float32)
    for y in range(9):
        step = 1 if y % 2 == 0 else -1
        for x in range(11)[::step]:
            v = np.clip(img[y, x, :3] + err[y, x + 1].astype(float), 0, 255)
            want[y, x, :3] = np.where(v <= 127, 0.0, 255.0)
            e = v - want[y, x, :3]
            for dy, dx, k in ((0, step, 7), (1, -step, 3), (1, 0, 5), (1, step, 1)):
                err[y + dy, x + 1 + dx] += e * (k / 16)
    assert np.array_equal(Q.dither_frame(img), want)


def test_long_strokes_keep_their_places(spark):
    """Arc length doesn't drift: along a zigzag of many steps points stand where their number says."""
    from rasterloom.operators import strokes as N

    path = spark.range(100_001).select(F.lit(1).alias("stroke"), F.col("id").alias("seq"), (F.col("id") % 2).alias("x"), F.col("id").alias("y"))
    worst = N.stroke_points(path, 2.5).select(F.max(F.abs(F.col("y") - F.col("n") * 2.5 / F.sqrt(F.lit(2.0)))).alias("e"), F.count("*").alias("n")).first()
    assert worst["n"] == 56_569 and worst["e"] < 1e-9


def test_bitmap_text_is_made_without_bringing_pixels_together(spark):
    """Keys with one line, however often, with several, and null ones: as if every pixel were grouped."""
    from rasterloom.operators import text as TX

    rows = [(1, "Ab!"), (2, "x"), (2, "X"), (3, "A"), (3, "B"), (None, "Q"), (None, "--"), (4, None), (5, ""), (6, "é?")]
    t = spark.createDataFrame(rows, "k int, line string")
    got = TX.bitmap_text(t, 18, gap=0.17, pad=1, keys=("k",), text="line")
    px = {(r["k"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in got.collect()}
    assert len(px) == got.count()
    cell, gap, pad, rim, want = 2, 3, 1, 1, {}
    for k, line in rows:
        line = (line or "").upper()
        wide, high = len(line) * (6 * cell + gap) - gap + 2 * pad, 8 * cell + 2 * pad
        for n, c in enumerate(line):
            for cy, bits in enumerate(TX.GLYPHS.get(c, "").split()):
                for cx, bit in enumerate(bits):
                    for dx in range(-rim, cell + rim) if bit == "1" else ():
                        for dy in range(-rim, cell + rim):
                            x, y = pad + n * (6 * cell + gap) + cx * cell + dx, cy * cell + dy
                            if 0 <= x < wide and 0 <= y < high:
                                want[k, x, y] = want.get((k, x, y), False) or (0 <= dx < cell and 0 <= dy < cell)
    assert px == {k: (255, 214, 0, 255) if own else (0, 0, 0, 255) for k, own in want.items()}
    # no key with two lines: nothing but the texts is shuffled
    one = TX.bitmap_text(spark.range(3).selectExpr("id AS k", "'AB' AS line"), 18, gap=0.17, pad=4, keys=("k",), text="line")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "_glyph" in plan.split("Union")[1].split("Aggregate")[0]
    # a rim so wide that glyphs meet
    assert TX.bitmap_text(spark.createDataFrame([("AB",)], "text string"), 18, rim=5).groupBy("x", "y").count().filter("count > 1").count() == 0


def parts(w, h, each=10_000):
    """The pixels of a frame as a group brings them, every seventh a hole too."""
    for low in range(0, w * h, each):
        at = np.arange(low, min(w * h, low + each), dtype=np.int32)
        px = pd.DataFrame({"doc_id": 7, "x": at % w, "y": at // w} | {c: at * k % 256 for c, k in zip("rgba", (3, 5, 7, 11))} | {"hole": False})
        yield pd.concat([px, px[at % 7 == 0].assign(r=0, g=0, b=0, a=0, hole=True)])


def held(f, w=64, h=H):
    """Bytes a pixel that a frame tool holds at its peak."""
    tracemalloc.start()
    n = sum(len(p) for p in Q.in_parts(parts(w, h), w, h, f))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == w * h
    return peak / n


def test_frame_tools_hold_bytes(spark):
    px = spark.range(60).selectExpr("id DIV 30 AS doc_id", "CAST(id % 5 AS INT) AS x", "CAST(id % 30 DIV 5 AS INT) AS y", "255 AS r", "0 AS g", "7 AS b", "9 AS a")
    size = lambda d: {tuple(r) for r in Q.per_frame(d, 5, 6, lambda img, *_: np.full_like(img, img.itemsize)).select("r", "a").distinct().collect()}
    assert size(px) == {(1, 1)}
    assert size(px.withColumn("g", F.lit(256))) == {(8, 8)} == size(px.withColumn("g", F.lit(-1)))
    assert held(lambda img, _: Q.rain_frame(img, 0.001)) < 20


def test_rain_in_parts_is_rain_on_the_frame(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART", 50)
    w, h, img = 20, 30, np.zeros((30, 20, 4))
    for p in parts(w, h):
        p = p[~p["hole"]]
        img[p["y"], p["x"]] = p[list("rgba")]
    got = list(Q.in_parts(parts(w, h, 70), w, h, lambda img, _: Q.rain_frame(img, 0.05)))
    assert [len(p) for p in got] == [50] * 12
    out = pd.concat(got)
    assert (out["x"] + w * out["y"]).tolist() == list(range(w * h)) and set(out["doc_id"]) == {7}
    assert np.array_equal(out[list("rgba")].to_numpy(), Q.rain_frame(img, 0.05).reshape(-1, 4))


def test_holes_come_with_their_frame(spark):
    """Rebuilding layers gathers the frame and its holes in parts, not as two whole tables."""
    from rasterloom.plans import pipelines as P

    px = spark.range(42).selectExpr("CAST(id % 6 AS INT) AS x", "CAST(id DIV 6 AS INT) AS y", "CAST(id * 5 AS INT) AS r", "9 AS g", "8 AS b", "255 AS a")
    split = px.withColumn("class", F.when(F.col("x") % 3 == 1, "red").otherwise("none"))
    rebuilt = P.layer_rebuild(split, 6, 7)
    assert "CoGroup" not in rebuilt._jdf.queryExecution().optimizedPlan().toString()
    assert rebuilt.count() == 42 and not rebuilt.select(px.columns).exceptAll(px).count()
    img, mask = np.zeros((7, 6, 4)), np.zeros((7, 6), bool)
    for r in split.collect():
        img[r["y"], r["x"]], mask[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"]), r["class"] == "red"
    ground = P.layer_ground(split, 6, 7, 3)
    assert {(r["x"], r["y"]): tuple(r)[2:] for r in ground.collect()} == {(x, y): tuple(v) for y, row in enumerate(Q.inpaint_frame(img, mask, 3)) for x, v in enumerate(row)}
    assert held(lambda img, _: img) < 20


def test_holes_without_a_frame(spark):
    px = spark.createDataFrame([(d, x, 0, 50, 60, 70, 255) for d in (1, None) for x in range(3)], "doc_id long, x int, y int, r int, g int, b int, a int")
    holes = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 2, 0), (8, 0, 0)], "doc_id long, x long, y long")
    key = lambda r: str(tuple(r))
    assert sorted(Q.inpaint(px, holes, 3, 1).collect(), key=key) == sorted(px.collect(), key=key)
    assert Q.inpaint(px.limit(0), holes, 3, 1).count() == 0
