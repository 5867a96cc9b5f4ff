"""Known values of the formulas."""

import pytest

from rasterloom.functions import adjust as A
from rasterloom.functions import blend as B
from rasterloom.functions import color as C
from rasterloom.functions.dual import Steps, byte_cut, byte_even, half_up, lit
from rasterloom.operators.composite import Layer, coerce_opacity, dirty_tiles, effective, flatten


def value(spark, values, steps=None):
    df = (steps or Steps()).spark(spark.range(1))
    return tuple(df.select(*[v.col.alias(k) for k, v in values.items()]).first())


def test_rounding(spark):
    assert value(spark, {"a": half_up(lit(2.5)), "b": byte_even(lit(2.5)), "c": byte_even(lit(127.5)), "d": byte_cut(lit(2.9)), "e": byte_even(lit(300.0))}) == (3, 2, 128, 2, 255)


def test_transfer(spark):
    assert value(spark, {"v": C.to_linear(lit(0.5))})[0] == pytest.approx(0.21404114048223255, abs=1e-12)
    assert value(spark, {"v": C.to_srgb(C.to_linear(lit(0.3)))})[0] == pytest.approx(0.3, abs=1e-12)


def test_colours(spark):
    assert value(spark, C.from_hex(lit("#0f8"))) == (0, 255, 136)
    assert value(spark, C.from_hex(lit("#12345"))) == (None, None, None)
    assert value(spark, {"h": C.to_hex(lit(1), lit(171), lit(255))}) == ("#01abff",)
    assert value(spark, A.f_grayscale(lit(255), lit(0), lit(0)))[0] == 54
    assert value(spark, A.invert(lit(200), lit(100), lit(0))) == (55, 155, 255)
    assert value(spark, A.f_brightness_contrast(lit(0), lit(0), lit(0), 0.5))[0] == 128


def over(spark, mode, back, top, opacity=1.0):
    s = Steps()
    return value(spark, B.over_bytes(s, mode, [lit(v) for v in back], [lit(v) for v in top], opacity), s)


def test_over(spark):
    assert over(spark, "normal", (1, 2, 3, 255), (9, 8, 7, 255)) == (9, 8, 7, 255)
    assert over(spark, "normal", (0, 0, 0, 0), (9, 8, 7, 128)) == (9, 8, 7, 128)
    assert over(spark, "multiply", (5, 6, 7, 200), (9, 8, 7, 0)) == (5, 6, 7, 200)
    r, g, b, a = over(spark, "normal", (255, 255, 255, 255), (255, 0, 0, 128))
    assert (r, a) == (255, 255) and 186 <= g <= 187 and g == b
    assert over(spark, "multiply", (255, 255, 255, 255), (0, 0, 0, 255)) == (0, 0, 0, 255)
    assert over(spark, "screen", (200, 200, 200, 255), (0, 0, 0, 255)) == (200, 200, 200, 255)
    assert over(spark, "dissolve", (1, 2, 3, 255), (9, 8, 7, 255)) == (9, 8, 7, 255)


@pytest.mark.parametrize("mode", B.MODES)
def test_modes_stay_in_range(spark, mode):
    for back, top in (((0, 0, 0, 255), (255, 255, 255, 255)), ((255, 0, 128, 255), (0, 0, 0, 255)), ((10, 10, 10, 90), (10, 10, 10, 90))):
        assert all(0 <= v <= 255 for v in over(spark, mode, back, top))


def pixels(spark, rows):
    return spark.createDataFrame(rows, "x int, y int, z int, r int, g int, b int, a int")


def test_groups_and_clipping(spark):
    white = [(x, 0, 1, 255, 255, 255, 255) for x in range(4)]
    red = [(x, 0, 2, 255, 0, 0, 255) for x in range(2)]
    got = {r["x"]: r for r in flatten(pixels(spark, white + red), [Layer(1), Layer(kind="group", opacity=0.5), Layer(2), Layer(kind="end")]).collect()}
    assert got[0]["r"] == 255 and abs(got[0]["g"] - 187) <= 2 and got[3]["g"] == 255
    base = [(0, 0, 1, 255, 255, 255, 255)]
    blue = [(x, 0, 2, 0, 0, 255, 255) for x in range(2)]
    rows = flatten(pixels(spark, base + blue), [Layer(1), Layer(2, clip=True)]).collect()
    assert [(r["x"], r["r"], r["b"]) for r in rows] == [(0, 0, 255)]


def test_adjustment_waits_for_a_pixel(spark):
    rows = flatten(pixels(spark, [(0, 0, 1, 10, 20, 30, 255)]), [Layer(kind="adjust", adjust="invert"), Layer(1), Layer(kind="adjust", adjust="invert", opacity=0.2)]).collect()
    assert tuple(rows[0])[2:] == (245, 235, 225, 255)


def test_offsets_and_empty(spark):
    px = pixels(spark, [(0, 0, 1, 10, 20, 30, 255)])
    assert [(r["x"], r["y"]) for r in flatten(px, [Layer(1, ox=5, oy=-2)]).collect()] == [(5, -2)]
    assert flatten(px.limit(0), [Layer(1)]).count() == 0


def test_stack_rules():
    assert [coerce_opacity(v) for v in (float("nan"), None, 2, -1, 0.5)] == [1.0, 1.0, 1.0, 0.0, 0.5]
    assert effective([Layer(kind="group", visible=False), Layer(1), Layer(kind="end"), Layer(2, opacity=0)]) == []
    assert dirty_tiles(250, 0, 10, 10, 4, 4) == [(0, 0), (1, 0)]


def test_curves():
    assert A.spline_table([]) == list(range(256))
    t = A.linear_table([(128, 64)])
    assert (t[0], t[64], t[128], t[255]) == (0, 32, 64, 255)
