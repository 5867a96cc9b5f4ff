"""Text specifications, line breaking and bitmap text.

Rasterising outlines belongs to a font engine; what is data here is the
specification, kept within its limits, and the breaking of text into lines by a
width per character (a column, so a font's average or a monospace advance).
Bitmap text is a join with a table of glyphs, five cells wide and seven high.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults and limits of a specification.
DEFAULTS = {"size": 64.0, "stroke_width": 0.0, "line_height": 1.25, "letter_spacing": 0.0, "align": "left", "x": 0, "y": 0}
LIMITS = {"size": (4.0, 4000.0), "stroke_width": (0.0, 200.0), "line_height": (0.5, 4.0), "letter_spacing": (-200.0, 400.0)}


def clamp_spec(specs: DataFrame, w: int | None = None, h: int | None = None) -> DataFrame:
    """Numbers within their limits (0 and null are the default), alignment one of three, position on the document."""
    out = {}
    for c, (lo, hi) in LIMITS.items():
        v = F.col(c).cast("double") if c in specs.columns else F.lit(None).cast("double")
        out[c] = F.least(F.lit(hi), F.greatest(F.lit(lo), F.when(v.isNull() | (v == 0) | F.isnan(v), DEFAULTS[c]).otherwise(v)))
    align = F.col("align") if "align" in specs.columns else F.lit(None)
    out["align"] = F.when(align.isin("left", "center", "right"), align).otherwise("left")
    for c, n in (("x", w), ("y", h)):
        if n is not None and c in specs.columns:
            out[c] = F.least(F.lit(n), F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0)) + 0.5).cast("int")))
    return specs.withColumns(out)


def layout_lines(content: Column, max_width: Column, advance: Column) -> Column:
    """Lines of a text: at its line feeds, then greedily at white space where a line would pass ``max_width``.

    White space stays inside a line and goes where it breaks; a word wider than
    a line keeps its own. A null text is one empty line; no positive width means no breaking.
    """

    def wrap(p: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            longer = F.concat(s["cur"], t)
            full = (F.char_length(longer) * advance > max_width) & (F.trim(F.regexp_replace(s["cur"], r"\s+", " ")) != "")
            broken = F.struct(F.concat(s["lines"], F.array(F.regexp_replace(s["cur"], r"\s+$", ""))).alias("lines"), F.regexp_replace(t, r"^\s+", "").alias("cur"))
            return F.when(full, broken).otherwise(F.struct(s["lines"].alias("lines"), longer.alias("cur")))

        start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))
        return F.aggregate(F.regexp_extract_all(p, F.lit(r"(\s+|\S+)"), F.lit(1)), start, step, lambda s: F.concat(s["lines"], F.array(s["cur"])))

    paragraphs = F.split(F.coalesce(content, F.lit("")), "\n")
    return F.when(F.coalesce(max_width, F.lit(0)) > 0, F.flatten(F.transform(paragraphs, wrap))).otherwise(paragraphs)


#: The cells of each glyph, row by row from the top; other characters are blank.
GLYPHS = {
    "A": "01110 10001 10001 11111 10001 10001 10001",
    "B": "11110 10001 10001 11110 10001 10001 11110",
    "C": "01110 10001 10000 10000 10000 10001 01110",
    "D": "11110 10001 10001 10001 10001 10001 11110",
    "E": "11111 10000 10000 11110 10000 10000 11111",
    "F": "11111 10000 10000 11110 10000 10000 10000",
    "G": "01110 10001 10000 10111 10001 10001 01111",
    "H": "10001 10001 10001 11111 10001 10001 10001",
    "I": "11111 00100 00100 00100 00100 00100 11111",
    "J": "00111 00010 00010 00010 00010 10010 01100",
    "K": "10001 10010 10100 11000 10100 10010 10001",
    "L": "10000 10000 10000 10000 10000 10000 11111",
    "M": "10001 11011 10101 10101 10001 10001 10001",
    "N": "10001 11001 10101 10011 10001 10001 10001",
    "O": "01110 10001 10001 10001 10001 10001 01110",
    "P": "11110 10001 10001 11110 10000 10000 10000",
    "Q": "01110 10001 10001 10001 10101 10010 01101",
    "R": "11110 10001 10001 11110 10100 10010 10001",
    "S": "01111 10000 10000 01110 00001 00001 11110",
    "T": "11111 00100 00100 00100 00100 00100 00100",
    "U": "10001 10001 10001 10001 10001 10001 01110",
    "V": "10001 10001 10001 10001 10001 01010 00100",
    "W": "10001 10001 10001 10101 10101 11011 10001",
    "X": "10001 10001 01010 00100 01010 10001 10001",
    "Y": "10001 10001 01010 00100 00100 00100 00100",
    "Z": "11111 00001 00010 00100 01000 10000 11111",
    "0": "01110 10001 10011 10101 11001 10001 01110",
    "1": "00100 01100 00100 00100 00100 00100 01110",
    "2": "01110 10001 00001 00010 00100 01000 11111",
    "3": "11110 00001 00001 01110 00001 00001 11110",
    "4": "00010 00110 01010 10010 11111 00010 00010",
    "5": "11111 10000 10000 11110 00001 00001 11110",
    "6": "01110 10000 10000 11110 10001 10001 01110",
    "7": "11111 00001 00010 00100 01000 01000 01000",
    "8": "01110 10001 10001 01110 10001 10001 01110",
    "9": "01110 10001 10001 01111 00001 00001 01110",
    "!": "00100 00100 00100 00100 00000 00100 00100",
    "?": "01110 10001 00001 00010 00100 00000 00100",
    ".": "00000 00000 00000 00000 00000 00110 00110",
    "-": "00000 00000 00000 11111 00000 00000 00000",
    "#": "01010 11111 01010 01010 11111 01010 00000",
    "%": "11001 11010 00010 00100 01000 01011 10011",
    " ": "00000 00000 00000 00000 00000 00000 00000",
}


def text_size(text: str, size: int, gap: float = 0.18, pad: int = 30) -> tuple[int, int]:
    """Width and height of a line of bitmap text."""
    cell, between = size // 9, math.floor(size * gap)
    return len(text) * (6 * cell + between) - between + 2 * pad, 8 * cell + 2 * pad


def bitmap_text(texts: DataFrame, size: int, color=(255, 214, 0), stroke=(0, 0, 0), gap: float = 0.18, pad: int = 30, rim: int | None = None, keys: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(keys, x, y, r, g, b, a): each text in capitals, its cells filled, with a rim of ``rim`` pixels around them.

    The rim is by default 0.22 of a cell; it ends at the text's box. A null or
    empty text has no pixels; rows with equal keys are drawn over each other.
    """
    cell, between = size // 9, math.floor(size * gap)
    rim = math.ceil(cell * 0.22) if rim is None else rim
    line = F.upper(F.coalesce(F.col(text), F.lit("")))
    lines = texts.select(*keys, line.alias("_line"))
    if keys:
        # a text grows a thousandfold as pixels, so tasks are not to be joined for being small
        lines = lines.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    apart = 2 * rim <= cell + between
    if apart:
        # one line to a key: its glyphs can't meet, so each pixel is made once; only other keys' pixels need to be brought together
        found = lines.groupBy(*keys).agg(F.min("_line").alias("_line"), F.max("_line").alias("_last"))
        mixed = found.filter("_line <> _last").select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.lit(0).alias("_one"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        lines = lines.join(mixed, same, "left_semi")
    shown = _glyph_pixels(lines, cell, between, pad, rim, keys).groupBy(*keys, "x", "y").agg(F.max("own").alias("own"))
    if apart:
        shown = _glyph_pixels(found.filter("_line = _last"), cell, between, pad, rim, keys).unionByName(shown)
    return shown.select(*keys, "x", "y", *[F.when(F.col("own"), c).otherwise(s).alias(k) for k, c, s in zip("rgb", color, stroke)], F.lit(255).alias("a"))


def _glyph_pixels(lines: DataFrame, cell: int, between: int, pad: int, rim: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, x, y, own): the pixels of each glyph of the lines (keys, _line), ``own`` in a cell, others in its rim."""
    lit = []
    for c, rows in GLYPHS.items():
        at: dict[tuple[int, int], bool] = {}
        for cy, row in enumerate(rows.split()):
            for cx, bit in enumerate(row):
                for dx in range(-rim, cell + rim) if bit == "1" else ():
                    for dy in range(-rim, cell + rim):
                        k = cx * cell + dx, cy * cell + dy
                        at[k] = at.get(k, False) or (0 <= dx < cell and 0 <= dy < cell)
        lit += [(c, *k, own) for k, own in at.items()]
    glyphs = F.broadcast(lines.sparkSession.createDataFrame(lit, "_glyph string, _dx int, y int, own boolean"))
    wide = F.char_length("_line") * (6 * cell + between) - between + 2 * pad
    chars = lines.select(*keys, wide.alias("_wide"), F.posexplode(F.split("_line", "")).alias("_n", "_glyph"))
    px = chars.join(glyphs, "_glyph").withColumn("x", pad + F.col("_n") * (6 * cell + between) + F.col("_dx"))
    high = 8 * cell + 2 * pad
    return px.filter((F.col("x") >= 0) & (F.col("x") < F.col("_wide")) & (F.col("y") >= 0) & (F.col("y") < high)).select(*keys, "x", "y", "own")
