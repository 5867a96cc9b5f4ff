"""Pointer strokes as a stream.

Two readings of one stream (doc, seq, ts, x, y, radius, hardness, r, g, b, a):
which tiles were touched in each window of time, and the frame itself, kept as
keyed state that stamps change in order of ``seq`` within a batch. A stroke that
comes after the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import LINEAR

TILE = 64


def tiles_of(strokes: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each tile (tx, ty) that a stamp reaches."""
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("radius") - 1) / tile).cast("int"), F.floor((F.col(c) + F.col("radius") + 1) / tile).cast("int"))
    out = strokes.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    return out.filter((F.col("tx") >= 0) & (F.col("ty") >= 0))


def dirty_tiles(strokes: DataFrame, window: str = "10 seconds", late: str = "30 seconds", tile: int = TILE) -> DataFrame:
    """(window, doc, tx, ty, n): stamps on each tile in each window of time, closed by the watermark."""
    rows = tiles_of(strokes.withWatermark("ts", late), tile)
    return rows.groupBy(F.window("ts", window), "doc", "tx", "ty").agg(F.count("*").alias("n"))


STATE = "pixels binary, last long"
OUT = "doc long, tx int, ty int, last long, painted long, pixels binary"


def _to_srgb(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 0, 1)
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.power(v, 1 / 2.4) - 0.055)


def stamp_tile(img: np.ndarray, ox: int, oy: int, s) -> None:
    """One brush stamp on a tile (side, side, 4) of bytes whose corner is (ox, oy)."""
    r = max(1.0, s.radius)
    jj, ii = np.mgrid[oy : oy + img.shape[0], ox : ox + img.shape[1]]
    d = np.hypot(ii - s.x, jj - s.y) / r
    aa = min(1.0, 1 / r)
    hard, soft = np.clip(1 - (d - (1 - aa)) / aa, 0, 1), np.power(np.clip(1 - d, 0, None), 1.6)
    cov = hard if s.hardness >= 1 else soft if s.hardness <= 0 else hard * s.hardness + soft * (1 - s.hardness)
    sa = np.floor(np.where(d <= 1, cov, 0) * (s.a / 255) * 255 + 0.5) / 255
    ba = img[:, :, 3] / 255
    ao = sa + ba * (1 - sa)
    table, safe = np.array(LINEAR), np.where(ao > 0, ao, 1)
    hit = sa > 0
    for k, v in enumerate((s.r, s.g, s.b)):
        mixed = (sa * table[int(v)] + (1 - sa) * ba * table[img[:, :, k]]) / safe
        img[:, :, k] = np.where(hit, np.floor(_to_srgb(mixed) * 255 + 0.5), img[:, :, k]).astype(np.uint8)
    img[:, :, 3] = np.where(hit, np.floor(ao * 255 + 0.5), img[:, :, 3]).astype(np.uint8)


def paint(strokes: DataFrame, tile: int = TILE, late: str = "30 seconds") -> DataFrame:
    """Tiles after each batch that touched them; a tile's bytes are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        doc, tx, ty = key
        img = np.zeros((tile, tile, 4), np.uint8)
        last = -1
        if state.exists:
            raw, last = state.get
            img = np.frombuffer(raw, np.uint8).reshape(tile, tile, 4).copy()
        todo = pd.concat(list(batches)).sort_values("seq")
        for s in todo.itertuples():
            stamp_tile(img, int(tx) * tile, int(ty) * tile, s)
            last = max(last, int(s.seq))
        state.update((img.tobytes(), last))
        yield pd.DataFrame({"doc": [doc], "tx": [tx], "ty": [ty], "last": [last], "painted": [int((img[:, :, 3] > 0).sum())], "pixels": [img.tobytes()]})

    rows = tiles_of(strokes.withWatermark("ts", late), tile)
    return rows.groupBy("doc", "tx", "ty").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def by_tool(strokes: DataFrame, tools: dict) -> dict[str, DataFrame]:
    """The stream split by tool; each goes to its own operator."""
    return {name: strokes.filter(F.col("tool").isin(list(kinds))) for name, kinds in tools.items()}


#: Every tool, by the operators that carry it out.
FAMILIES = {
    "stamp": ("brush", "pencil", "eraser", "clone", "healing", "dodge", "burn"),
    "sequential": ("blur", "sharpen", "smudge"),
    "region": ("fill", "wand", "magiceraser"),
    "selection": ("rect", "ellipse", "lasso", "polygonal"),
    "shape": ("gradient", "rectshape", "ellipseshape", "lineshape"),
    "layer": ("move", "text"),
    "read": ("picker",),
}


def route(events: DataFrame) -> DataFrame:
    """Events with ``family``: which operators a tool goes to; null for an unknown tool. Works on streams."""
    family = F.lit(None).cast("string")
    for name, tools in FAMILIES.items():
        family = F.when(F.col("tool").isin(*tools), name).otherwise(family)
    return events.withColumn("family", family)


def runs(events: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, run, family, first, last, n): a document's events in order of seq, cut where the family changes.

    A run goes to its operator as a whole; runs follow each other, since each
    reads what the one before has made. Unknown tools are left out.
    """
    order = Window.partitionBy(doc).orderBy("seq")
    known = route(events).filter("family IS NOT NULL")
    new = (F.lag("family").over(order).eqNullSafe(F.col("family"))).cast("int")
    cut = known.withColumn("cut", 1 - new).withColumn("run", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(doc, "run", "family").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))
