"""Image files as tables, and tables as image files.

Reading is a ``binaryFile`` scan, so paths, partition columns and size filters
are Spark's; decoding runs batch by batch beside it. A file that can't be
decoded gives a row with its error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs

FRAMES = "path string, format string, w int, h int, data binary, error string"
#: Pixels of a strip of a frame that is too high for one file; strips are a multiple of this many rows, whole blocks of every format.
STRIP_PIXELS, STRIP_STEP = 1 << 20, 16


def sniff(content):
    """Format of a binary column, by leading bytes."""
    out = F.when(F.substring(content, 1, 4).eqNullSafe(F.lit(b"RIFF")) & F.substring(content, 9, 4).eqNullSafe(F.lit(b"WEBP")), "webp")
    for magic, name in codecs.MAGIC:
        out = out.when(F.substring(content, 1, len(magic)).eqNullSafe(F.lit(magic)), name)
    return out


def decode(files: DataFrame) -> DataFrame:
    """(path, format, w, h, data, error) of rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                kind = codecs.sniff(bytes(content))
                try:
                    rows.append((path, kind, *codecs.decode(bytes(content)), None))
                except codecs.FormatError as e:
                    rows.append((path, kind, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["path", "format", "w", "h", "data", "error"])
            yield out.astype({"w": "Int32", "h": "Int32"})

    return files.select("path", "content").mapInPandas(run, FRAMES)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def to_pixels(frames: DataFrame, key: str = "path", drop_clear: bool = True) -> DataFrame:
    """(key, x, y, r, g, b, a) of frames (key, w, h, data), in the JVM: a row of bytes, then a row for each pixel."""
    byte = lambda k: F.conv(F.hex(F.substring(F.col("line"), F.col("x") * 4 + 1 + k, 1)), 16, 10).cast("int")
    lines = frames.filter("data is not null").select(key, "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    lines = lines.select(key, "w", "y", F.substring(F.col("data"), F.col("y") * F.col("w") * 4 + 1, F.col("w") * 4).alias("line"))
    rows = lines.select(key, "y", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    out = rows.select(key, "x", "y", *[byte(k).alias(c) for k, c in enumerate("rgba")])
    return out.filter("a > 0") if drop_clear else out


def _file(pdf: pd.DataFrame, kind: str, w: int, h: int, top: int = 0) -> bytes:
    """An image of the h rows from ``top``."""
    img = np.zeros((h, w, 4), np.uint8)
    img[pdf["y"].to_numpy(int) - top, pdf["x"].to_numpy(int)] = pdf[list("rgba")].to_numpy()
    return codecs.encode(kind, w, h, img.tobytes())


def encode(pixels: DataFrame, kind: str, w: int, h: int, key: str = "doc_id") -> DataFrame:
    """(key, content): each frame's pixels as one image file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [_file(pdf, kind, w, h)]})

    return pixels.groupBy(key).applyInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, content binary")


def strip_height(w: int, h: int) -> int:
    """Rows of one file: all of them if a file may be that high."""
    if h <= codecs.MAX_EDGE and w * h <= codecs.MAX_PIXELS:
        return h
    return max(STRIP_STEP, min(codecs.MAX_EDGE, STRIP_PIXELS // max(1, w)) // STRIP_STEP * STRIP_STEP)


def encode_strips(pixels: DataFrame, kind: str, w: int, h: int, key: str = "doc_id") -> DataFrame:
    """(key, top, content): each frame as image files of its rows from ``top``, for frames of any height.

    A frame that one file may hold is one file; a higher one is cut into strips
    of ``strip_height`` rows, each a task of its own. Clear strips are files too.
    """
    high = strip_height(w, h)
    clear = [F.lit(0).alias(c) for c in "rgba"]
    every = pixels.select(key).distinct().select(key, F.lit(-1).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(h - 1), F.lit(high))).alias("y"), *clear)
    rows = pixels.select(key, *[F.col(c).cast("int").alias(c) for c in ("x", "y", *"rgba")]).unionByName(every)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf["top"].iloc[0])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "top": [top], "content": [_file(pdf[pdf["x"] >= 0], kind, w, min(high, h - top), top)]})

    tops = rows.withColumn("top", (F.floor(F.col("y") / high) * high).cast("int"))
    return tops.groupBy(key, "top").applyInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, top int, content binary")


def write_images(encoded: DataFrame, folder: str, kind: str, key: str = "doc_id") -> DataFrame:
    """Files named by key in a folder that all workers share; each appears whole, and a repeated task replaces its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        fsys, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fsys.create_dir(root, recursive=True)
        for b in batches:
            for k, content in zip(b[key], b["content"]):
                temp = f"{root}/.{uuid.uuid4().hex}"
                with fsys.open_output_stream(temp) as out:
                    out.write(bytes(content))
                fsys.move(temp, f"{root}/{k}.{kind}")
            yield pd.DataFrame({"file": [f"{folder}/{k}.{kind}" for k in b[key]], "bytes": [len(c) for c in b["content"]]})

    return encoded.mapInPandas(run, "file string, bytes long")
