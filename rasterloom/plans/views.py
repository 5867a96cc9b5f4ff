"""Raster views over the star-schema tables, for both engines.

``scan``: one frame 64 wide, a row for each embedding, as arrays by channel;
``pixels`` the same, a row for each pixel; ``layers``: up to seven layers from
line items; ``strokes`` and ``palette`` from events and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, r, g, b, a): a channel of a row is an array of bytes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 0.6) * 212.5))).cast("int"))
    q = e.select(F.col("vec_id").cast("int").alias("y"), v.alias("q"))
    half = WIDTH // 2
    return q.select(
        "y",
        F.col("q").alias("r"),
        F.reverse("q").alias("g"),
        F.concat(F.slice("q", half + 1, half), F.slice("q", 1, half)).alias("b"),
        F.array_repeat(F.lit(255), WIDTH).alias("a"),
    )


def height(spark: SparkSession, sf_dir: str) -> int:
    return int(spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]) + 1


def explode_scan(rows: DataFrame, keys: tuple[str, ...] = ("y",), channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """A row for each pixel of a row of arrays."""
    zipped = F.posexplode(F.arrays_zip(*channels)).alias("x", "v")
    return rows.select(*keys, zipped).select("x", *keys, *[F.col(f"v.{c}").alias(c) for c in channels])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_scan(scan(spark, sf_dir))


PIXELS = f"""
SELECT x::INT AS x, y, q[x + 1] AS r, q[{WIDTH} - x] AS g, q[(x + {WIDTH // 2}) % {WIDTH} + 1] AS b, 255 AS a
FROM (SELECT vec_id::INT AS y,
        list_transform(embedding, lambda v: floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (v::DOUBLE + 0.6::DOUBLE) * 212.5::DOUBLE)))::INT) AS q
      FROM embeddings),
  (SELECT unnest(range({WIDTH})) AS x)
"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, r, g, b, a): z is 1 to 7."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = t.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d")
    )
    up = lambda c, k: F.floor(F.col(c) * k + 0.5)
    return g.select(
        (F.col("l_orderkey") % 128).cast("int").alias("x"),
        F.expr("CAST(l_orderkey div 128 AS INT)").alias("y"),
        F.col("l_linenumber").cast("int").alias("z"),
        up("q", 5.0).cast("int").alias("r"),
        (up("t", 2550.0) % 256).cast("int").alias("g"),
        (F.floor("p") % 256).cast("int").alias("b"),
        F.least(F.lit(255), up("d", 2550.0)).cast("int").alias("a"),
    )


LAYERS = """
SELECT (l_orderkey % 128)::INT AS x, (l_orderkey // 128)::INT AS y, l_linenumber::INT AS z,
  floor(max(l_quantity) * 5.0::DOUBLE + 0.5::DOUBLE)::INT AS r, (floor(max(l_tax) * 2550.0::DOUBLE + 0.5::DOUBLE)::BIGINT % 256)::INT AS g,
  (floor(max(l_extendedprice))::BIGINT % 256)::INT AS b, least(255, floor(max(l_discount) * 2550.0::DOUBLE + 0.5::DOUBLE)::BIGINT)::INT AS a
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, tool, x, y, k): pointer events on a canvas 64 by 500."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("tool"),
        (F.col("user_id") % 64).cast("int").alias("x"),
        (F.floor("value") % 500).cast("int").alias("y"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"),
    )


STROKES = """
SELECT event_id AS seq, ts, event_type AS tool, (user_id % 64)::INT AS x, (floor(value)::BIGINT % 500)::INT AS y,
  coalesce(json_extract_string(props, '$.k')::INT, 0) AS k FROM events
"""


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, r, g, b): one colour for each part size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = p.groupBy("p_size").agg(F.min("p_partkey").alias("k"), F.min("p_retailprice").alias("v"))
    return one.select(
        F.col("p_size").alias("idx"), (F.col("k") % 256).cast("int").alias("r"), (F.floor("v") % 256).cast("int").alias("g"), (F.floor(F.col("v") / 8.0) % 256).cast("int").alias("b")
    )


PALETTE = """
SELECT p_size AS idx, (min(p_partkey) % 256)::INT AS r, (floor(min(p_retailprice))::BIGINT % 256)::INT AS g,
  (floor(min(p_retailprice) / 8.0::DOUBLE)::BIGINT % 256)::INT AS b FROM part GROUP BY p_size
"""
