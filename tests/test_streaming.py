import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions.color import LINEAR
from rasterloom.operators import strokes as N
from rasterloom.streaming import strokes as T

SCHEMA = "doc long, seq long, ts timestamp, tool string, x double, y double, radius double, hardness double, r int, g int, b int, a int"
T0 = dt.datetime(2024, 1, 1)


def rows(n):
    rng = np.random.default_rng(2)
    return [(1, k, T0 + dt.timedelta(seconds=k), "brush", float(rng.uniform(0, 127)), float(rng.uniform(0, 127)), 6.0, 0.5, int(rng.integers(256)), 90, 30, 255) for k in range(n)]


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_paint_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(30), SCHEMA)
    for k in range(3):  # three batches, in order
        df.filter((F.col("seq") >= 10 * k) & (F.col("seq") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(spark, T.paint(stream), "painted", "update").toPandas()
    last = out.sort_values("last").groupby(["tx", "ty"]).tail(1)
    blank = spark.range(128 * 128).selectExpr("CAST(id % 128 AS INT) AS x", "CAST(id div 128 AS INT) AS y", "0 AS r", "0 AS g", "0 AS b", "0 AS a")
    stamps = df.select("seq", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius", "hardness", "r", "g", "b", "a", F.lit(1.0).alias("alpha"))
    want = np.zeros((192, 192, 4), int)
    for r in N.apply_stamps(blank, stamps, 128, 128).collect():
        want[r["y"], r["x"]] = r[2:]
    for r in last.itertuples():
        if r.tx < 2 and r.ty < 2:
            got = np.frombuffer(r.pixels, np.uint8).reshape(64, 64, 4)
            assert (got == want[r.ty * 64 : r.ty * 64 + 64, r.tx * 64 : r.tx * 64 + 64]).all()
    assert len(LINEAR) == 256


def test_dirty_tiles(spark, tmp_path):
    df = spark.createDataFrame(rows(40), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = run(spark, T.dirty_tiles(stream, "10 seconds", "1 second"), "dirty", "append")
    want = T.tiles_of(df).groupBy(F.window("ts", "10 seconds"), "doc", "tx", "ty").count()
    got = {(r["window"]["start"], r["tx"], r["ty"]): r["n"] for r in out.collect()}
    full = {(r["window"]["start"], r["tx"], r["ty"]): r["count"] for r in want.collect()}
    assert got and all(full[k] == v for k, v in got.items())
    assert T0 in {k[0] for k in got}


def test_split_by_tool(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    parts = T.by_tool(df, {"paint": ["brush", "pencil"], "other": ["smudge"]})
    assert parts["paint"].count() == 3 and parts["other"].count() == 0


def test_runs_of_tools(spark):
    tools = ["brush", "eraser", "blur", "what", "smudge", "fill", "brush"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(tools)] + [(2, 9, None)], "doc int, seq long, tool string")
    got = [tuple(r) for r in T.runs(df).select("run", "family", "first", "last", "n").orderBy("run").collect()]
    assert got == [(1, "stamp", 0, 1, 2), (2, "sequential", 2, 4, 2), (3, "region", 5, 5, 1), (4, "stamp", 6, 6, 1)]
    assert sum(map(len, T.FAMILIES.values())) == 24
