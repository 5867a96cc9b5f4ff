"""Undo and redo over an append-only log.

The log (doc, seq, kind, ...) is the only thing written; kinds are push, undo
and redo. Which pushes are in force follows from folding a document's log in
order. A frame's state is then, for each key, the value of the last push in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 300


def in_force(log: DataFrame, limit: int = LIMIT, doc: str = "doc") -> DataFrame:
    """(doc, done, redo): the pushes in force and those that can be redone, oldest first; the oldest beyond ``limit`` are fixed and can't be undone."""
    ops = log.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("ops"))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("done"), none.alias("redo"))

    def last(a: Column) -> Column:
        return F.slice(a, -1, 1)

    def but_last(a: Column) -> Column:
        return F.slice(a, 1, F.size(a) - 1)

    def step(s: Column, o: Column) -> Column:
        pushed = F.concat(s["done"], F.array(o["seq"].cast("bigint")))
        pushed = F.when(F.size(pushed) > limit, F.slice(pushed, F.size(pushed) - limit + 1, limit)).otherwise(pushed)
        return (
            F.when(o["kind"] == "push", F.struct(pushed.alias("done"), none.alias("redo")))
            .when((o["kind"] == "undo") & (F.size(s["done"]) > 0), F.struct(but_last(s["done"]).alias("done"), F.concat(s["redo"], last(s["done"])).alias("redo")))
            .when((o["kind"] == "redo") & (F.size(s["redo"]) > 0), F.struct(F.concat(s["done"], last(s["redo"])).alias("done"), but_last(s["redo"]).alias("redo")))
            .otherwise(s)
        )

    folded = ops.withColumn("s", F.aggregate("ops", start, step))
    return folded.select(doc, F.col("s.done").alias("done"), F.col("s.redo").alias("redo"))


def to_depth(depth: int, at: int) -> list[str]:
    """The undo or redo steps from depth ``at`` to ``depth``."""
    return ["undo"] * (at - depth) if depth < at else ["redo"] * (depth - at)


def labels(log: DataFrame, base: str = "Open", limit: int = LIMIT, doc: str = "doc") -> DataFrame:
    """(doc, depth, label): the states a document can go back to, ``base`` at depth 0; the log has a label for each push.

    A document without a push in force has its base alone.
    """
    done = in_force(log, limit, doc).select(doc, "done")
    named = done.select(doc, F.posexplode("done").alias("at", "seq")).join(log.select(doc, "seq", "label"), [doc, "seq"])
    return done.select(doc, F.lit(0).alias("depth"), F.lit(base).alias("label")).unionByName(named.select(doc, (F.col("at") + 1).alias("depth"), "label"))


def restore(log: DataFrame, snapshots: DataFrame, limit: int = LIMIT, doc: str = "doc") -> DataFrame:
    """The rows of ``snapshots`` (doc, seq, ...) that hold now: those of the last push in force, or of seq 0 before any.

    Each push has the rows of its document as they are after it; undoing a push
    goes back to the one before. Undo can't pass the last push beyond ``limit``,
    so seq 0 then means the state after that one.
    """
    last = F.coalesce(F.try_element_at("done", F.lit(-1)), F.lit(0).cast("bigint"))
    return snapshots.join(in_force(log, limit, doc).select(doc, last.alias("seq")), [doc, "seq"], "left_semi")


def capture_tiles(px: DataFrame, keys: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """(keys, tx, ty, cells): a frame as its tiles that hold anything; a tile is one array of its pixels that are not clear."""
    at = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in ("x", "y")]
    return px.filter("a > 0").select(*keys, *at, F.struct("y", "x", "r", "g", "b", "a").alias("v")).groupBy(*keys, "tx", "ty").agg(F.sort_array(F.collect_list("v")).alias("cells"))


def restore_tiles(tiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pixels of captured tiles."""
    return tiles.select(*keys, F.explode("cells").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in "xyrgba"])


def written(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A copy of a frame in which ``changes`` (keys, x, y, r, g, b, a) hold; the frame stays as it is, and both share what is equal."""
    at = [*keys, "x", "y"]
    cols = [*at, *"rgba"]
    return base.select(cols).join(changes.select(at), at, "left_anti").unionByName(changes.select(cols))


def latest(log: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Last value of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, "seq").alias(value))


def state(log: DataFrame, keys: tuple[str, ...], value: str, limit: int = LIMIT, doc: str = "doc") -> DataFrame:
    """Last value in force of each key of a document."""
    live = in_force(log, limit, doc).select(doc, F.explode("done").alias("seq"))
    return latest(log.filter(F.col("kind") == "push").join(live, [doc, "seq"], "left_semi"), (doc, *keys), value)


def insert_layer(layers: DataFrame, z: int, row: DataFrame) -> DataFrame:
    """Layers (z, ...) with ``row`` at ``z``; those above move up."""
    moved = layers.withColumn("z", F.when(F.col("z") >= z, F.col("z") + 1).otherwise(F.col("z")))
    return moved.unionByName(row.withColumn("z", F.lit(z)))


def remove_layer(layers: DataFrame, z: int) -> DataFrame:
    return layers.filter(F.col("z") != z).withColumn("z", F.when(F.col("z") > z, F.col("z") - 1).otherwise(F.col("z")))


def reorder_layer(layers: DataFrame, frm: int, to: int) -> DataFrame:
    between = F.col("z").between(min(frm, to), max(frm, to))
    step = 1 if to < frm else -1
    return layers.withColumn("z", F.when(F.col("z") == frm, to).when(between, F.col("z") + step).otherwise(F.col("z")))


def rename_layer(layers: DataFrame, z: int, to: str) -> DataFrame:
    """An empty name changes nothing."""
    return layers.withColumn("name", F.when((F.col("z") == z) & F.lit(to != ""), F.lit(to)).otherwise(F.col("name")))


def toggle_layer(layers: DataFrame, z: int, flag: str) -> DataFrame:
    """``flag`` (visible, clip, ...) of one layer turned over; a null flag counts as false."""
    return layers.withColumn(flag, F.when(F.col("z") == z, ~F.coalesce(F.col(flag), F.lit(False))).otherwise(F.col(flag)))


def duplicate_layer(layers: DataFrame, z: int) -> DataFrame:
    """A copy just above; those above move up."""
    copies = F.when(F.col("z") == z, F.array(F.lit(0), F.lit(1))).when(F.col("z") > z, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    return layers.withColumn("up", F.explode(copies)).withColumn("z", F.col("z") + F.col("up")).drop("up")


def group_layer(layers: DataFrame, z: int, name: str = "Group") -> DataFrame:
    """One layer (z, kind, name, ...) between the marks of a new group; without such a layer nothing changes.

    Columns of the marks other than these, opacity and visible are null.
    """
    here = layers.filter(F.col("z") == z).limit(1)
    moved = layers.withColumn("z", F.col("z") + F.when(F.col("z") > z, 2).when(F.col("z") == z, 1).otherwise(0))
    known = {"name": F.lit(name), "opacity": F.lit(1.0), "visible": F.lit(True)}
    typed = lambda c, v: v.cast(layers.schema[c].dataType).alias(c)
    for kind, at in (("group", z), ("end", z + 2)):
        values = known | {"z": F.lit(at), "kind": F.lit(kind)}
        moved = moved.unionByName(here.select(*[typed(c, values.get(c, F.lit(None))) for c in layers.columns]))
    return moved


def allocated_tiles(px: DataFrame, keys: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """Tiles with at least one pixel that is not clear, and the bytes they take."""
    t = px.filter("a > 0").select(*keys, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).distinct()
    return t.groupBy(*keys).agg(F.count("*").alias("tiles")).withColumn("bytes", F.col("tiles") * (tile * tile * 4))


def memory_estimate(w: int, h: int, layers: int, tile: int = 256) -> dict[str, int]:
    """Bytes of a document when every layer and the result are full, by tile and as plain buffers."""
    tiles = -(-w // tile) * -(-h // tile)
    return {"tiled": tiles * tile * tile * 4 * (layers + 1), "plain": w * h * 4 * (layers + 1)}


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.2f} GB"
