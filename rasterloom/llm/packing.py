"""Harmonic packing of token sequences.

A document's length is cut greedily into pieces whose sizes are a whole share of
the capacity: floor(C / k) for a class k. A bin of class k holds exactly k such
pieces, so a bin is full by construction, and which bin a piece goes to follows
from its rank in the class alone: workers fill bins independently, each from the
prefix sum of the counts before it. What stays over in each class (less than one
bin a class, so a bounded number of tokens whatever the input) is laid end to
end, cut into whole bins, and the last of it into powers of two.

Cases: null text counts as empty and still has its end id; repeated rows are
packed each; rows of null id are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, tidy
from .tokens import END, encoder

CAPACITY = 4096
#: Classes whose full bins leave more padding than this are not used, but for pieces of at most SMALL tokens:
#: a bin of these pads less than one piece, and what is left of a document then stays whole.
MAX_PAD, SMALL = 4, 63


@lru_cache
def sizes(capacity: int = CAPACITY, max_pad: int = MAX_PAD) -> tuple[tuple[int, int], ...]:
    """(piece size, pieces in a bin), largest first; size 1 is always there, so every length can be cut."""
    best: dict[int, int] = {}
    for k in range(1, capacity + 1):
        s = capacity // k
        if capacity - k * s <= max_pad or s <= min(SMALL, capacity // 64):
            best[s] = max(best.get(s, 0), k)
    return tuple(sorted(best.items(), reverse=True))


def cut(n: int, capacity: int = CAPACITY, max_pad: int = MAX_PAD) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` tokens."""
    out, at = [], 0
    for s, k in sizes(capacity, max_pad):
        while n - at >= s:
            out.append((at, s, k))
            at += s
    return out


_PIECE = pa.schema([(c, pa.int32() if c == "k" else pa.int64()) for c in ("doc_id", "start", "length", "k", "doc_tokens", "ids_crc32", "h")])


def pieces(docs: DataFrame, vocab: str, spaced: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, k, doc_tokens, ids_crc32, row): every id of every document once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab, spaced), np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, h, blob in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), enc.encode(t.as_py() for t in b.column("t"))):
                blob += end
                n = len(blob) // 4
                rows += [(i, a, s, k, n, zlib.crc32(blob[4 * a : 4 * (a + s)]), h) for a, s, k in cut(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_PIECE), _PIECE.types)], schema=_PIECE)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("id", "t"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, k int, doc_tokens long, ids_crc32 long, h long")


def _tail(left: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Lay pieces (key, length) end to end: (key, offset in the piece, sequence, offset there, ...).

    Whole sequences first; the rest, short of one, is split into powers of two.
    """
    total = sum(n for _, n in left)
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    out, seq, used = [], 0, 0
    for key, n in left:
        at = 0
        while at < n:
            take = min(n - at, room[seq] - used)
            out.append((key, at, take, seq, used))
            at, used = at + take, used + take
            if used == room[seq]:
                seq, used = seq + 1, 0
    return out


def ranked_in_class(cuts: DataFrame) -> DataFrame:
    """Each row of ``pieces`` with its rank in its class: counts of the groups before it, then its place in its own group."""
    buckets = parts(cuts, 4)
    rows = cuts.withColumn("g", F.pmod(F.xxhash64("h", "start"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("g", "k").orderBy("h", "start", "ids_crc32")
    rows = rows.withColumn("i", F.row_number().over(own) - 1)
    counts = rows.groupBy("g", "k").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("k")
    counts = counts.select("g", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(every).alias("total"))
    return rows.join(counts, ["g", "k"]).withColumn("rank", F.col("base") + F.col("i"))


def packed(docs: DataFrame, vocab: str, spaced: bool = False, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` tokens: one row for each piece.

    Sequence ids: bins of class k are numbered after those of the larger
    sizes; the leftovers' sequences come last.
    """
    spark = docs.sparkSession
    ranked = materialize(ranked_in_class(materialize(pieces(docs, vocab, spaced, id_col, text), "pieces")), "ranked")
    totals = {r["k"]: r["total"] for r in ranked.groupBy("k").agg(F.max("total").alias("total")).collect()}  # one row a class
    first, base = {}, 0
    for k in sorted(totals):
        first[k] = base
        base += totals[k] // k
    if not totals:
        return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    starts = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    full = F.col("rank") < F.col("total") - F.col("total") % F.col("k")
    bins = ranked.filter(full).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (starts[F.col("k")] + F.floor(F.col("rank") / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("rank") % F.col("k") * F.col("length")).cast("long").alias("offset"),
    )
    # fewer than k pieces of each class k: bounded by the capacity, not by the input
    rest = ranked.filter(~full).orderBy("k", "rank").collect()
    plan = _tail([(j, r["length"]) for j, r in enumerate(rest)], capacity)
    whole = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rest]
    split = {j for j, at, take, _, _ in plan if take != whole[j][2]}
    tail = [(*whole[j], base + seq, off) for j, at, take, seq, off in plan if j not in split]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = bins.unionByName(spark.createDataFrame(tail, schema))
    todo = [(rest[j]["h"], whole[j][1] + at, take, whole[j][4], base + seq, off) for j, at, take, seq, off in plan if j in split]
    if todo:
        out = out.unionByName(_split(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")), vocab, spaced, todo))
    return out


def _split(docs: DataFrame, vocab: str, spaced: bool, todo: list[tuple]) -> DataFrame:
    """Pieces cut once more: at most one for each leftover sequence; their documents are encoded again for the checksums."""
    spark = docs.sparkSession
    by: dict[int, list] = {}
    for h, *x in todo:
        by.setdefault(h, []).append(x)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(vocab, spaced), np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, h, blob in zip(b["id"], b["h"], enc.encode(b["t"])):
                blob += end
                rows += [(i, a, n, zlib.crc32(blob[4 * a : 4 * (a + n)]), whole, seq, off) for a, n, whole, seq, off in by[h]]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.withColumn("h", F.xxhash64("id", "t"))
    keys = spark.createDataFrame([(h,) for h in by], "h long")
    hit = rows.join(F.broadcast(keys), "h").dropDuplicates(["h"])
    return hit.select("id", "t", "h").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
