"""Near-duplicate detection with MinHash, banding and connected components.

A document is the set of its distinct five-word shingles (the whole sequence
where it has fewer words). Equal sets are folded first: one class for each set,
so exact copies cost one row however many there are. For each class 320
universal hash minima are taken; 64 bands of five propose partners. A proposal is
held against the signatures, and what may reach the threshold is confirmed on
the full sets: 100 * intersection >= 75 * union. Components come from
alternating large-star and small-star steps.

Buckets are not expanded into all their pairs. Each class is first held against
the least member (the hub) of its buckets, by signature alone and loosely
(``LOOSE``); this gathers classes into families. A class that shares a bucket with
a hub of another family is that family's guest, so any two members of a bucket
meet in the family of its hub. There the full sets decide: members and guests
meet in blocks of bounded size, a block compares as many of them with all others
as are needed until one component is left besides those that have been compared,
and returns a spanning set of links. A family of several blocks shares its least
members between them; what then stands outside its largest component is compared
with every block. So the members of a hot group are sent once, its stragglers
once for each block, and no link between two components is missed. Nothing is
capped.

A pair at similarity 0.75 agrees in no band with probability
(1 - 0.75^5)^64 = 3e-8; every pair that agrees in one is decided on full sets.

Cases: null or blank text has an empty set, is linked with nothing and kept; null
ids are returned with a null component and kept; repeated rows with one id are
one node, linked by any of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy
from .text import mix, sequences, word_hashes

SHINGLE = 5
ROWS, BANDS = 5, 64
HASHES = ROWS * BANDS
#: Similarity as a fraction of whole numbers: NUM / DEN.
NUM, DEN = 75, 100
#: Signatures that agree this much put two classes into one family.
LOOSE = 0.45
#: Shingles that one block of a family holds; members that all its blocks share.
CELLS, PIVOTS = 1_000_000, 32
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)
_BLOCK = 128


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text)
    return np.unique(sequences(w, min(n, len(w)))) if len(w) else w


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima over a non-empty set."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    room = np.empty((_BLOCK, HASHES), np.uint32)
    for i in range(0, len(x), _BLOCK):
        part = x[i : i + _BLOCK, None]
        h = np.multiply(part, _A, out=room[: len(part)])
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return low


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        h = mix(h + rows[:, j])
    return h.view(np.int64)


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both) > 0


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set, sig, bands): ``set`` digests the shingle set; ``sig`` has the low byte of each minimum."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sets, sigs, keys = [], [], [], []
            for t in b.column("t"):
                s = shingles(t.as_py())
                n.append(len(s))
                sig = signature(s) if len(s) else None
                sets.append(digest(s) if len(s) else None)
                sigs.append(sig.astype(np.uint8).tobytes() if len(s) else None)
                keys.append(bands(sig) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set", "sig", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set binary, sig binary, bands array<long>")


# -- connected components ----------------------------------------------------


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    near = _both(e)
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for nodes of ``edges`` (u, v); least nodes themselves are not listed."""
    e = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        e = materialize(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


# -- candidates ---------------------------------------------------------------


def _alike(pairs: DataFrame, classes: DataFrame, least: float = LOOSE) -> DataFrame:
    """Pairs (a, b) whose signatures agree in the share ``least``."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                one = np.frombuffer(b"".join(x["sig_a"]), np.uint8).reshape(len(x), HASHES)
                two = np.frombuffer(b"".join(x["sig_b"]), np.uint8).reshape(len(x), HASHES)
                yield x.loc[(one == two).mean(axis=1) >= least, ["a", "b"]]

    return rows.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


class _Union:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.root = np.array([first.setdefault(c, i) for i, c in enumerate(labels)])

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up


def spanning(sets: list[np.ndarray], labels: list[int], todo: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join everything which is linked on the full sets, given what ``labels`` already join.

    A member compared with all others needs no second look. Without ``todo``,
    members are taken until those left all belong to one component; with it,
    those marked are taken.
    """
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    mark = np.zeros(codes.max() + 1, np.int32)
    union, out, done = _Union(labels), [], np.zeros(len(sets), bool)
    queue = np.flatnonzero(todo).tolist() if todo is not None else None
    while True:
        if queue is not None:
            if not queue:
                return out
            i = queue.pop()
        else:
            roots = union.roots()
            main = np.bincount(roots).argmax()
            left = np.flatnonzero(~done & (roots != main)) if done.any() else np.arange(len(sets))
            if not len(left):
                return out
            i = int(left[0])
        done[i] = True
        own = codes[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], start)
        mark[own] = 0
        for j in np.flatnonzero(DEN * both >= NUM * (size + size[i] - both)).tolist():
            x, y = union.find(i), union.find(j)
            if x != y:
                union.root[max(x, y)] = min(x, y)
                out.append((i, j))


def _linked_in_groups(rows: DataFrame, n: int) -> DataFrame:
    """Links (u, v) found in each group (f, i, r) of rows (f, i, r, rep, c, todo, set, text); groups are streamed one by one."""

    def solve(group: list[tuple]) -> tuple[list[int], list[int]]:
        members: dict[tuple[int, bytes], tuple] = {}  # an id with several texts has several sets, all with its label
        for rep, c, todo, digest_, text in group:
            found = shingles(text)
            if len(found) and digest(found) == digest_:
                old = members.get((rep, digest_))
                members[rep, digest_] = (found, c, todo or bool(old and old[2]))
        keys = sorted(members)
        if len(keys) < 2:
            return [], []
        marks = [members[k][2] for k in keys]
        links = spanning([members[k][0] for k in keys], [members[k][1] for k in keys], marks if any(marks) else None)
        return [keys[i][0] for i, _ in links], [keys[j][0] for _, j in links]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        us: list[int] = []
        vs: list[int] = []

        def flush():
            u, v = solve(group)
            us.extend(u)
            vs.extend(v)

        for b in batches:
            f, i, r, *rest = [b.column(c) for c in ("f", "i", "r", "rep", "c", "todo", "set", "text")]
            for k, x in enumerate(zip(f.to_pylist(), i.to_pylist(), r.to_pylist())):
                if x != key:
                    if group:
                        flush()
                    key, group = x, []
                group.append(tuple(c[k].as_py() for c in rest))
        if group:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = rows.select("f", "i", "r", "rep", "c", "todo", "set", "text")
    return rows.repartition(n, "f", "i", "r").sortWithinPartitions("f", "i", "r").mapInArrow(run, "u long, v long")


def _family_links(families: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join each component inside each family; ``families``: (rep, f), guests included."""
    n = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = families.join(classes.select("rep", "set", "n_shingles"), "rep")
    sums = rows.groupBy("f").agg(F.sum("n_shingles").alias("cells"), F.count("*").alias("m")).filter("m > 1")
    sums = sums.select("f", F.ceil(F.col("cells") / CELLS).cast("int").alias("blocks"))
    rows = materialize(rows.join(sums, "f").withColumn("i", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "families")
    text = texts.select(F.col("doc_id").alias("rep"), "text")

    # members once, and of families with several blocks the least members in each
    low = Window.partitionBy("f", "i").orderBy("rep")
    wide = rows.filter("blocks > 1")
    pivots = wide.withColumn("k", F.row_number().over(low)).filter(F.col("k") <= F.ceil(F.lit(PIVOTS) / F.col("blocks")))
    pivots = pivots.select("rep", "f", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    once = rows.select("rep", "f", "set", "i").union(pivots).distinct().withColumns({"r": F.lit(0), "c": F.col("rep"), "todo": F.lit(False)})
    links = materialize(_linked_in_groups(once.join(text, "rep"), n), "family-links")
    if wide.isEmpty():
        return links

    # stragglers of families with several blocks against every block
    label = components(links)
    at = wide.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    count = at.groupBy("f", "c").agg(F.count("*").alias("n"))
    main = count.groupBy("f").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    at = materialize(at.join(main, "f").select("rep", "f", "set", "i", "c", "blocks", "n_shingles", (F.col("c") != F.col("main")).alias("todo")), "stragglers")
    chunks = at.filter("todo").groupBy("f").agg(F.ceil(F.sum("n_shingles") / CELLS).cast("int").alias("chunks"))
    at = at.join(chunks, "f")
    every = at.select("rep", "f", "set", "c", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("r"), F.lit(False).alias("todo"))
    own = F.pmod(F.xxhash64(F.lit(1), "rep"), "chunks").cast("int").alias("r")
    rest = at.filter("todo").select("rep", "f", "set", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), own, F.lit(True).alias("todo"))
    both = every.select("rep", "f", "set", "c", "i", "r", "todo").union(rest.select("rep", "f", "set", "c", "i", "r", "todo"))
    return links.union(materialize(_linked_in_groups(both.join(text, "rep"), n), "family-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    rows = materialize(signed(docs, id_col, text), "signed")
    full = rows.filter("doc_id is not null and n_shingles > 0")
    # written first, so that the join below has two plain inputs and a hot set can be split
    heads = materialize(full.groupBy("set").agg(F.min("doc_id").alias("rep")), "heads")
    member = materialize(full.select("doc_id", "set").join(heads, "set").select("doc_id", "set", "rep"), "members")
    classes = full.join(member.filter("doc_id = rep").select("doc_id", "set").distinct(), ["doc_id", "set"]).withColumnRenamed("doc_id", "rep")
    classes = materialize(classes.dropDuplicates(["rep", "set"]), "classes")

    keyed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top")
    buckets = materialize(keyed.join(shared.select("key", "hub"), "key"), "buckets")
    needed = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(needed, "doc_id", "left_semi")
    texts = materialize(texts, "texts")

    # families: each class with the hub that shares most of its buckets, if they are alike at all
    hubs = buckets.filter("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("n"))
    hubs = materialize(hubs, "hubs")
    near = materialize(_alike(hubs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), classes), "near")
    family = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = lambda x: family.select(F.col("node").alias(x), F.col("component").alias(f"f_{x}"))
    met = hubs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = met.select("a", "b", F.coalesce("f_a", "a").alias("f_a"), F.coalesce("f_b", "b").alias("f_b"))
    groups = met.select(F.col("a").alias("rep"), F.col("f_b").alias("f")).union(met.select("b", "f_b")).union(met.select("a", "f_a"))
    roots = family.select(F.col("component").alias("rep"), F.col("component").alias("f"))
    links = _family_links(groups.union(roots).distinct(), classes, texts)

    # an id with several texts ties its classes together
    tie = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).filter("u > v")
    links = links.union(member.join(tie.select("doc_id", "v"), "doc_id").filter("rep > v").select(F.col("rep").alias("u"), "v"))
    label = components(links)
    comp = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    comp = comp.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
