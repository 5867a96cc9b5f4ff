"""Exact document fingerprints.

A text is made canonical (Unicode NFKC, lower case, white space folded to single
spaces, ends trimmed) and digested by two xxhash64 with different seeds: 128
bits. Equal digests only propose a group; inside a bucket the canonical bytes
are compared, so a collision never joins two texts.

The engine's own SQL function ``java_method`` calls the Unicode library that
Spark ships, so normalising stays in the JVM.

Cases: a null text counts as empty, and all empty texts share one fingerprint;
rows repeated in the input are kept, each with the same fingerprint; null ids
sort first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, parts

NORMALIZER = "com.ibm.icu.text.Normalizer"
#: MB of input in one range of ids.
RANGE_MB = 512
#: Unicode white space, controls of that kind included.
BLANKS = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    """NFKC, lower case, folded white space; ASCII texts skip the normaliser."""
    t = F.coalesce(text, F.lit(""))
    wide = F.octet_length(t) != F.char_length(t)
    normal = F.when(wide, F.coalesce(F.call_function("java_method", F.lit(NORMALIZER), F.lit("compose"), t, F.lit(True)), t)).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(normal), BLANKS, " "))


def digest(folded: Column) -> Column:
    """128 bits of a canonical text as 32 hex digits."""
    half = lambda *seed: F.lpad(F.lower(F.hex(F.xxhash64(*seed))), 16, "0")
    return F.concat(half(folded), half(F.lit("second half"), folded))


def fingerprint(text: Column) -> Column:
    return let(canonical(text), digest)


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """1 where the digests agree and the canonical bytes do, else 0."""
    return F.when((fa == fb) & (a == b), F.lit(1.0)).otherwise(F.lit(0.0))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each id with ``fingerprint``, ``group_id`` (least id of byte-equal canonical texts) and ``n_copies``.

    Digests are counted first, without the texts: a hot group is one row for each
    task before the shuffle. Only texts of buckets with several rows travel on,
    to meet the bucket's head text; the bucket side of that join has one row a
    bucket, so a hot bucket can be split. What differs from its head (a
    collision) is grouped by its own bytes.
    """
    rows = docs.select(F.col(id_col).alias("id"), let(canonical(F.col(text)), lambda c: F.struct(digest(c).alias("f"), c.alias("c"))).alias("v"))
    found = groups(rows.select("id", F.col("v.f").alias("f"), F.col("v.c").alias("c")), rows.select("id", F.col("v.f").alias("f")))
    return found.select(F.col("id").alias(id_col), F.col("f").alias("fingerprint"), "group_id", "n_copies")


def groups(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, f, group_id, n_copies), a row for each of ``marks`` (id, f); ``texts`` (id, f, c) has their canonical texts.

    Null ids come last as heads: a group of null ids alone has a null group_id.
    """
    buckets = marks.groupBy("f").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    single = marks.join(buckets.filter("n = 1").select("f"), "f").select("id", "f", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("n_copies"))
    many = materialize(texts.join(buckets.filter("n > 1").select("f", "head"), "f"), "copies")
    heads = many.filter(F.col("id").eqNullSafe(F.col("head"))).groupBy("f").agg(F.min("c").alias("first"))
    met = many.join(heads, "f").select("id", "f", "head", (F.col("c") == F.col("first")).alias("same"), F.when(F.col("c") != F.col("first"), F.col("c")).alias("c"))
    met = materialize(met, "compared")
    alike = met.filter("same").groupBy("f").agg(F.count("*").alias("n_copies"))
    out = single.unionByName(met.filter("same").join(alike, "f").select("id", "f", F.col("head").alias("group_id"), "n_copies"))
    other = met.filter("not same")
    own = other.groupBy("f", "c").agg(F.min("id").alias("group_id"), F.count("*").alias("n_copies"))
    return out.unionByName(other.join(own, ["f", "c"]).select("id", "f", "group_id", "n_copies"))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: a binary search in one expression (null: 0)."""
    if not cuts:
        return F.lit(0)
    edges = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.get(edges, mid) <= value
        return (
            F.when((s["lo"] >= s["hi"]) | value.isNull(), s)
            .when(low, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step)["lo"]


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text, next_text`` in ascending order of id, the last row followed by the first.

    Ids are cut into ranges of about equal size, so no task orders them all; the
    last row of each range takes the first row of the next range that has rows.
    Rows of equal id stand in order of a hash of their text.
    """
    n = parts(docs, RANGE_MB)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    found = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] if n > 1 else []
    cuts = sorted(set(found or []))
    used = sorted(r["b"] for r in ids.select(_range_of(F.col("id"), cuts).alias("b")).distinct().collect())  # at most n
    follow = F.lit(None).cast("int")
    if used:
        after = F.split(F.lit(",".join(map(str, used[1:] + used[:1]))), ",").cast("array<int>")
        own = F.split(F.lit(",".join(map(str, used))), ",").cast("array<int>")
        follow = F.get(own, F.array_position(after, F.col("b")).cast("int") - 1)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("id", "text", F.xxhash64("text").alias("h"), _range_of(F.col("id"), cuts).alias("b"))
    by = Window.partitionBy("b").orderBy(F.col("id").asc_nulls_first(), "h")
    # the first row of each range: its key first, which is small, then the texts of these rows alone (at most n keys are sent)
    keys = d.groupBy("b").agg(F.min(F.struct("id", "h")).alias("k")).select("b", F.col("k.id").alias("k_id"), F.col("k.h").alias("k_h"))
    hit = (F.col("id").eqNullSafe(F.col("k_id"))) & (F.col("h") == F.col("k_h"))
    heads = d.drop("b").join(F.broadcast(keys), hit).groupBy("b").agg(F.first("text").alias("first_text")).select(follow.alias("b"), "first_text")
    d = d.repartition(n, "b")
    rows = d.select("b", "id", "text", F.lead("text").over(by).alias("next_text"))
    return rows.join(heads, "b", "left").select("id", "text", F.coalesce("next_text", "first_text").alias("next_text"))
