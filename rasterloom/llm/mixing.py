"""Temperature mixing of sources.

Each source's share of the tokens is raised to an exponent between 0 and 1 and
normalised: 1 leaves the shares, 0 makes all sources equal. The exponent is found
by bisection against a target entropy of the weights, a limit on how often a
source repeats, or both. Weights become budgets: the source with the lowest
repetition gets exactly one epoch, the others more, so no row is dropped.

A budget is realised in blocks of about ``BLOCK`` tokens: a keyed hash deals a
source's rows into blocks and orders the blocks anew in each epoch. Whole epochs
take every block; of the last, partial epoch the leading blocks that fit in the
budget are taken, and of the block at the edge the leading rows.

What is known of each source (tokens, weight, repetition, number of blocks) is a
table, however many sources there are; the driver sees only the bisection's one
row of sums a step. Sources are first joined to blocks, whose order is a small
table, so rows meet one join, whose key is source and block: a hot source spreads
over its blocks. Cumulative sums run over blocks first and over the rows of a
block second, so the rows of a hot source never meet in one task.

Cases: a null source is a source of its own; a null or blank text counts one
token; repeated rows are drawn each; no rows give no rows; columns of the input
are kept as they are, whatever their names, except those that are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

BLOCK = 1 << 18
MAX_REPEAT = 2.0
#: Blocks of a source grow beyond this many, so their order stays one small table for each source.
MAX_BLOCKS = 1 << 17
#: Columns added to each draw.
DRAWN = {"n_tokens": "long", "weight": "double", "repeat": "double", "epoch": "int", "block": "long", "place": "double"}


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items()}
    norm = sum(raised.values())
    return {s: w / norm for s, w in raised.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repeats(tokens: dict, exponent: float) -> dict:
    """Epochs for each source, the least repeated source having one."""
    total = sum(tokens.values())
    rate = {s: w * total / tokens[s] for s, w in weights(tokens, exponent).items()}
    low = min(rate.values())
    return {s: r / low for s, r in rate.items()}


def bisect(ok, steps: int = 60) -> float:
    """The least exponent where ``ok`` holds; it holds at 1 and may fail at 0."""
    if ok(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def fit_exponent(tokens: dict, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, steps: int = 60) -> float:
    """The largest exponent that reaches the entropy, or the smallest that keeps the limit; the limit wins."""
    limit = bisect(lambda x: max(repeats(tokens, x).values()) <= max_repeat, steps) if max_repeat else 0.0
    if target_entropy is None:
        return limit
    return max(limit, bisect(lambda x: entropy(weights(tokens, x)) <= target_entropy, steps))


def _exponent(sizes: DataFrame, total: int, target_entropy: float | None, max_repeat: float | None) -> float:
    """``fit_exponent`` over the table of sources: a step is one aggregation to a single row.

    A source's repetition is its share to the power x - 1 over the least such
    value; the share raised is monotone, so only the least and largest share
    matter for the limit.
    """
    share = F.col("tokens") / F.lit(float(total))
    ends = sizes.agg(F.min(share), F.max(share)).first()
    limit = bisect(lambda x: (ends[0] ** (x - 1)) / (ends[1] ** (x - 1)) <= max_repeat) if max_repeat else 0.0
    if target_entropy is None:
        return limit

    def low_enough(x: float) -> bool:
        raised = F.pow(share, F.lit(x))
        norm, logs = sizes.agg(F.sum(raised), F.sum(raised * F.ln(raised))).first()
        return math.log(norm) - logs / norm <= target_entropy

    return max(limit, bisect(low_enough, 40))


def sources(rows: DataFrame, target_entropy: float | None, max_repeat: float | None, block: int) -> DataFrame:
    """(s, tokens, weight, repeat, blocks) of ``rows`` (s, n): one row for each source."""
    sizes = materialize(rows.groupBy("s").agg(F.sum("n").alias("tokens")), "sources")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sizes.select("s", "tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("weight", "double"), ("repeat", "double"), ("blocks", "long"))])
    x = _exponent(sizes, total, target_entropy, max_repeat)
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x))
    norm, low = sizes.agg(F.sum(raised), F.min(raised / F.col("tokens"))).first()
    return sizes.select(
        "s",
        "tokens",
        (raised / F.lit(norm)).alias("weight"),
        (raised / F.col("tokens") / F.lit(low)).alias("repeat"),
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block))).cast("long").alias("blocks"),
    )


def _before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeat: float = MAX_REPEAT,
    block: int = BLOCK,
    seed: int = 17,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs``, one row for each draw, with the draw's place.

    Adds n_tokens, weight, repeat (of the source), epoch, block (place of the block
    in its epoch) and place: the share of the source's budget that comes before
    the row, so ordering by ``place`` interleaves the sources at their weights.
    """
    own = [c for c in docs.columns if c not in DRAWN]
    n = F.greatest(F.size(words(F.col(text))), F.lit(1)).cast("long")
    s = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    # the caller's columns travel in one struct, so no name of theirs meets one used here
    rows = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), n.alias("n"), s.alias("s"), h.alias("h"))
    known = sources(docs.select(s.alias("s"), n.alias("n")), target_entropy, max_repeat, block)

    # every source's blocks are a fixed grid, so rows find theirs by source alone; wide sources are split first
    rows = rows.join(F.broadcast(known.select("s", "blocks")) if _few(known) else known.select("s", "blocks"), "s")
    rows = rows.withColumn("b", F.pmod("h", "blocks")).drop("blocks")

    # the order of the blocks in each epoch, and what comes before each
    sums = rows.groupBy("s", "b").agg(F.sum("n").alias("bt")).join(known, "s")
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("repeat")).cast("int") - 1)))
    order = Window.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed), "s", "epoch", "b"), "b")
    sums = sums.withColumns(
        {
            "before": _before(F.col("bt"), order),
            "block": (F.row_number().over(order) - 1).cast("long"),
            "room": F.round(F.col("tokens") * F.least(F.lit(1.0), F.col("repeat") - F.col("epoch"))).cast("long"),
        }
    ).filter("before < room")

    # the rows of a block in the epoch's own order: each travels once, with its block
    inner = Window.partitionBy("s", "b", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "h"), "h")
    drawn = rows.join(sums.drop("bt", "blocks"), ["s", "b"])
    drawn = drawn.withColumn("at", F.col("before") + _before(F.col("n"), inner)).filter("at < room")
    place = (F.col("epoch") * F.col("tokens") + F.col("at")) / (F.col("tokens") * F.col("repeat"))
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("n").alias("n_tokens"), "weight", "repeat", "epoch", "block", place.alias("place"))


#: Sources whose numbers are broadcast; more of them are joined by a shuffle.
FEW = 20_000


def _few(known: DataFrame) -> bool:
    return known.limit(FEW + 1).count() <= FEW
