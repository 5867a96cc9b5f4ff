"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document; the ledger keeps one bit for each
rule that failed, beside the measurements. A policy is a versioned set of rules:
a mask. Applying another policy, or asking what each rule alone costs, reads the
ledger's bits and never the texts again.

Cases: a null or blank text has no words, so every measurement is 0 and only
``few_words`` fails; repeated rows each get their own ledger row; other columns
pass through, and a clashing name is replaced by the ledger's own column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: str


#: Bits are stable identifiers: append, never renumber.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "n_words > 0 and 10 * n_symbols > 15 * n_words"),
    Rule("long_words", 3, "n_words > 0 and word_chars > 20 * n_words"),
    Rule("short_words", 4, "n_words > 0 and 10 * word_chars < 15 * n_words"),
    Rule("duplicate_lines", 5, "n_dup_lines > 2 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("bars", 6, "n_words > 0 and 100 * n_bars > 20 * n_words"),
    Rule("shouting", 7, "n_letters > 0 and 100 * n_upper > 70 * n_letters"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bars", "n_letters", "n_upper")


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("long")


def _repeat_words(ws: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are sorted by a pair of hashes, so equal ones stand side by side;
    the positions that have an equal neighbour are sorted again, and each
    covers up to three words, less where the next window overlaps it.
    """

    def covered(keyed: Column) -> Column:
        same = lambda i, j: (F.get(keyed, i)["h"] == F.get(keyed, j)["h"]) & (F.get(keyed, i)["g"] == F.get(keyed, j)["g"])
        hit = F.filter(
            F.transform(keyed, lambda x, i: F.when((i > 0) & same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull()
        )
        return let(
            F.sort_array(hit),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long")),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        one = lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
            F.hash(F.get(w, i + 2), F.get(w, i), F.get(w, i + 1)).alias("g"),
            i.alias("p"),
        )
        return let(F.sort_array(F.transform(at, one)), covered)

    return F.when(F.size(ws) >= 4, windows(ws)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES, each text read once."""
    t = F.coalesce(F.col(text), F.lit(""))
    ws = words(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+", "") != "")
    row = let(
        F.struct(ws.alias("w"), lines.alias("l")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(v["w"]).alias("n_repeat_words"),
        ),
    )
    counts = {
        "word_chars": F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": _count(t, r"[#*$%&|<>]"),
        "n_bars": _count(t, r"\|"),
        "n_letters": _count(t, r"\p{L}"),
        "n_upper": _count(t, r"\p{Lu}"),
    }
    kept = [c for c in docs.columns if c not in MEASURES]
    # the caller's names stay inside a struct
    out = docs.select(F.struct(*kept).alias("row"), row.alias("found"), *[v.alias(k) for k, v in counts.items()])
    return out.select("row.*", *[F.col("found").getField(k).alias(k) for k in MEASURES if k not in counts], *counts)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``: bit b set when rule b failed."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it fails.

    One pass counts equal bit patterns (at most 2^rules rows); the rest reads those.
    """
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        seen.select("bits", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
        .withColumn("policy", F.lit(policy.version))
    )
