"""Scalar formulas that render as Spark SQL and as DuckDB SQL.

A formula is written once, over ``X`` values; ``X.col`` gives the Spark column,
``X.duck`` the text for the checking engine. Only what differs between the two
dialects is treated here: rounding, literals, list access.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class X:
    """A scalar expression in two dialects."""

    __slots__ = ("duck", "spark")

    def __init__(self, spark: str, duck: str | None = None):
        self.spark, self.duck = spark, spark if duck is None else duck

    @property
    def col(self) -> Column:
        return F.expr(self.spark)

    def _two(self, other, op: str, flip: bool = False) -> X:
        a, b = (lit(other), self) if flip else (self, lit(other))
        return X(f"({a.spark} {op} {b.spark})", f"({a.duck} {op} {b.duck})")

    __add__ = lambda s, o: s._two(o, "+")
    __radd__ = lambda s, o: s._two(o, "+", True)
    __sub__ = lambda s, o: s._two(o, "-")
    __rsub__ = lambda s, o: s._two(o, "-", True)
    __mul__ = lambda s, o: s._two(o, "*")
    __rmul__ = lambda s, o: s._two(o, "*", True)
    __truediv__ = lambda s, o: s._two(o, "/")
    __rtruediv__ = lambda s, o: s._two(o, "/", True)
    __mod__ = lambda s, o: s._two(o, "%")
    __lt__ = lambda s, o: s._two(o, "<")
    __le__ = lambda s, o: s._two(o, "<=")
    __gt__ = lambda s, o: s._two(o, ">")
    __ge__ = lambda s, o: s._two(o, ">=")
    __and__ = lambda s, o: s._two(o, "AND")
    __or__ = lambda s, o: s._two(o, "OR")

    def eq(self, other) -> X:
        return self._two(other, "=")

    def __neg__(self) -> X:
        return X(f"(-{self.spark})", f"(-{self.duck})")

    def __invert__(self) -> X:
        return X(f"(NOT {self.spark})", f"(NOT {self.duck})")


def lit(v) -> X:
    if isinstance(v, X):
        return v
    if isinstance(v, bool):
        return X(str(v).lower())
    if isinstance(v, float):
        return X(f"{v!r}D", f"({v!r}::DOUBLE)")
    if isinstance(v, str):
        return X("'" + v.replace("'", "''") + "'")
    return X(str(v)) if v >= 0 else X(f"({v})")


def name(n: str) -> X:
    return X(n)


def names(*n: str) -> list[X]:
    return [X(v) for v in n]


def call(spark: str, *args, duck: str | None = None) -> X:
    a = [lit(v) for v in args]
    return X(f"{spark}({', '.join(v.spark for v in a)})", f"{duck or spark}({', '.join(v.duck for v in a)})")


def when(*pairs, other) -> X:
    """``when((condition, value), ..., other=value)``."""
    o = lit(other)
    s = " ".join(f"WHEN {lit(c).spark} THEN {lit(v).spark}" for c, v in pairs)
    d = " ".join(f"WHEN {lit(c).duck} THEN {lit(v).duck}" for c, v in pairs)
    return X(f"(CASE {s} ELSE {o.spark} END)", f"(CASE {d} ELSE {o.duck} END)")


def least(*a) -> X:
    return call("least", *a)


def greatest(*a) -> X:
    return call("greatest", *a)


def dbl(v) -> X:
    v = lit(v)
    return X(f"CAST({v.spark} AS DOUBLE)", f"CAST({v.duck} AS DOUBLE)")


def floor_int(v) -> X:
    v = lit(v)
    return X(f"CAST(floor({v.spark}) AS INT)", f"CAST(floor({v.duck}) AS INT)")


def ceil_int(v) -> X:
    v = lit(v)
    return X(f"CAST(ceil({v.spark}) AS INT)", f"CAST(ceil({v.duck}) AS INT)")


def idiv(a, b) -> X:
    """Whole-number division of values that are not negative."""
    a, b = lit(a), lit(b)
    return X(f"({a.spark} div {b.spark})", f"({a.duck} // {b.duck})")


def clamp(v, lo, hi) -> X:
    return least(hi, greatest(lo, v))


def half_up(v) -> X:
    """floor(v + 1/2) as an integer."""
    return floor_int(lit(v) + 0.5)


def byte_even(v) -> X:
    """Clamped to 0..255, halves to the even neighbour."""
    c = clamp(v, 0.0, 255.0)
    return X(f"CAST(rint({c.spark}) AS INT)", f"CAST(round_even({c.duck}, 0) AS INT)")


def byte_cut(v) -> X:
    """Clamped to 0..255, fraction dropped."""
    return floor_int(clamp(v, 0.0, 255.0))


def byte_up(v) -> X:
    """Halves up, then clamped to 0..255."""
    return clamp(half_up(v), 0, 255)


def pick(values: Iterable[float], at, kind: str = "DOUBLE") -> X:
    """Entry ``at`` (from 0) of a constant table."""
    v, i = list(values), lit(at)
    suffix = "D" if kind == "DOUBLE" else ""
    s = ", ".join(f"{x!r}{suffix}" for x in v)
    d = ", ".join(repr(x) for x in v)
    return X(f"get(array({s}), {i.spark})", f"([{d}]::{kind}[])[{i.duck} + 1]")


class Steps:
    """A projection in several named steps, so that a value used often is computed once.

    Each step sees the columns of those before it.
    """

    def __init__(self) -> None:
        self.steps: list[dict[str, X]] = []

    def let(self, **values) -> Steps:
        self.steps.append({k: lit(v) for k, v in values.items()})
        return self

    def keep(self, column: str, value) -> X:
        """Name one value and return the name."""
        self.let(**{column: value})
        return name(column)

    def spark(self, df):
        for s in self.steps:
            df = df.withColumns({k: v.col for k, v in s.items()})
        return df

    def duck(self, source: str) -> str:
        q, made = source, set()
        for s in self.steps:
            own = ", ".join(f"{v.duck} AS {k}" for k, v in s.items())
            again = ", ".join(k for k in s if k in made)
            q = f"SELECT q.*{f' EXCLUDE ({again})' if again else ''}, {own} FROM ({q}) q"
            made |= set(s)
        return q


def project(columns: list[str], values: dict[str, X]) -> Callable:
    """Keep ``columns`` and add ``values``."""
    return lambda df: df.select(*columns, *[v.col.alias(k) for k, v in values.items()])
