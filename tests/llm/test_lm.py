import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import lm

BEGIN, END = ("begin",), ("end",)


def toks(text):
    return [BEGIN, *(text or "").encode().lower().split(), END]


def brute(rows, order, strength, train):
    """A dictionary model walked token by token, with explicit failure steps."""
    grams = Counter()
    for i, t in rows:
        if train(i):
            s = toks(t)
            for e in range(1, len(s)):
                for k in range(1, order + 1):
                    if e - k + 1 >= 0:
                        grams[tuple(s[e - k + 1 : e + 1])] += 1
    uni = {g: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    n1, n2 = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    context = lambda h: grams[(END,)] if h == (BEGIN,) else grams[h]

    def p(h, w):
        if not h:
            return ((uni[(w,)] - d) / n if (w,) in uni else d * v / n) if n else 1.0
        c, low = context(h), p(h[1:], w)
        return (grams[(*h, w)] + strength * low) / (c + strength)

    out = []
    for i, t in rows:
        s = toks(t)
        score = sum(math.log10(p(tuple(s[max(0, e - order + 1) : e]), s[e])) for e in range(1, len(s)))
        base = sum(math.log10((grams[(w,)] + 1) / (n + v + 1)) for w in s[1:])
        out.append((i, not train(i), len(s) - 1, sum(grams[(w,)] > 0 for w in s[1:]), n, base, score))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))


def check(df, order):
    train = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted(brute(rows, order, lm.STRENGTH, train), key=key)
    got = sorted((tuple(r) for r in lm.score(df, lm.by_remainder(7, 2), order=order).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_bigram(docs):
    check(docs.repartition(7), 2)


def test_trigram(docs):
    check(docs.repartition(5), lm.ORDER)


def test_longer_and_odd(odd):
    check(odd.filter("doc_id is null or doc_id <> 6"), 4)
    check(odd, 3)
    check(odd, 2)


def test_many_groups(docs, monkeypatch):
    """Every n-gram's total is whole however the texts are dealt."""
    monkeypatch.setattr(lm, "parts", lambda df, mb: 23)
    check(docs.filter("doc_id % 3 = 0"), 4)


def test_empty_and_untrained(empty, spark):
    assert lm.score(empty, F.lit(True)).count() == 0
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def automaton(texts, train, order, strength=3.0):
    grams = lm.Grams(texts, np.array(train, float), order)
    for k in range(order):
        grams.collect(k)
    c = grams.count[0]
    return grams, lm.Automaton(grams, lm.Stats(int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum())), strength)


def test_each_state_sums_to_one():
    text = ["a b a c", "a b b", "c a"]
    for before in ("a", "a b", "b b", "c zzz", "zzz a"):
        tried = [f"{before} {w}" for w in ("a", "b", "c", "zzz")] + [before]
        grams, auto = automaton(text + tried, [1] * len(text) + [0] * len(tried), 3)
        places = np.cumsum(grams.size)[len(text) :] - np.array([2] * 4 + [1])  # the token after ``before``; the end for the last
        assert abs((10 ** auto.walk()[places]).sum() - 1) < 1e-9


def test_states_arcs_and_failures():
    grams, auto = automaton(["a b", "a c"], [1, 1], 3)
    n = len(auto.fail)
    assert auto.fail[0] == auto.fail[auto.begin] == 0 and (auto.fail[1:] != np.arange(1, n)).all()
    assert len(auto.arc) == sum((c > 0).sum() for c in grams.count) and ((auto.target >= 0) & (auto.target < n)).all()
    for s in range(n):  # a failure chain ends at the empty context within order - 1 steps
        for _ in range(2):
            s = auto.fail[s]
        assert s == 0


def test_stretches_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    text = [" ".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(30)]
    _, auto = automaton(text, rng.integers(0, 2, 30), 4)
    monkeypatch.setattr(lm, "STRETCH", 10**6)
    monkeypatch.setattr(lm, "LANES", 1)
    whole = auto.walk()
    for stretch in (1, 2, 7):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        monkeypatch.setattr(lm, "LANES", 10**6)
        assert np.array_equal(auto.walk(), whole)


def test_better_than_base(docs):
    rows = lm.score(docs, lm.by_remainder(7, 2)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
