import math
from collections import Counter, defaultdict

import pytest

from rasterloom.llm import mixing

TOKENS = {"a": 800, "b": 150, "c": 50}


def test_exponent():
    assert mixing.fit_exponent(TOKENS, max_repeat=None) == 0.0
    x = mixing.fit_exponent(TOKENS, max_repeat=2.0)
    assert max(mixing.repeats(TOKENS, x).values()) == pytest.approx(2.0)
    assert min(mixing.repeats(TOKENS, x).values()) == pytest.approx(1.0)
    x = mixing.fit_exponent(TOKENS, target_entropy=0.9, max_repeat=None)
    assert mixing.entropy(mixing.weights(TOKENS, x)) == pytest.approx(0.9)
    assert mixing.fit_exponent(TOKENS, target_entropy=0.9, max_repeat=1.2) > x
    assert mixing.weights(TOKENS, 1.0)["a"] == pytest.approx(0.8) and mixing.weights(TOKENS, 0.0)["c"] == pytest.approx(1 / 3)


def n_tokens(t):
    return max(1, len((t or "").encode().split()))


def check(df, **more):
    rows = df.select("doc_id", "source", "text").collect()
    total = Counter()
    for r in rows:
        total[r["source"]] += n_tokens(r["text"])
    x = mixing.fit_exponent({s or "\0null": n for s, n in total.items()}, max_repeat=2.0)
    want = mixing.repeats({s or "\0null": n for s, n in total.items()}, x)
    drawn = mixing.mix(df, **more).collect()
    by = defaultdict(list)
    for r in drawn:
        by[r["source"]].append(r)
    first = Counter((r["doc_id"], r["text"]) for r in drawn if r["epoch"] == 0)
    assert first == Counter((r["doc_id"], r["text"]) for r in rows)  # no row is dropped
    for s, own in by.items():
        got, budget = sum(r["n_tokens"] for r in own), want[s or "\0null"] * total[s]
        longest = max(r["n_tokens"] for r in own)
        assert budget - 1 <= got <= budget + longest + 1
        assert all(r["repeat"] == pytest.approx(want[s or "\0null"]) and 0 <= r["place"] < 1 for r in own)
        assert max(Counter((r["doc_id"], r["epoch"]) for r in own if r["doc_id"] is not None).values()) <= 2  # the repeated row
    return drawn


def test_table(docs):
    drawn = check(docs, block=500)
    again = mixing.mix(docs.repartition(5), block=500).collect()
    key = lambda r: (r["doc_id"], r["epoch"], r["block"], r["place"])
    assert sorted(map(key, drawn)) == sorted(map(key, again))
    assert len({r["block"] for r in drawn}) > 1


def test_blocks_are_ordered_anew(docs):
    one = docs.withColumn("source", docs["lang"])
    drawn = mixing.mix(one, block=200, max_repeat=8.0).collect()
    order = defaultdict(list)
    for r in sorted(drawn, key=lambda r: r["place"]):
        order[r["source"], r["epoch"]].append(r["doc_id"])
    epochs = [k for k in order if k[1] == 1 and len(order[k]) > 5]
    assert epochs and all(order[s, 1] != order[s, 0][: len(order[s, 1])] for s, _ in epochs)


def test_odd(odd, empty):
    check(odd)
    out = mixing.mix(empty)
    assert out.count() == 0 and set(mixing.DRAWN) <= set(out.columns)
    assert math.isfinite(mixing.fit_exponent({"only": 3}))
