import random

import pytest

from rasterloom.llm import minhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """Component and set size of each id, by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                x, y = sorted((find(sets[a][0]), find(sets[b][0])))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
    want = brute(rows)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]][1], want[r["doc_id"]][1] == r["doc_id"])


def test_table(docs):
    check(docs)


def test_chains_and_common_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        text = [word() for _ in range(120)]
        for _ in range(12):  # each differs from the one before in one word, so the ends are far apart
            text = list(text)
            text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(25 + 2 * k)]) for k in range(40)]
    rows += [" ".join(passage)] * 5 + ["one two", "ONE two", "two one", "", "  "]
    rng.shuffle(rows)
    check(spark.createDataFrame([(3 * i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3))


@pytest.mark.parametrize("loose", [0.0, 1.1])
def test_one_family_or_guests_only(spark, monkeypatch, loose):
    """Texts that share a passage: all in one family, or each a guest of the others' hubs."""
    monkeypatch.setattr(minhash, "LOOSE", loose)
    monkeypatch.setattr(minhash._alike, "__defaults__", (loose,))
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [" ".join(passage + [word() for _ in range(12 + k % 5)]) for k in range(40)]
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_families_of_several_blocks(spark, monkeypatch):
    """Variants of one text at all distances, in blocks far smaller than the family."""
    monkeypatch.setattr(minhash, "CELLS", 1500)
    monkeypatch.setattr(minhash, "PIVOTS", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append(" ".join(text))
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


@pytest.mark.parametrize("cells", [1_000_000, 300])
def test_one_id_with_several_texts(spark, monkeypatch, cells):
    """Each text of an id links its own near copy, whichever is read last, in one block or in several."""
    monkeypatch.setattr(minhash, "CELLS", cells)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(4):
        for k in range(3):
            text = [word() for _ in range(60)]
            rows += [(10 * g, " ".join(text)), (10 * g + 1 + k, " ".join([*text, word()]))]
    for order in (rows, rows[::-1]):
        check(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))


def test_spanning():
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 40 - int(rng.integers(0, 9)), False), rng.integers(100, 9999, int(rng.integers(0, 5))).astype(np.uint64)))) for _ in range(60)]
    want = minhash._Union(list(range(60)))
    for i in range(60):
        for j in range(i):
            if minhash.linked(sets[i], sets[j]):
                x, y = want.find(i), want.find(j)
                want.root[max(x, y)] = min(x, y)
    for todo in (None, [True] * 60):
        got = minhash._Union(list(range(60)))
        for i, j in minhash.spanning(sets, list(range(60)), todo):
            assert minhash.linked(sets[i], sets[j])
            x, y = got.find(i), got.find(j)
            got.root[max(x, y)] = min(x, y)
        assert got.roots().tolist() == want.roots().tolist()


def test_odd(odd, empty):
    check(odd)
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (75, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 50 for i in (75, 100, 200))
