"""Operators recomputed by other means: no code of theirs takes part."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import langid, mixing, pii


def doubled(digits: str) -> bool:
    """The card checksum by its definition, from the left."""
    odd = len(digits) % 2
    return sum(sum(map(int, str(int(d) * (2 if i % 2 == odd else 1)))) for i, d in enumerate(digits)) % 10 == 0


def found(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's patterns as they stand."""
    out: dict[str, list[tuple[int, int]]] = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out["ip"] = [m.span() for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m.span(), re.sub(r"\D", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out["card"] = [s for s, d in cards if 16 <= len(d) <= 19 and doubled(d)]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    out["phone"] = [m.span() for m in phones if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_pii_spans_by_the_patterns(docs):
    rows = pii.summary(docs.select("doc_id", "text")).collect()
    for r in rows:
        base = [(k, *s) for k, own in found(r["text"] or "").items() for s in own]
        listed = [x.split(":") for x in r["pii"]["spans"].split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in listed if k in pii.BASE_KINDS] == base
        for k, a, b in listed:
            assert 0 <= int(a) < int(b) <= len(r["text"]) and k in pii.KINDS
            if k == "card_short":
                assert doubled(re.sub(r"\D", "", r["text"][int(a) : int(b)]))


def test_context_moves_the_score():
    bare = pii.spans("x 123-45-6789 x")
    near = pii.spans("social security 123-45-6789")
    assert not [s for s in bare if s.kind == "ssn"]
    assert [(s.kind, round(s.score, 6)) for s in near if s.kind == "ssn"] == [("ssn", 0.9)]


def grams(text: str) -> Counter:
    """Hashed byte n-grams, one at a time."""
    raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode("utf-8", "replace")
    out: Counter = Counter()
    for at in range(len(raw)):
        h = 0
        for k in range(1, 5):
            if at + k > len(raw):
                break
            h = ((h + raw[at + k - 1]) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
            out[h & 4095] += 1
    return out


def test_language_by_hand(docs):
    """Counts, weights and cosines of each text, against the model's centroids."""
    model = langid.fit(docs, F.col("doc_id") % 3 != 1)
    rows = docs.select("doc_id", "text").filter("doc_id % 5 = 0").collect()
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for r in rows:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        v = {i: math.log1p(n) * model.idf[i] for i, n in grams(r["text"]).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * c[i] for i, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert abs(got[r["doc_id"]]["score"] - min(1.0, near[best])) < 1e-9
        ties = {model.languages[model.owner[j]] for j, x in enumerate(near) if near[best] - x < 1e-12}
        assert got[r["doc_id"]]["lang_pred"] in ties
        assert got[r["doc_id"]]["rejected"] == bool(near[best] < model.radius[best])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)


def test_many_sources(spark):
    """More sources than are broadcast, and weights by their definition."""
    rows = [(i, f"s{i % 40}", " ".join(["w"] * (1 + i % 40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    few, mixing.FEW = mixing.FEW, 3
    try:
        drawn = mixing.mix(docs, max_repeat=3.0).collect()
    finally:
        mixing.FEW = few
    total = Counter()
    for _, s, t in rows:
        total[s] += len(t.split())
    share = {s: n / sum(total.values()) for s, n in total.items()}
    lo, hi = 0.0, 1.0
    for _ in range(80):
        x = (lo + hi) / 2
        rate = [p ** (x - 1) for p in share.values()]
        lo, hi = (lo, x) if max(rate) / min(rate) <= 3.0 else (x, hi)
    raised = {s: p**hi for s, p in share.items()}
    rate = {s: v / share[s] for s, v in raised.items()}
    for r in drawn:
        assert abs(r["weight"] - raised[r["source"]] / sum(raised.values())) < 1e-6
        assert abs(r["repeat"] - rate[r["source"]] / min(rate.values())) < 1e-6
    assert {r["doc_id"] for r in drawn} == {i for i, _, _ in rows}


def test_target_entropy_over_the_table(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 800), ("b", 150), ("c", 50)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = {r["source"]: r["weight"] for r in mixing.mix(docs, target_entropy=0.9, max_repeat=100.0).collect()}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9) < 1e-6
