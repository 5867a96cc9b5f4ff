from collections import Counter

from rasterloom.llm import quality


def brute(text):
    t = text or ""
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    hit = set()
    for i, w in enumerate(zip(ws, ws[1:], ws[2:])):
        if wins[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_measures(docs, odd):
    for df in (docs, odd):
        rows = quality.ledger(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])


def test_empty(empty):
    assert quality.ledger(empty).count() == 0
    assert quality.ablations(quality.ledger(empty), quality.POLICIES["v2"]).filter("n_failed > 0").count() == 0


def test_policies_read_bits_only(docs):
    rows = quality.ledger(docs).select("doc_id", "fail_bits").cache()
    v1 = {r["doc_id"] for r in quality.apply_policy(rows, quality.POLICIES["v1"]).filter("kept").collect()}
    v2 = {r["doc_id"] for r in quality.apply_policy(rows, quality.POLICIES["v2"]).filter("kept").collect()}
    assert v2 < v1
    for r in quality.ablations(rows, quality.POLICIES["v2"]).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r["rule"])
        mine = [x["fail_bits"] for x in rows.collect()]
        assert r["n_failed"] == sum(b & bit != 0 for b in mine)
        assert r["n_only"] == sum(b == bit for b in mine)
