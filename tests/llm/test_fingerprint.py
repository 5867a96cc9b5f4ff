import hashlib
import re
import unicodedata

from rasterloom.llm import fingerprint, queries


def canon(t):
    return re.sub(r"[\s\x1c-\x1f]+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip(" ")


def test_query(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in queries.op4_fingerprint(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    by_canon = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canon(t) == canon(edited))
        assert r["near_next"] == float(canon(t) == canon(nxt))
        assert by_canon.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_canon.values())) == len(by_canon)


def test_canonical(spark):
    texts = ["Ａｂｃ  é", "abc é", "ABC É ", "abc e", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    g = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(df).collect()}
    assert g == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_odd(odd, empty):
    rows = fingerprint.with_next(odd).collect()
    assert len(rows) == odd.count()
    order = sorted(rows, key=lambda r: (r["id"] is not None, r["id"] or 0))
    assert all(r["next_text"] is not None for r in order)
    assert fingerprint.with_next(empty).count() == 0
    assert fingerprint.exact_groups(empty).count() == 0
    groups = fingerprint.exact_groups(odd).collect()
    assert len(groups) == odd.count()


def test_one_row(spark):
    df = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprint.with_next(df).collect()] == [(5, "abcd", "abcd")]
