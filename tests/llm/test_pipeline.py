"""Each stage on its predecessor's rows, against plain Python."""

from collections import Counter

import corpus_pipeline
from rasterloom.llm import pii
from tests.llm import test_mixing, test_packing
from tests.llm.test_minhash import brute as components
from tests.llm.test_quality import brute as measures

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple(r[c] for c in corpus_pipeline.COLUMNS)


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "pii", "mix", "pack"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, out = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        if name != "pack":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "quality":
            kept = Counter(map(key, rows))
            assert not kept - Counter(map(key, before))
            for r in before:
                n, _, _, _, rep = measures(r["text"])
                if n < 50 or 100 * rep > 50 * n:
                    assert not kept[key(r)]
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [r for r in before if labels.get(r["doc_id"]) == 1 and measures(r["text"])[0] >= 50]
            assert sum(kept[key(r)] for r in good) >= 0.95 * len(good)
        elif name == "dedup":
            want = components([(r["doc_id"], r["text"]) for r in before])
            assert Counter(map(key, rows)) == Counter(key(r) for r in before if want[r["doc_id"]][1] == r["doc_id"])
        elif name == "pii":
            old = {r["doc_id"]: r for r in before}
            assert len(rows) == len(before)
            for r in rows:
                assert r["text"] == pii.redact(old[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"])
                assert not [s for s in pii.spans(r["text"]) if s.kind in pii.BASE_KINDS]
        elif name == "mix":
            drawn = Counter(map(key, rows))
            assert set(drawn) == set(map(key, before)) and max(drawn.values()) <= 2
            assert drawn == Counter(key(r) for r in test_mixing.check(docs))
        else:
            test_packing.check(rows, docs, 0.01)
        docs = out


def test_odd(spark, odd, empty):
    for df in (odd, empty):
        rows = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
        rows.collect()


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
