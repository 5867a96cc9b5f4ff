import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import langid
from rasterloom.llm.common import remainder


def test_held_out_accuracy(docs):
    train = remainder(F.col("doc_id"), 3) != 1
    model = langid.fit(docs, train)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = langid.predict(docs.filter(~train), model).collect()
    right = [r["lang_pred"] == r["lang"] for r in rows]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_rejects_what_is_far(spark, docs):
    model = langid.fit(docs, F.lit(True))
    rows = langid.predict(spark.createDataFrame([("漢字仮名交じり文" * 20,), ("qzx jjv wqk " * 40,)], "text string"), model).collect()
    assert all(r["rejected"] for r in rows) and all(r["lang_pred"] in model.languages for r in rows)


def test_odd(odd, empty):
    model = langid.fit(odd, F.lit(True))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not (r["text"] or "").strip():
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.counts("12 345 --- ...") is None and langid.counts(None) is None


def test_whole_text_counts():
    a, b = langid.counts("le " * 5000 + "und"), langid.counts("le " * 5000)
    assert (a >= b - 1).all() and a.sum() > b.sum()
