import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import toxicity
from rasterloom.llm.common import remainder

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = remainder(F.col("doc_id"), 4) != 2
    model = toxicity.fit(docs, labels, train)
    rows = toxicity.scored(docs.filter(~train).join(labels, "doc_id"), model, lang="lang").select("score", "toxic", "flagged").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.8
    assert rows["score"].between(0, 1).all()
    again = toxicity.fit(docs, labels, train)
    assert np.allclose(again.table, model.table) and again.thresholds == model.thresholds


def test_learns_a_planted_word():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(400):
        words = rng.integers(0, 300, int(rng.integers(5, 80)))
        y = k % 4 == 0
        if y:
            words[rng.integers(len(words))] = 900 + rng.integers(3)
        texts.append(words.astype(np.int64))
        labels.append(float(y))
    model = toxicity.fit_rows(texts, np.array(labels), ["en"] * 400)
    z = np.array([model.logit(t) for t in texts])
    assert auc(z, np.array(labels)) > 0.97 and "en" in model.thresholds and "" in model.thresholds


def test_odd(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (6, 0), (7, 1), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    rows = toxicity.scored(odd, model, lang="lang").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["flagged"] is not None for r in rows)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.fit(empty, labels, F.lit(True))
    assert {r["score"] for r in toxicity.scored(odd, none).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_short_texts(n):
    row = np.zeros(toxicity.BUCKETS, np.int64)
    model = toxicity._start(row, 5, 0)
    assert np.isfinite(model.logit(np.zeros(n, np.int64)))
