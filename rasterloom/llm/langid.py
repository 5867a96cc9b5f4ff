"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (orders 1 to 4 of its letters,
lower case), with logarithmic counts, inverse document frequencies and unit
length. Each language is described by several centroids, found by spherical
k-means over its labelled texts. A text takes the language of the centroid with
the highest cosine; where even that is further than nearly all training texts of
the centroid were, the text is flagged ``rejected``.

Fitting uses a bounded sample of labelled rows: ``PER_LANGUAGE`` of each language
in expectation, chosen by a hash, or fewer where ``MAX_ROWS`` shared out among all
languages gives fewer. Whole
texts are read, in fitting and in prediction. The model's size is fixed by
languages, centroids and dimensions, so it travels with the task.

Cases: a text that is null or has no letter is ``und`` with score 0; repeated rows
are predicted each; with no labelled rows every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

DIM = 1 << 12
ORDERS = (1, 2, 3, 4)
CENTROIDS = 3
PER_LANGUAGE = 400
MAX_ROWS = 20_000
#: Share of a centroid's training texts that its radius keeps.
KEEP = 0.995
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the letters of a text; None without letters."""
    if text is None or not _LETTER.search(text):
        return None
    raw = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    total, h = np.zeros(DIM), np.zeros(len(raw), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        if len(raw) < k:
            break
        h = (h[: len(raw) - k + 1] + raw[k - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            total += np.bincount(h & np.uint32(DIM - 1), minlength=DIM)
    return total


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    def predict(self, c: np.ndarray | None) -> tuple[str, float, bool]:
        if c is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vectors(c)
        best = int(near.argmax())
        return self.languages[self.owner[best]], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.radius[best])


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest points, so it has no random state."""
    start = [int((v @ v.mean(axis=0)).argmax())]
    while len(start) < min(k, len(v)):
        start.append(int((v @ v[start].T).max(axis=1).argmin()))
    c = v[start]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_vectors(c: np.ndarray, labels: list[str], per: int = CENTROIDS) -> Model:
    languages = sorted(set(labels))
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1 if len(c) else np.ones(DIM)
    model = Model(languages, idf, np.zeros((0, DIM)), np.zeros(0, int), np.zeros(0))
    if not languages:
        return model
    v, own = model.vectors(c), np.array([languages.index(x) for x in labels])
    groups = [_kmeans(v[own == i], per) for i in range(len(languages))]
    model.centroids = np.concatenate(groups)
    model.owner = np.repeat(np.arange(len(languages)), [len(g) for g in groups])
    for j, o in enumerate(model.owner):
        mine = v[own == o]
        near = (mine @ model.centroids[model.owner == o].T).argmax(axis=1) == j - int(np.flatnonzero(model.owner == o)[0])
        reach = mine[near] @ model.centroids[j]
        model.radius = np.append(model.radius, np.quantile(reach, 1 - KEEP) * 0.9 if len(reach) else 0.0)
    return model


def fit(docs: DataFrame, train_if, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled rows where ``train_if`` holds; vectors are counted on the executors."""
    rows = docs.filter(train_if & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return fit_vectors(np.zeros((0, DIM)), [])
    each = min(per_language, max(1, MAX_ROWS // len(sizes)))
    share = F.create_map(*[F.lit(x) for kv in {s: min(1.0, each / n) for s, n in sizes.items()}.items() for x in kv])
    unit = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(unit < share[F.col(lang)]).select(F.col(lang).alias("l"), F.col(text).alias("t"), unit.alias("u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(x, u, counts(t)) for x, u, t in zip(b["l"], b["u"], b["t"])]
            found = [(x, u, c) for x, u, c in found if c is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            yield pd.DataFrame(
                {
                    "l": pd.Series([x for x, _, _ in found], dtype=object),
                    "u": pd.Series([u for _, u, _ in found], dtype=float),
                    "at": pd.Series([i.astype(np.uint16).tobytes() for i in at], dtype=object),
                    "c": pd.Series([c[i].astype(np.uint32).tobytes() for i, (_, _, c) in zip(at, found)], dtype=object),
                }
            )

    got = sorted(rows.mapInPandas(run, "l string, u double, at binary, c binary").collect(), key=lambda r: (r["u"], r["l"], bytes(r["at"])))
    dense = np.zeros((len(got), DIM))
    for row, r in zip(dense, got):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["c"], np.uint32)
    return fit_vectors(dense, [r["l"] for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    @tidy
    def run(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(counts(x)) for x in t], columns=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(F.struct(*kept).alias("row"), run(F.col(text)).alias("found"))  # the caller's names stay inside the struct
    return rows.select("row.*", "found.lang_pred", "found.score", "found.rejected")
