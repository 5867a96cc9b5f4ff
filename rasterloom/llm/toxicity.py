"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, lower case) are hashed into an embedding table; filters
of widths 1 to 3 slide over the whole text, each keeps its highest response, and
a logistic layer turns these into a score. Words that fewer than ``MIN_DOCS``
training texts (or one text in ``RARE``) hold share one silent embedding, so rare
words can't be learnt by heart. The first dimension starts at a word's log-odds
between the labels, where these are significant; the others start at random. A held-back part of the training rows calibrates the score (Platt) and
picks, for each language, the threshold with the best F1.

Fitting uses a bounded sample of labelled rows: at most about ``MAX_ROWS`` of
them, chosen by a hash, and ``MAX_WORDS`` words in all. Scoring reads every whole
text. The model's size is fixed by its parameters.

Cases: a null or empty text scores the model's value for no words; repeated rows
are scored each; without labelled rows of both classes every score is the
training share of label 1 (0 when there are none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
MAX_ROWS, MAX_WORDS = 4_000, 6_000_000
MIN_DOCS, RARE = 4, 250
#: Standard errors from which a word's log-odds count at the start.
SIGNIFICANT = 2.5
EPOCHS, BATCH, RATE, DECAY = 10, 16, 0.01, 1e-4
_WORD = re.compile(r"[^\W\d_]+")


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 60_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return h


_MEMO = _Memo()


def word_ids(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(_MEMO.__getitem__, found), np.int64, len(found))


@dataclass
class Model:
    #: Bucket -> row of ``table``; row 0 is silent.
    row: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    _taps: list | None = None

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter, and where its window starts."""
        if self._taps is None:
            self._taps = [[self.table @ f[j] for j in range(len(f))] for f in self.filters]
        top, at = [], []
        for k, taps in enumerate(self._taps):
            need = max(0, len(taps) - len(ids))
            x = np.concatenate((ids, np.zeros(need, np.int64))) if need else ids
            m = len(x) - len(taps) + 1
            r = taps[0][x[:m]]
            for j in range(1, len(taps)):
                r = r + taps[j][x[j : j + m]]
            best = r.argmax(axis=0)
            at.append(best)
            top.append(r[best, np.arange(r.shape[1])] + self.bias[k])
        return np.concatenate(top), np.concatenate(at)

    def logit(self, ids: np.ndarray) -> float:
        top, _ = self.pooled(self.row[ids])
        return float(np.maximum(top, 0) @ self.out + self.out_bias)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.logit(word_ids(text)) * self.scale[0] + self.scale[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _start(row: np.ndarray, n: int, seed: int, odds: np.ndarray | None = None) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (n, DIM))
    if odds is not None:
        table[1:, 0] = odds / 2
    table[0] = 0
    filters = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    return Model(row, table, filters, np.zeros((len(WIDTHS), FILTERS)), rng.normal(0.1, 0.05, len(WIDTHS) * FILTERS), 0.0)


def log_odds(texts: list[np.ndarray], labels: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each known bucket, between texts of label 1 and 0, within 3; 0 where not significant."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, y in zip(texts, labels):
        (pos if y else neg)[np.unique(t)] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    p, q = pos[known] + 0.5, neg[known] + 0.5
    odds = np.log(p / (n1 + 1)) - np.log(q / (n0 + 1))
    return np.where(np.abs(odds) > SIGNIFICANT * np.sqrt(1 / p + 1 / q), np.clip(odds, -3, 3), 0)


def fit_rows(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 3) -> Model:
    """Train on word ids; the result is the same for the same rows in the same order."""
    df = np.zeros(BUCKETS, np.int64)
    for t in texts:
        df[np.unique(t)] += 1
    row = np.zeros(BUCKETS, np.int64)
    known = np.flatnonzero(df >= max(MIN_DOCS, len(texts) / RARE))
    row[known] = np.arange(1, len(known) + 1)
    held = np.arange(len(texts)) % 5 == 4
    own = [t for t, h in zip(texts, held) if not h]
    model = _start(row, len(known) + 1, seed, log_odds(own, labels[~held], known) if own else None)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    seqs = [row[t] for t in texts]
    train = np.flatnonzero(~held)
    params = [model.table, *model.filters, model.bias, model.out]
    one, two, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    ob1 = ob2 = 0.0
    rng = np.random.default_rng(seed)
    model.out_bias = float(np.log(labels[train].mean() + 1e-3) - np.log(1 - labels[train].mean() + 1e-3))
    best = (np.inf, None)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            grads, gb = [np.zeros_like(p) for p in params], 0.0
            model._taps = None
            for i in part:
                top, at = model.pooled(seqs[i])
                hidden = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
                e = (p - labels[i]) / len(part)
                grads[-1] += e * hidden
                gb += e
                back = e * model.out * (top > 0)
                grads[-2] += back.reshape(len(WIDTHS), FILTERS)
                for k, w in enumerate(WIDTHS):
                    b, a = back[k * FILTERS : (k + 1) * FILTERS], at[k * FILTERS : (k + 1) * FILTERS]
                    if not b.any():
                        continue
                    x = np.concatenate((seqs[i], np.zeros(w, np.int64)))
                    for j in range(w):
                        ids = x[a + j]
                        grads[1 + k][j] += model.table[ids].T * b
                        np.add.at(grads[0], ids, (model.filters[k][j] * b).T)
            step += 1
            grads[0][0] = 0
            for q, g, m, v in zip(params, grads, one, two):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * q)
            ob1 += 0.1 * (gb - ob1)
            ob2 += 0.001 * (gb * gb - ob2)
            model.out_bias -= RATE * (ob1 / (1 - 0.9**step)) / ((ob2 / (1 - 0.999**step)) ** 0.5 + 1e-8)
        model._taps = None
        z = np.array([_logit(model, seqs[i]) for i in np.flatnonzero(held)])
        loss = _loss(z, labels[held], (1.0, 0.0)) if len(z) else 0.0
        if loss < best[0]:
            best = (loss, ([p.copy() for p in params], model.out_bias, z))
    saved, model.out_bias, z = best[1]
    for q, s in zip(params, saved):
        q[:] = s
    model._taps = None
    if len(z) >= 20 and 0 < labels[held].sum() < len(z):
        model.scale = _platt(z, labels[held])
    probs = 1 / (1 + np.exp(-np.clip(z * model.scale[0] + model.scale[1], -30, 30)))
    model.thresholds = _thresholds(probs, labels[held], [langs[i] for i in np.flatnonzero(held)])
    return model


def _logit(model: Model, rows: np.ndarray) -> float:
    top, _ = model.pooled(rows)
    return float(np.maximum(top, 0) @ model.out + model.out_bias)


def _loss(z: np.ndarray, y: np.ndarray, scale: tuple[float, float]) -> float:
    s = np.clip(z * scale[0] + scale[1], -30, 30)
    return float(np.mean(np.log1p(np.exp(-s)) + (1 - y) * s))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift with the least loss over a grid that is then refined; a small pull to (1, 0)."""
    a, b, width = 1.0, 0.0, 1.0
    for _ in range(6):
        grid = [(a * 2**da, b + db) for da in np.linspace(-width, width, 9) for db in np.linspace(-2 * width, 2 * width, 9)]
        a, b = min(grid, key=lambda s: _loss(z, y, s) + 0.01 * (np.log(s[0]) ** 2 + 0.1 * s[1] ** 2))
        width /= 2
    return float(a), float(b)


def _thresholds(p: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 20) -> dict[str, float]:
    """Best F1 for each language with enough rows of label 1; ``""`` holds for the others."""

    def pick(p: np.ndarray, y: np.ndarray) -> float:
        best = (-1.0, 0.5)
        for t in np.unique(np.round(p, 3)):
            hit = p >= t
            f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())
            best = max(best, (f1, float(t)))
        return best[1]

    out = {"": pick(p, y) if len(p) else 0.5}
    for lang in sorted({x for x in langs if x is not None}):
        at = np.array([x == lang for x in langs])
        if at.sum() >= least and y[at].sum() >= 5:
            out[lang] = pick(p[at], y[at])
    return out


def fit(docs: DataFrame, labels: DataFrame, train_if, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on labelled rows where ``train_if`` holds; words are hashed on the executors."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & train_if).select(F.col(id_col).alias("i"), F.col("toxic").alias("y"))
    n = rows.count()
    unit = F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(unit < min(1.0, max_rows / max(1, n))).limit(2 * max_rows)
    has_lang = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    found = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), has_lang.alias("l")).join(F.broadcast(rows), "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["w"] = [word_ids(t).astype(np.uint16).tobytes() for t in b["t"]]
            yield b[["i", "y", "l", "w"]]

    texts, y, langs, total = [], [], [], 0
    got = found.select("i", "y", "l", "t").mapInPandas(run, "i long, y int, l string, w binary")
    for r in got.orderBy(F.xxhash64(F.lit(12), "i"), "i", "w", "y").toLocalIterator():
        if total + len(r["w"]) // 2 > max_words:
            continue  # one long text takes no other's place
        total += len(r["w"]) // 2
        texts.append(np.frombuffer(r["w"], np.uint16).astype(np.int64))
        y.append(float(r["y"]))
        langs.append(r["l"])
    return fit_rows(texts, np.array(y), langs)


def scored(docs: DataFrame, model: Model, text: str = "text", lang: str | None = None) -> DataFrame:
    """``docs`` with score and, where ``lang`` is given, ``flagged`` by that language's threshold."""

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in t], dtype=float)

    model._taps = None
    out = docs.withColumn("score", run(F.col(text)))
    if lang:
        own = {k: v for k, v in model.thresholds.items() if k}
        base = F.lit(model.thresholds.get("", 0.5))
        picked = F.coalesce(F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col(lang)], base) if own else base
        out = out.withColumn("flagged", F.col("score") >= picked)
    return out
